import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalog import text as catalog
from tabweave.functions import grams
from tabweave.functions import text as functions
from tabweave.functions.text import clean_text, ngrams, term_counts, text_statistics, tokens
from tabweave.functions.wordlists import COMMON_WORDS, EMOTICONS, SPECIAL_MARKS
from tabweave.operators import text_features, topics, vectorize
from tabweave.plans.roles import Roles, col
from tabweave.plans.text_plan import TextPlan, fit_text_plan
from tabweave.session import scratch_path

TRICKY = [
    "Visit http://a.b/c?d and www.x.y or https://z now",
    "mail me@x.org, @you #tag a@ @b@c x@y@z",
    "Ünïcode ёж ЖУК nbsp em\x1funit 　wide",
    "Numbers 12 ３ ² — dash… quotes “x” (y) [z] {w} ~ ` ^ | \\ / 5% $6 &amp; *",
    "   ",
    "",
    "one.two!three? :) :( ;) :D :/ :P :| :* ::))",
    "tab\tnew\nline\r\nend\x0bvt\x0cff",
    "a" * 3000 + "@",
    "The cat AND the dog, of a kind. By the way!",
    "ǅ title Ⅷ roman",
]


def python_clean(text):
    if text is None:
        return ""
    for pattern in (r"http\S+|www\S+|https\S+", r"\S+@\S+", r"@\w+|#\w+"):
        text = re.sub(pattern, "", text)
    text = re.sub(r"[^a-zA-Zа-яА-Я0-9\s.,!?\-:]", " ", text)
    return re.sub(r"\s+", " ", text).strip().lower()


def spark_map(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    return [r[1] for r in sorted(df.select("i", expression(F.col("t")).alias("x")).collect())]


def test_cleaning_equals_python_patterns(spark):
    assert spark_map(spark, [*TRICKY, None], clean_text) == [python_clean(t) for t in [*TRICKY, None]]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("aZ9é@#:. \t  /hwtp-Я"), max_size=30), min_size=1, max_size=40))
def test_cleaning_of_random_text(spark, texts):
    assert spark_map(spark, texts, clean_text) == [python_clean(t) for t in texts]


def python_statistics(text):
    words = text.split()
    n, chars = len(words), len(text)
    return {
        "char_count": chars,
        "word_count": n,
        "sentence_count": max(1, sum(text.count(m) for m in ".!?")) if text else 0,
        "avg_word_length": sum(map(len, words)) / n if n else 0,
        "unique_words_ratio": len(set(words)) / n if n else 0,
        "stopword_ratio": sum(w.lower() in COMMON_WORDS for w in words) / n if n else 0,
        "digit_count": sum(c.isdigit() for c in text),
        "uppercase_ratio": sum(c.isupper() for c in text) / chars if chars else 0,
        "special_char_ratio": sum(c in SPECIAL_MARKS for c in text) / chars if chars else 0,
        "emoticon_count": sum(text.count(e) for e in EMOTICONS),
    }


def test_statistics_equal_python(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "i int, t string")
    rows = df.select("i", *[e.alias(k) for k, e in text_statistics(F.col("t")).items()]).orderBy("i").collect()
    for row, text in zip(rows, TRICKY):
        for name, value in python_statistics(text).items():
            assert row[name] == pytest.approx(value), (name, text)
    empty = text_features.add_statistics(spark.createDataFrame([(None,)], "t string"), ["t"], "raw").first().asDict()
    assert all(v == 0 for k, v in empty.items() if k != "t")


def test_ngrams_and_counts(spark):
    df = spark.createDataFrame([("The cat sat. The cat!",), ("x",), (None,)], "t string")
    got = df.select(ngrams(tokens(F.col("t")), (1, 3)).alias("g")).collect()
    assert Counter(got[0]["g"]) == Counter(
        "the cat sat the cat".split() + ["the cat", "cat sat", "sat the", "the cat", "the cat sat", "cat sat the", "sat the cat"]
    )
    assert got[1]["g"] == []
    counts = df.select(term_counts(ngrams(tokens(F.col("t")), (1, 2))).alias("c")).first()["c"]
    assert {c["term"]: c["tf"] for c in counts}["the cat"] == 2


DOCS = ["red cat sat", "red cat ran home", "blue dog ran", "the red dog", "", "the the the", "cat cat dog home", "red red red blue"]


def python_vectors(docs, cap, stop):
    def terms(d):
        kept = [w for w in re.findall(r"\b\w\w+\b", d.lower()) if w not in stop]
        return Counter(" ".join(kept[i : i + n]) for n in (1, 2, 3) for i in range(len(kept) - n + 1))

    counted = [terms(d) for d in docs]
    df = Counter(t for c in counted for t in c)
    total = sum(counted, Counter())
    allowed = [t for t in df if 2 <= df[t] <= 0.95 * len(docs)]
    chosen = sorted(sorted(allowed, key=lambda t: (-total[t], t))[:cap])
    out = {}
    for i, c in enumerate(counted):
        w = {t: c[t] * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in chosen if c[t]}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out |= {(i, t): v / norm for t, v in w.items()}
    return chosen, out


@pytest.mark.parametrize("cap", [1, 3, 100])
@pytest.mark.parametrize("screen", [1, 4, 20_000])
def test_tfidf_equals_python(spark, cap, screen):
    df = spark.createDataFrame(list(enumerate(DOCS)), "i int, t string")
    spec = vectorize.fit_vocabulary(df, F.col("t"), cap, screen=screen)
    chosen, want = python_vectors(DOCS, cap, set(spec["stop_words"]))
    assert spec["terms"] == chosen
    got = {(r["i"], r["term"]): r["weight"] for r in vectorize.long_terms(df, "i", F.col("t"), spec).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert vectorize.add_vectors(df, F.col("t"), spec, "v").count() == len(DOCS)


@pytest.mark.parametrize("piece", [1, 7, 2_000_000])
def test_grams_of_a_batch_equal_python(monkeypatch, piece):
    """Runs don't cross rows, also where a batch is cut; null and empty rows hold none, and a term may start another."""
    monkeypatch.setattr(grams, "PIECE", piece)
    draw = random.Random(5)
    rows = [None, [], *[[draw.choice("abcd") * 2 for _ in range(draw.randint(0, 9))] for _ in range(40)], None]
    made = [Counter(" ".join(r[i : i + n]) for n in (1, 2, 3) for i in range(len(r) - n + 1)) if r else Counter() for r in rows]
    tokens = pa.array([["zz"], *rows], pa.list_(pa.string())).slice(1)
    for words in (None, ["aa", "bb", "cc"]):
        total, held = Counter(), Counter()
        for batch in grams.count_grams(tokens, (1, 3), words and pa.array(words)):
            for r in batch.to_pylist():
                total[r["term"]] += r["corpus_count"]
                held[r["term"]] += r["documents"]
        want = [Counter({t: k for t, k in c.items() if words is None or set(t.split()) <= set(words)}) for c in made]
        assert total == sum(want, Counter()) and held == Counter(t for c in want for t in c)
    terms = ["aa", "aa bb cc", "bb cc", "dd dd", "qq aa"]
    found = grams.Finder(terms).find(tokens).to_pylist()
    assert [Counter(f) for f in found] == [Counter({t: c[t] for t in terms if c[t]}) for c in made]


def test_text_columns_are_detected(spark):
    df = spark.createDataFrame([(f"C#{i:012d}", f"some words here {i}", "short", None) for i in range(5)], "id string, prose string, s string, n string")
    assert text_features.detect_text_columns(df, Roles()) == ["prose"]
    assert text_features.detect_text_columns(df, Roles(), mode="sample") == ["prose"]


def test_sentiment_counts_words_on_cleaned_and_marks_on_raw(spark):
    df = text_features.add_cleaned(spark.createDataFrame([("Good, good bad!! what?",), (None,)], "t string"), ["t"])
    first, second = text_features.add_sentiment(df, ["t"]).collect()
    assert (first["t_positive_count"], first["t_negative_count"], first["t_exclamation_count"], first["t_question_count"]) == (1, 0, 2, 1)
    assert second["t_sentiment_ratio"] == 0 and second["t_exclamation_count"] == 0


def test_interactions_divide_only_by_never_zero(spark):
    df = text_features.add_statistics(text_features.add_cleaned(spark.createDataFrame([("a b. c",), ("",)], "t string"), ["t"]), ["t"])
    spec = text_features.fit_interactions(df, ["t"])
    assert spec["nonzero"] == [] and len(spec["pairs"]) == 10


def test_topic_and_component_counts():
    assert [topics.topic_count(n) for n in (49, 50, 500)] == [None, 5, 10]
    assert [topics.component_count(n) for n in (100, 101, 150, 2000)] == [None, 50, 75, 100]
    assert topics.component_count(30, wanted=20) == 20


def test_text_plan_replays_after_a_round_trip(spark):
    words = "apple pear plum fig kiwi lime date nut rice corn".split()
    docs = [(i, " ".join(words[(i * k) % 10] for k in range(1, 9)) + ("!" if i % 2 else "")) for i in range(40)]
    df = spark.createDataFrame(docs, "i int, t string")
    plan, made = fit_text_plan(df, ["t"], max_features=120, components=20)
    assert "t" in plan.topic_models and "t" in plan.bases
    shares = made.select("t_topics").collect()
    assert all(sum(r[0]) == pytest.approx(1.0) for r in shares)
    path = scratch_path(spark, "text-plan")
    plan.save(spark, path)
    back = TextPlan.load(spark, path).transform(df)
    key = ["i", *plan.numeric]
    assert sorted(made.select(*key).collect()) == sorted(back.select(*key).collect())
    first = {r["i"]: r["t_svd"] for r in made.collect()}
    assert all(first[r["i"]] == pytest.approx(r["t_svd"]) for r in back.collect())


def test_cleaning_keeps_the_same_letters_and_mails_by_the_faster_patterns(spark):
    texts = [
        "a@b.c x@@y @@z @ q@ @@ user.name@mail.org, é@ü.de\tn@m\nend@of", "\U0001f600a@b \U0001f600 @x", "Ѐ Џ А я ѐ џ ё Ё ÿ \x7f \x80 ア \U0010ffff", "caf\xe9 na\xefve МОСКВА и ещё",
        "x" * 5_000 + "@" + "y" * 10, "", "\xa0@a b@c", "no mail here: 50 % & more",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    # the patterns as they were
    slow = F.coalesce(F.col("t"), F.lit(""))
    slow = functions.plain_spaces(slow)
    for pattern in (functions.LINK, r"(?<!\S)\S[^\s@]*+@\S+", functions.MENTION_OR_TAG):
        slow = F.regexp_replace(slow, pattern, "")
    slow = F.translate(slow, functions.BLANKED_MARKS, " " * len(functions.BLANKED_MARKS))
    slow = F.regexp_replace(F.regexp_replace(slow, r"[^\x00-\x7fа-яА-Я]+", " "), r"\s+", " ")
    rows = df.select(clean_text(F.col("t")).alias("new"), F.lower(F.trim(slow)).alias("old")).collect()
    assert [r.new for r in rows] == [r.old for r in rows]
    # a negated class beside ranges of other scripts costs Java ten times as much a character
    assert not functions.OTHER_LETTERS.startswith("[^")


def test_statistics_split_a_text_once(spark):
    df = spark.createDataFrame([(0, "One two\xa0two . three"), (1, ""), (2, None), (3, " \x1f ")], "i int, t_cleaned string")
    made = text_features.add_statistics(df, ["t"])
    plain = df.select("i", *[c.alias(f"t_{k}") for k, c in text_statistics(F.col("t_cleaned")).items()])
    assert made.drop("t_cleaned").orderBy("i").collect() == plain.orderBy("i").collect()
    plan = made._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"split\(", plan)) == 1


def test_fitted_text_features_hold_topics_and_all_components(spark, tmp_path):
    draw = random.Random(3)
    words = ["".join(draw.choice("bcdfgklm") + draw.choice("aeiou") for _ in range(3)) for _ in range(150)]
    docs = [(i, " ".join(draw.choices(words[50 * (i % 3) : 50 * (i % 3) + 60], k=30))) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog.text_features_fitted(spark, str(tmp_path))
    shares = [c for c in made.columns if c.startswith("text_topic_")]
    components = [c for c in made.columns if c.startswith("text_svd_")]
    rows = made.collect()
    assert len(rows) == 60 and len(shares) == 10 and 20 <= len(components) <= 100
    assert all(sum(r[c] for c in shares) == pytest.approx(1.0) for r in rows) and len({r[shares[0]] for r in rows}) > 1
    assert all(r["first_component"] == r["text_svd_0"] and r["text_word_count"] == 30 for r in rows)
