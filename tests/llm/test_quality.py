import math
import re
from collections import Counter

import pytest

from tabweave.llm import quality as q


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    again = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def test_base_columns_equal_brute_force(spark, docs):
    more = spark.createDataFrame(
        [(20, "a b c a b c a b", "en"), (21, "x x x x", "en"), (22, "l\nl\n\n \nl\n", "en"), (23, "a b c d a b c e a b c", None), (24, " ".join(f"t{k % 40}" for k in range(300)), "de")],
        "doc_id long, text string, lang string",
    )
    rows = docs.unionByName(more, allowMissingColumns=True)
    got = sorted(((r.row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.quality(rows).collect()), key=repr)
    assert got == sorted(((r.doc_id, *base(r.text)) for r in rows.collect()), key=repr)


def test_a_long_text_has_no_false_repeats(spark):
    words = [f"{k:x}" for k in range((1 << 20) + 20_000)]
    words[700_000:700_004] = words[10:14]
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    assert q.judged(docs, {}).first().n_repeat_words == base(text)[4] == 8


def distance(p, r):
    p = [x / sum(p) for x in p]
    return math.sqrt(sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, r)) / 2)


def test_distances_and_references(spark):
    good = "The men of the town went to a hill and it was for the best that they are with us as was said by the mayor. "
    rows = [(k, good * 3 + f"note {k} ends here", "en") for k in range(9)] + [(10, "#### $$$$ %%%% &&&& **** " * 40, "en"), (11, "GO!! ON!! NOW!! " * 50, "en"), (12, good * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = q.references(docs)
    assert set(known) == {"en"} and all(sum(p) == pytest.approx(1) for p in known["en"])
    got = {r.row.doc_id: r for r in q.judged(docs, known).collect()}
    for doc, text, _ in rows:
        low, up = len(re.findall("[a-z]", text)), len(re.findall("[A-Z]", text))
        num, space, mark, symbol = (len(re.findall(p, text)) for p in (r"[0-9]", r"[ \n]", r"""[.,;:!?'"()\-]""", r"[#*$%&|<>]"))
        assert got[doc].class_distance == pytest.approx(distance([low, up, num, space, mark, symbol, 0], known["en"][0]), abs=1e-9)
        words = [w.lower() for w in re.findall(r"\S+", text)]
        if len(words) >= q.LEAST_WORDS:
            common = [words.count(c) for c in q.COMMON["en"]]
            assert got[doc].word_distance == pytest.approx(distance([*common, len(words) - sum(common)], known["en"][1]), abs=1e-9)
    assert got[10].class_distance > q.MOST_CLASS_DISTANCE and not got[10].kept and not got[11].kept


def test_a_language_without_common_words_is_compared_by_its_characters(spark):
    prose = "Il vecchio pescatore guardava il mare dalla finestra della sua casa e pensava che domani avrebbe trovato ancora molti pesci vicino alla costa. "
    english = "The men of the town went to a hill and it was for the best that they are with us as was said by the mayor. "
    rows = [(k, prose * 6 + f"nota {k}", "it") for k in range(5)] + [(10 + k, english * 6 + f"note {k}", "en") for k in range(5)]
    rows += [(20, "#### $$$$ %%%% &&&& **** " * 40, "it"), (21, english * 6, "en-US"), (22, english * 6, "?"), (23, prose * 6, "IT_it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = q.references(docs)
    assert set(known) == {"en", "it"} and known["it"][1] == []
    got = {r.row.doc_id: r for r in q.judged(docs, known).collect()}
    assert all(got[k].word_distance is None and got[k].class_distance < 0.1 for k in (*range(5), 23))
    assert got[20].class_distance > q.MOST_CLASS_DISTANCE and got[20].word_distance is None
    assert all(got[k].word_distance is not None and got[k].word_distance < q.MOST_WORD_DISTANCE for k in (10, 21, 22))


def test_stage_and_empty_table(docs, none):
    kept = q.good_documents(docs)
    assert kept.columns == docs.columns
    assert q.quality(none).count() == 0
