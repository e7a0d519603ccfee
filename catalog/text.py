"""Queries over the text operators, each with the SQL it must equal."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.common import round_columns, rounded, sql_round, table
from tabweave.functions.wordlists import COMMON_WORDS, EMOTICONS, ENGLISH_STOP_WORDS, NEGATIVE_WORDS, POSITIVE_WORDS
from tabweave.operators import text_features, topics, vectorize
from tabweave.plans.roles import Roles, col
from tabweave.plans.text_plan import TextPlan, fit_text_plan
from tabweave.session import materialize

QUERIES = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


# ---- SQL building blocks

SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def sql_clean(text: str) -> str:
    out = f"coalesce({text}, '')"
    out = _replace(out, f"http[^{SPACE}]+|www[^{SPACE}]+|https[^{SPACE}]+", "")
    out = _replace(out, f"[^{SPACE}]+@[^{SPACE}]+", "")
    out = _replace(out, r"@[\p{L}\p{N}_]+|#[\p{L}\p{N}_]+", "")
    out = _replace(out, f"[^a-zA-Zа-яА-Я0-9{SPACE}.,!?\\-:]", " ")
    out = _replace(out, f"[{SPACE}]+", " ")
    return f"lower(trim({out}))"


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[{SPACE}]+'), lambda w: w <> '')"


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


def _marks(text: str, pattern: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')))"


def sql_statistics(prefix: str, text: str, words: str) -> str:
    count = f"len({words})"

    def share(part: str, whole: str) -> str:
        return sql_round(f"CASE WHEN {whole} > 0 THEN ({part}) / {whole} ELSE 0 END", 6)

    common = f"len(list_filter({words}, lambda w: lower(w) IN {sql_list(COMMON_WORDS)}))"
    letters = f"list_sum(list_transform({words}, lambda w: length(w)))"
    special = r"[!@#$%^&*()_+\-=\[\]{}|;:,.<>?/~`]"
    faces = " + ".join(f"(length({text}) - length(replace({text}, '{e}', ''))) // 2" for e in EMOTICONS)
    return ", ".join(
        [
            f"length({text})::INT AS {prefix}_char_count",
            f"{count}::INT AS {prefix}_word_count",
            f"(CASE WHEN length({text}) > 0 THEN greatest(1, {_marks(text, '[.!?]')}) ELSE 0 END)::INT AS {prefix}_sentence_count",
            f"{share(letters, count)} AS {prefix}_avg_word_length",
            f"{share(f'len(list_distinct({words}))', count)} AS {prefix}_unique_words_ratio",
            f"{share(common, count)} AS {prefix}_stopword_ratio",
            f"{_marks(text, '[0-9]')}::INT AS {prefix}_digit_count",
            f"{share(_marks(text, chr(92) + 'p{Lu}'), f'length({text})')} AS {prefix}_uppercase_ratio",
            f"{share(_marks(text, special), f'length({text})')} AS {prefix}_special_char_ratio",
            f"({faces})::INT AS {prefix}_emoticon_count",
        ]
    )


DOCUMENTS_PER_TASK = 20_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // DOCUMENTS_PER_TASK)), "doc_id")


def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_features.add_cleaned(documents(spark, sf_dir), ["text"])


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned once and read twice: for the vocabulary and for the vectors."""
    return materialize(cleaned_documents(spark, sf_dir).select("doc_id", "text_cleaned"), "cleaned")


CLEAN = f"c AS (SELECT doc_id, text, {sql_clean('text')} AS t FROM documents)"
WORDS = f"w AS (SELECT doc_id, text, t, {sql_words('t')} AS w FROM c)"

# ---- detection, cleaning, statistics

PROSE = f"[{SPACE}]+[a-zA-Zа-яА-Я]+[{SPACE}]+"


def _detect(source: str, name: str) -> str:
    return (
        f"SELECT '{source}' AS table_name, '{name}' AS column_name FROM {source} HAVING "
        f"avg(CASE WHEN length({name}) > 10 THEN regexp_matches(' ' || {name} || ' ', '{PROSE}')::INT END) > 0.3"
    )


TEXT_TABLES = {
    "documents": ["text", "lang", "source"],
    "conversations": ["role", "text"],
    "benchmark": ["text"],
    "customer": ["c_name", "c_mktsegment"],
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
}


@register(" UNION ALL ".join(_detect(t, c) for t, cs in TEXT_TABLES.items() for c in cs))
def detect_text_columns(spark, sf_dir):
    rows = []
    for name in TEXT_TABLES:
        rows += [(name, c) for c in text_features.detect_text_columns(table(spark, sf_dir, name), Roles())]
    return spark.createDataFrame(rows, "table_name string, column_name string")


@register(f"WITH {CLEAN} SELECT doc_id, t AS text_cleaned FROM c")
def clean_text(spark, sf_dir):
    return cleaned_documents(spark, sf_dir).select("doc_id", "text_cleaned")


@register(
    f"SELECT conv_id, turn, {sql_clean('CASE WHEN turn % 3 = 0 THEN NULL ELSE text END')} AS text_cleaned FROM conversations"
)
def clean_text_with_nulls(spark, sf_dir):
    text = F.when(F.col("turn") % 3 != 0, F.col("text")).alias("text")
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", text)
    return text_features.add_cleaned(df, ["text"]).drop("text")


@register(f"WITH {CLEAN}, {WORDS} SELECT doc_id, {sql_statistics('text', 't', 'w')} FROM w")
def text_statistics_cleaned(spark, sf_dir):
    df = text_features.add_statistics(cleaned_documents(spark, sf_dir), ["text"])
    return round_columns(df.drop("text", "text_cleaned"), 6)


@register(f"WITH w AS (SELECT doc_id, text, {sql_words('text')} AS w FROM documents) SELECT doc_id, {sql_statistics('text', 'text', 'w')} FROM w")
def text_statistics_raw(spark, sf_dir):
    df = text_features.add_statistics(documents(spark, sf_dir), ["text"], source="raw")
    return round_columns(df.drop("text"), 6)


def _sentiment(text: str, words: str) -> str:
    p = f"len(list_filter({words}, lambda x: x IN {sql_list(POSITIVE_WORDS)}))"
    n = f"len(list_filter({words}, lambda x: x IN {sql_list(NEGATIVE_WORDS)}))"
    return (
        f"{p}::INT AS text_positive_count, {n}::INT AS text_negative_count, {sql_round(f'({p} - {n}) / ({p} + {n} + 1)', 6)} AS text_sentiment_ratio, "
        f"coalesce({_marks(text, '!')}, 0)::INT AS text_exclamation_count, coalesce({_marks(text, '[?]')}, 0)::INT AS text_question_count"
    )


TURNS = f"c AS (SELECT conv_id, turn, text, {sql_clean('text')} AS t FROM conversations), w AS (SELECT *, {sql_words('t')} AS w FROM c)"


@register(f"WITH {TURNS} SELECT conv_id, turn, {_sentiment('text', 'w')} FROM w")
def sentiment_conversations(spark, sf_dir):
    df = text_features.add_cleaned(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["text"])
    return round_columns(text_features.add_sentiment(df, ["text"]).drop("text", "text_cleaned"), 6)


@register(f"WITH {CLEAN}, {WORDS} SELECT doc_id, {_sentiment('text', 'w')} FROM w")
def sentiment_documents(spark, sf_dir):
    df = text_features.add_sentiment(cleaned_documents(spark, sf_dir), ["text"])
    return round_columns(df.drop("text", "text_cleaned"), 6)


STATS = [f"text_{s}" for s in text_features.INTERACTION_STATISTICS]
STAT_PAIRS = [(a, b) for i, a in enumerate(STATS) for b in STATS[i + 1 :]]


@register(
    f"WITH {CLEAN}, {WORDS}, s AS (SELECT doc_id, {sql_statistics('text', 't', 'w')} FROM w), m AS (SELECT "
    + ", ".join(f"min(abs({c})) AS m_{c}" for c in STATS)
    + " FROM s) SELECT doc_id, "
    + ", ".join(
        f"{sql_round(f'{a}::DOUBLE * {b}', 3)} AS {a}_x_{b}, {sql_round(f'{a} / ({b} + 1e-8)', 3)} AS {a}_div_{b}" for a, b in STAT_PAIRS
    )
    + " FROM s, m"
)
def text_interactions(spark, sf_dir):
    df = round_columns(text_features.add_statistics(cleaned_documents(spark, sf_dir), ["text"]), 6)
    made = text_features.apply_interactions(df, text_features.fit_interactions(df, ["text"]))
    return round_columns(made.select("doc_id", *[c for c in made.columns if "_x_" in c or "_div_" in c]), 3)


# ---- n-grams

VOCABULARY = 500


def sql_terms(source: str, key: str) -> str:
    """Rows (key, term, tf) of 1- to 3-grams after stop words."""
    kept = f"list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN {sql_list(ENGLISH_STOP_WORDS)})"
    return f"""
k AS (SELECT {key}, {kept} AS k FROM {source}),
g AS (SELECT {key}, unnest(k) AS term FROM k
  UNION ALL SELECT {key}, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) FROM k
  UNION ALL SELECT {key}, unnest(list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2])) FROM k),
tf AS (SELECT {key}, term, count(*) AS tf FROM g GROUP BY ALL)"""


TERMS = sql_terms("c", "doc_id")
CHOSEN = f"""
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1
  HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM documents) ORDER BY total DESC, term LIMIT {VOCABULARY}),
h AS (SELECT doc_id, term, tf, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term))"""


def _vocabulary(df: DataFrame, method: str, size: int = VOCABULARY) -> dict:
    return vectorize.fit_vocabulary(df, col("text_cleaned"), size, method)


@register(f"WITH {CLEAN}, {TERMS}, {CHOSEN} SELECT doc_id, term, {sql_round('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 6)} AS weight FROM h")
def tfidf_long(spark, sf_dir):
    df = stored_documents(spark, sf_dir)
    return round_columns(vectorize.long_terms(df, "doc_id", col("text_cleaned"), _vocabulary(df, "tfidf")), 6)


@register(f"WITH {CLEAN}, {TERMS}, {CHOSEN} SELECT doc_id, term, tf::DOUBLE AS weight FROM h")
def count_long(spark, sf_dir):
    df = stored_documents(spark, sf_dir)
    return vectorize.long_terms(df, "doc_id", col("text_cleaned"), _vocabulary(df, "count"))


@register(
    f"WITH {CLEAN}, {TERMS}, {CHOSEN}, c2 AS (SELECT conv_id * 1000 + turn AS turn_id, {sql_clean('text')} AS t FROM conversations), "
    + sql_terms("c2", "turn_id").replace("k AS (", "k2 AS (").replace("FROM k", "FROM k2").replace("g AS (", "g2 AS (").replace("tf AS (SELECT turn_id", "tf2 AS (SELECT turn_id").replace("FROM g GROUP", "FROM g2 GROUP")
    + ", h2 AS (SELECT turn_id, term, tf2.tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf2 JOIN v USING (term)) "
    f"SELECT turn_id, term, {sql_round('w / sqrt(sum(w * w) OVER (PARTITION BY turn_id))', 6)} AS weight FROM h2"
)
def vectorizer_replay(spark, sf_dir):
    spec = _vocabulary(stored_documents(spark, sf_dir), "tfidf")
    df = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    df = text_features.add_cleaned(df, ["text"])
    return round_columns(vectorize.long_terms(df, "turn_id", col("text_cleaned"), spec), 6)


# ---- topics, reduction, the whole text plan


def _vectors(spark, sf_dir, size: int = VOCABULARY) -> tuple[DataFrame, int]:
    df = stored_documents(spark, sf_dir)
    spec = _vocabulary(df, "tfidf", size)
    made = vectorize.add_vectors(df, col("text_cleaned"), spec, "v").select("doc_id", "v")
    return materialize(made, "query-vectors"), len(spec["terms"])


@register()
def topic_shares(spark, sf_dir):
    df, terms = _vectors(spark, sf_dir)
    count = topics.topic_count(terms)
    model = topics.fit_topics(df, "v", count)
    made = topics.add_topics(df, "v", model, "shares").select("doc_id", "shares")
    return round_columns(topics.share_columns(made, "shares", count, "text_topic_"), 6)


@register("SELECT doc_id, 10::INT AS topics, 1::DOUBLE AS total FROM documents")
def topic_share_sums(spark, sf_dir):
    """Every document has a share of each topic, and the shares add up to one."""
    df, terms = _vectors(spark, sf_dir)
    model = topics.fit_topics(df, "v", topics.topic_count(terms))
    made = topics.add_topics(df, "v", model, "shares").select("doc_id", vector_to_array("shares").alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return made.select("doc_id", F.size("s").alias("topics"), rounded(total, 6).alias("total"))


@register(
    f"WITH {CLEAN}, {TERMS}, {CHOSEN}, n AS (SELECT doc_id FROM h GROUP BY 1) "
    f"SELECT (SELECT count(*) FROM v)::INT AS terms, count(*)::DOUBLE AS total_energy, 100::INT AS components FROM n"
)
def svd_energy(spark, sf_dir):
    """Unit rows: all singular values squared add up to the number of documents with a term."""
    df, terms = _vectors(spark, sf_dir)
    _, singular = topics.fit_svd(df, "v", terms, terms)
    kept = topics.component_count(terms)
    return spark.createDataFrame([(terms, round(float((singular**2).sum()), 4), kept)], "terms int, total_energy double, components int")


@register()
def svd_projection(spark, sf_dir):
    df, terms = _vectors(spark, sf_dir)
    count = topics.component_count(terms)
    basis, _ = topics.fit_svd(df, "v", terms, count)
    made = topics.add_projection(df, "v", np.ascontiguousarray(basis), "svd").select("doc_id", "svd")
    return round_columns(topics.share_columns(made, "svd", count, "text_svd_"), 6)


@register()
def text_features_fitted(spark, sf_dir):
    """All text features of the documents, with topics and reduction."""
    plan, made = fit_text_plan(documents(spark, sf_dir), ["text"], max_features=300)
    first = [F.element_at("text_svd", 1).alias("first_component")] if plan.bases else []
    return spread_features(plan, made.select("doc_id", *plan.numeric, *first, *plan.vectors))


def spread_features(plan: TextPlan, made: DataFrame) -> DataFrame:
    """Topic shares and components of a text plan over numbered columns."""
    for c in plan.columns:
        if c in plan.topic_models:
            made = topics.share_columns(made, f"{c}_topics", plan.topic_models[c].getK(), f"{c}_topic_")
        if c in plan.bases:
            made = topics.share_columns(made, f"{c}_svd", plan.bases[c].shape[1], f"{c}_svd_")
    return made
