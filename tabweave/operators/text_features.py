"""Text columns: detection, cleaning, statistics, sentiment and their interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.text import PROSE_WORD, bind, clean_text, count_marks, plain_spaces, text_statistics, words
from tabweave.functions.wordlists import NEGATIVE_WORDS, POSITIVE_WORDS
from tabweave.operators.numeric import product, ratio
from tabweave.plans.roles import Roles, col, string_columns

LONGER_THAN = 10
PROSE_SHARE = 0.3
SAMPLE_ROWS = 100
SAMPLE_SEED = 42
INTERACTION_STATISTICS = ("char_count", "word_count", "sentence_count", "avg_word_length", "unique_words_ratio")


def prose_shares(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Share of the longer values that hold a word between spaces, per column, in one scan."""
    aggs = []
    for i, c in enumerate(columns):
        hit = F.concat(F.lit(" "), plain_spaces(col(c)), F.lit(" ")).rlike(PROSE_WORD).cast("double")
        aggs.append(F.avg(F.when(F.length(col(c)) > LONGER_THAN, hit)).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    return {c: row[f"s{i}"] for i, c in enumerate(columns)}


def detect_text_columns(df: DataFrame, roles: Roles, mode: str = "full") -> list[str]:
    """String columns that read like prose.

    ``full`` looks at every value. ``sample`` looks at about 100 random rows, as a quick guess.
    """
    columns = string_columns(df, roles.features(df))
    if not columns:
        return []
    if mode == "sample":
        rows = df.count()
        if rows > SAMPLE_ROWS:
            df = df.sample(min(1.0, 2 * SAMPLE_ROWS / rows), seed=SAMPLE_SEED)
    elif mode != "full":
        raise ValueError(f"unknown mode '{mode}'")
    return [c for c, share in prose_shares(df, columns).items() if share is not None and share > PROSE_SHARE]


def add_cleaned(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[clean_text(col(c)).alias(f"{c}_cleaned") for c in columns])


def statistics_struct(c: Column) -> Column:
    """The text statistics as one struct, with the text and its words computed once."""

    def packed(t: Column, parts: Column, count: Column) -> Column:
        return F.struct(*[e.alias(k) for k, e in text_statistics(t, parts, count).items()])

    return bind(F.coalesce(c, F.lit("")), lambda t: bind(words(t), lambda w: bind(F.size(w), lambda n: packed(t, w, n))))


def add_statistics(df: DataFrame, columns: list[str], source: str = "cleaned") -> DataFrame:
    """``{c}_char_count`` and so on, over the cleaned or the raw text."""
    if source not in ("cleaned", "raw"):
        raise ValueError("source is 'cleaned' or 'raw'")
    names = list(text_statistics(F.lit("")))
    packed, out = [], []
    for c in columns:
        text = col(f"{c}_cleaned") if source == "cleaned" else col(c)
        packed.append(statistics_struct(text).alias(f"__{c}_stats"))
        out += [F.col(f"`__{c}_stats`")[name].alias(f"{c}_{name}") for name in names]
    return df.select("*", *packed).select(*[col(c) for c in df.columns], *out)


def sentiment(cleaned: Column, raw: Column) -> dict[str, Column]:
    """Word-list counts on the cleaned text, mark counts on the raw one."""
    positive = F.size(F.filter(words(cleaned), lambda w: w.isin(*POSITIVE_WORDS)))
    negative = F.size(F.filter(words(cleaned), lambda w: w.isin(*NEGATIVE_WORDS)))
    return {
        "positive_count": positive,
        "negative_count": negative,
        "sentiment_ratio": (positive - negative) / (positive + negative + 1),
        "exclamation_count": F.coalesce(count_marks(raw, "!"), F.lit(0)),
        "question_count": F.coalesce(count_marks(raw, "?"), F.lit(0)),
    }


def add_sentiment(df: DataFrame, columns: list[str]) -> DataFrame:
    out = []
    for c in columns:
        out += [e.alias(f"{c}_{k}") for k, e in sentiment(col(f"{c}_cleaned"), col(c)).items()]
    return df.select("*", *out)


def fit_interactions(df: DataFrame, columns: list[str]) -> dict:
    """Pairs of text statistics; a ratio only where the divisor is never 0."""
    stats = [f"{c}_{s}" for c in columns for s in INTERACTION_STATISTICS]
    pairs = [(a, b) for i, a in enumerate(stats) for b in stats[i + 1 :]]
    if not pairs:
        return {"op": "text_interactions", "pairs": [], "nonzero": []}
    row = df.agg(*[F.min(F.abs(col(s))).alias(f"m{i}") for i, s in enumerate(stats)]).first()
    nonzero = [s for i, s in enumerate(stats) if row[f"m{i}"] is not None and row[f"m{i}"] > 0]
    return {"op": "text_interactions", "pairs": pairs, "nonzero": nonzero}


def apply_interactions(df: DataFrame, spec: dict) -> DataFrame:
    out = []
    for a, b in spec["pairs"]:
        out.append(product(a, b))
        if b in spec["nonzero"]:
            out.append(ratio(a, b))
    return df.select("*", *out)
