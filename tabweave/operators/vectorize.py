"""N-gram counts and TF-IDF as sparse vectors or as long rows."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.grams import Finder, count_grams
from tabweave.functions.text import ngrams, term_counts, tokens
from tabweave.functions.wordlists import ENGLISH_STOP_WORDS
from tabweave.plans.roles import col

MIN_DOCUMENTS = 2
MAX_DOCUMENT_SHARE = 0.95
SIZES = (1, 3)
SCREEN_WORDS = 20_000


def kept_tokens(text: Column, stop_words: tuple[str, ...]) -> Column:
    """Tokens of a text without its stop words."""
    found = tokens(text)
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def vocabulary_grams(text: Column, spec: dict) -> Column:
    """The n-grams of a text, after its stop words are gone, that are made of words of the vocabulary's terms; null in place of others."""
    words = sorted({w for t in spec["terms"] for w in t.split(" ")})
    known = F.transform(kept_tokens(text, tuple(spec["stop_words"])), lambda w: F.when(w.isin(*words), w))
    return ngrams(known, tuple(spec["sizes"]))


def found_terms(text: Column, spec: dict) -> Column:
    """The n-grams of a text, after its stop words are gone, that are terms of the vocabulary, as often as it holds them."""
    finder = Finder(spec["terms"])

    @F.arrow_udf("array<string>")
    def found(batch: pa.Array) -> pa.Array:
        return finder.find(batch)

    return found(kept_tokens(text, tuple(spec["stop_words"])))


def term_statistics(df: DataFrame, sizes: tuple[int, int], words: list[str] | None = None) -> DataFrame:
    """``(term, corpus_count, documents)`` of the n-grams of the column ``tokens``; with ``words``, of those made of them.

    Repeats are folded inside each batch of rows before the shuffle.
    """

    def counted(batches):
        known = None if words is None else pa.array(words, "string")
        for batch in batches:
            yield from count_grams(batch.column(0), sizes, known)

    made = df.select("tokens").mapInArrow(counted, "term string, corpus_count long, documents long")
    return made.groupBy("term").agg(F.sum("corpus_count").alias("corpus_count"), F.sum("documents").alias("documents"))


def _ranked(statistics: DataFrame, limit: int) -> list:
    return statistics.orderBy(F.col("corpus_count").desc(), "term").limit(limit).collect()


def screening_words(rows: list, max_features: int, most_documents: float, complete: bool) -> list[str] | None:
    """Words that a term of the vocabulary may hold, from words ranked by count.

    An n-gram is never more frequent than its words. Once ``max_features`` single words qualify,
    nothing below the last one's count can enter, so neither can an n-gram that holds a rarer
    word. ``None`` when the ranked words do not reach down to that count.
    """
    fit = [r for r in rows if MIN_DOCUMENTS <= r["documents"] <= most_documents]
    floor = fit[max_features - 1]["corpus_count"] if len(fit) >= max_features else MIN_DOCUMENTS
    if not complete and rows[-1]["corpus_count"] >= floor:
        return None
    return [r["term"] for r in rows if r["corpus_count"] >= floor]


def fit_vocabulary(
    df: DataFrame,
    text: Column,
    max_features: int,
    method: str = "tfidf",
    stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS,
    sizes: tuple[int, int] = SIZES,
    screen: int = SCREEN_WORDS,
) -> dict:
    """Terms in at least 2 and at most 95 % of the documents, the ``max_features`` most used.

    Ties at the cap go to the smaller term. Single words are counted first: n-grams with a word
    too rare for the cap are then never made, which keeps the n-gram shuffle near the size of the
    vocabulary. Only ranked words and the chosen terms reach the driver.
    """
    if method not in ("tfidf", "count"):
        raise ValueError(f"unknown method '{method}'")
    total = df.count()
    most = MAX_DOCUMENT_SHARE * total
    tokenized = df.select(kept_tokens(text, stop_words).alias("tokens"))
    words = None
    if sizes[0] == 1 and sizes[1] > 1:
        rows = _ranked(term_statistics(tokenized, (1, 1)), screen + 1)
        words = screening_words(rows[:screen], max_features, most, len(rows) <= screen) if rows else []
    counted = term_statistics(tokenized, sizes, words)
    chosen = _ranked(counted.where(F.col("documents").between(MIN_DOCUMENTS, most)), max_features)
    chosen.sort(key=lambda r: r["term"])
    return {
        "op": "vectorize",
        "method": method,
        "terms": [r["term"] for r in chosen],
        "idf": [math.log((1 + total) / (1 + r["documents"])) + 1 for r in chosen],
        "stop_words": list(stop_words),
        "sizes": list(sizes),
    }


def add_vectors(df: DataFrame, text: Column, spec: dict, output: str) -> DataFrame:
    """Add one sparse vector per row: counts, or unit-length TF-IDF weights."""
    kept = df.columns
    out = df.select("*", found_terms(text, spec).alias("__terms"))
    counts = CountVectorizerModel.from_vocabulary(spec["terms"], inputCol="__terms", outputCol="__counts")
    out = counts.transform(out)
    if spec["method"] == "tfidf":
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(spec["idf"]), inputCol="__counts", outputCol="__weights")
        out = Normalizer(p=2.0, inputCol="__weights", outputCol=output).transform(weigh.transform(out))
    else:
        out = out.withColumnRenamed("__counts", output)
    return out.select(*[col(c) for c in kept], output)


def long_terms(df: DataFrame, key: str, text: Column, spec: dict) -> DataFrame:
    """``(key, term, weight)`` rows for the terms of the vocabulary.

    Only n-grams of the vocabulary's words are made, on the JVM; the vocabulary, at most ``max_features`` rows, is broadcast. TF-IDF shuffles the found
    terms once, for the length of each row's vector.
    """
    vocabulary = df.sparkSession.createDataFrame(list(zip(spec["terms"], spec["idf"])), "term string, idf double")
    rows = df.select(col(key), F.monotonically_increasing_id().alias("__row"), vocabulary_grams(text, spec).alias("__terms"))
    counted = rows.select(col(key), "__row", F.inline(term_counts(F.col("__terms"))))
    found = counted.join(F.broadcast(vocabulary), "term")
    if spec["method"] != "tfidf":
        return found.select(col(key), "term", F.col("tf").cast("double").alias("weight"))
    weighed = found.withColumn("__w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy("__row")))
    return weighed.select(col(key), "term", (F.col("__w") / length).alias("weight"))
