"""Toxicity by weak supervision.

1. Candidate terms (words and word beginnings) come from a bounded sample of labelled rows; a greedy cover picks a lexicon.
2. Each lexicon term and some text patterns are voters over every document. Equal vote patterns are counted.
3. A generative model with two classes is fitted to the patterns by EM: for each voter how often it votes in either
   class, and the correlations of voters within a class, by which correlated votes count less.
4. A logistic regression on the candidate terms is trained on the posteriors of a bounded sample, and scores all texts.

Labels are read only in step 1, from the rows given; the score's inputs are the text alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.session import materialize

#: Rows of the labelled sample and of the classifier's sample: those with the smallest hash of their text.
LABELLED_ROWS = 20_000
TRAINING_ROWS = 20_000
CANDIDATES = 2_000
LEXICON = 48
COVERS = 3
ROUNDS = 12
BEGINNINGS = (4, 5, 6)
_WORD = r"\p{L}{3,}"


@dataclass(frozen=True)
class LabelModel:
    """Prior of the toxic class, rates of each voter in the toxic and the clean class, and its weight after correlation."""

    prior: float
    toxic: list[float]
    clean: list[float]
    weight: list[float]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _terms(words: Column) -> Column:
    """The words and their beginnings, marked: ``=word`` and ``beginning``."""
    whole = F.transform(words, lambda w: F.concat(F.lit("="), w))
    return F.array_distinct(F.concat(whole, *[_beginnings(words, n) for n in BEGINNINGS]))


def _longer(n: int):
    return lambda w: F.length(w) > n


def _beginnings(words: Column, n: int) -> Column:
    return F.transform(F.filter(words, _longer(n)), lambda w: F.substring(w, 1, n))


def _smallest(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hash of their text; equal texts once."""
    keyed = rows.withColumn("__h", F.xxhash64("text", F.lit(7)))
    return keyed.groupBy("__h").agg(*[F.min(c).alias(c) for c in rows.columns]).orderBy("__h").limit(limit).drop("__h")


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> DataFrame:
    """text and label of at most ``limit`` rows of docs (doc_id, text) that have a label (doc_id, label).

    Rows are picked by the smallest hash of their text, from ids and hashes alone; only the texts of those picked move.
    """
    docs = docs.select("doc_id", "text")
    keys = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text", F.lit(7)).alias("h"))
    known = labels.filter(F.col("label").isNotNull()).select(F.col("doc_id").cast("long").alias("d"), "label")
    picked = keys.join(known, "d").groupBy("h").agg(F.min(F.struct("d", "label")).alias("r")).orderBy("h").limit(limit)
    picked = materialize(picked.select("h", "r.d", "r.label"), "toxic-picked")
    met = (F.col("doc_id").cast("long") == F.col("d")) & (F.xxhash64("text", F.lit(7)) == F.col("h"))
    return docs.join(F.broadcast(picked), met).select("text", "label")  # limit rows of three numbers


def candidates(labelled: DataFrame) -> tuple[list[str], list[str]]:
    """(candidate terms, lexicon) from rows with text and label (1: toxic).

    A candidate occurs in three toxic rows or more and is at least eight times as frequent there as in clean rows. The lexicon is
    picked greedily: the term found in most toxic rows that are not yet covered ``COVERS`` times.
    """
    rows = labelled.filter(F.col("text").isNotNull() & F.col("label").isNotNull()).select("text", F.col("label").cast("int").alias("label"))
    rows = materialize(_smallest(rows, LABELLED_ROWS).repartition(64).select(F.xxhash64("text").alias("id"), "label", _terms(F.array_distinct(_words(F.col("text")))).alias("terms")), "toxic-labelled")
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return [], []
    counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term")
    counts = counts.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    ratio = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    best = counts.withColumn("ratio", ratio).filter((F.col("t") >= 3) & (F.col("ratio") >= 8))
    best = [r.term for r in best.orderBy(F.desc(F.log("ratio") * F.log1p("t")), "term").limit(CANDIDATES).collect()]
    if not best:
        return [], []
    having = rows.filter("label = 1").select("id", F.array_intersect("terms", F.array(*[F.lit(b) for b in best])).alias("found"))
    found = {r.id: set(r.found) for r in having.collect()}
    # terms of the same rows say the same (a word and its beginning, or the words of one copied text): the first stands for all
    first: dict[frozenset, str] = {}
    for term in best:
        first.setdefault(frozenset(d for d, ts in found.items() if term in ts), term)
    alone = set(first.values())
    return best, _cover({d: ts & alone for d, ts in found.items()}, max(3, toxic // 500))


def _cover(found: dict[int, set[str]], least: int) -> list[str]:
    left = {doc: COVERS for doc, terms in found.items() if terms}
    where: dict[str, set[int]] = {}
    for doc, terms in found.items():
        for t in terms:
            where.setdefault(t, set()).add(doc)
    picked: list[str] = []
    while len(picked) < LEXICON and where:
        gain, term = min(((-sum(d in left for d in docs), t) for t, docs in where.items()))
        if -gain < least:
            break
        picked.append(term)
        for doc in where.pop(term):
            if doc in left:
                left[doc] -= 1
                if left[doc] == 0:
                    del left[doc]
    return picked


def _found(docs: DataFrame, terms: list[str]) -> DataFrame:
    """docs (row, train, hash, text) with ``text`` replaced by what the steps need: the candidate terms in it and some counts."""
    starts = sorted({t.lstrip("=")[:4] for t in terms}) or [""]
    words = F.filter(_words(F.coalesce("text", F.lit(""))), lambda w: F.substring(w, 1, 4).isin(*starts))
    rows = docs.withColumn("words", words)
    few = F.array_distinct("words")
    known = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "row",
        "train",
        "hash",
        F.array_intersect(_terms(few), known).alias("terms"),
        F.length(text).alias("chars"),
        F.regexp_count(text, F.lit(r"!!+")).alias("shouts"),
        F.regexp_count(text, F.lit(r"\b\p{Lu}{3,}\b")).alias("capitals"),
        F.regexp_count(text, F.lit(r"[#*$%]{3}")).alias("masks"),
    )


def _votes(found: DataFrame, lexicon: list[str]) -> DataFrame:
    """``v``: a bit for each voter. Lexicon voters, then patterns: two and four different terms, shouting, capitals, masked words, a short text."""
    own = [F.array_contains("terms", t) for t in lexicon]
    hits = sum([o.cast("int") for o in own], F.lit(0))
    patterns = [hits >= 2, hits >= 4, F.col("shouts") >= 3, F.col("capitals") >= 5, F.col("masks") >= 3, F.col("chars") < 100]
    bits = [F.when(o, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, o in enumerate([*own, *patterns])]
    return found.withColumn("v", sum(bits[1:], bits[0]))


def _bit(k: int) -> Column:
    return F.shiftright("v", k).bitwiseAND(F.lit(1).cast("long")).cast("double")


def _posterior(model: LabelModel) -> Column:
    """P(toxic | votes); a vote and its absence count by the voter's weight."""
    total = F.lit(math.log(model.prior / (1 - model.prior)))
    for k, (t, c, w) in enumerate(zip(model.toxic, model.clean, model.weight, strict=True)):
        absent = w * math.log((1 - t) / (1 - c))
        total = total + F.lit(absent) + _bit(k) * F.lit(w * math.log(t / c) - absent)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), total))))


def fit_label_model(votes: DataFrame, voters: int, lexicon: int) -> LabelModel:
    """EM over the counted vote patterns of all documents; each round is one aggregate of two sums a voter.

    It starts from lexicon voters that speak mostly on toxic documents and patterns that say nothing.
    """
    patterns = materialize(votes.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("n")), "toxic-patterns")
    toxic = [0.2] * lexicon + [0.5, 0.3] + [0.1] * (voters - lexicon - 2)
    clean = [0.002] * lexicon + [0.002, 0.001] + [0.1] * (voters - lexicon - 2)
    model = LabelModel(0.1, toxic, clean, [1.0] * voters)
    share = _posterior(model)
    for _ in range(ROUNDS):
        weighed = patterns.withColumn("p", share)
        sums = [F.sum(F.col("n")), F.sum(F.col("n") * F.col("p"))]
        for k in range(voters):
            sums += [F.sum(F.col("n") * F.col("p") * _bit(k)), F.sum(F.col("n") * (1 - F.col("p")) * _bit(k))]
        n, t, *rest = (x or 0.0 for x in weighed.agg(*sums).first())
        rates = [((rest[2 * k] + 0.1) / (t + 1), (rest[2 * k + 1] + 0.1) / (n - t + 1)) for k in range(voters)]
        fixed = [(min(max(a, 1e-6), 1 - 1e-6), min(max(c, 1e-6), 1 - 1e-6)) for a, c in rates]
        model = LabelModel(min(max((t + 1) / (n + 2), 1e-4), 0.5), [a for a, _ in fixed], [c for _, c in fixed], model.weight)
        share = _posterior(model)
    return LabelModel(model.prior, model.toxic, model.clean, _weights(patterns.withColumn("p", share), model, voters))


def _weights(weighed: DataFrame, model: LabelModel, voters: int) -> list[float]:
    """1 / (1 + the positive correlations with other voters, within the toxic class), for each voter."""
    on = F.filter(F.sequence(F.lit(0), F.lit(voters - 1)), lambda k: F.call_function("shiftright", F.col("v"), k).bitwiseAND(F.lit(1).cast("long")) == 1)
    rows = weighed.select((F.col("n") * F.col("p")).alias("w"), on.alias("on"))
    total = rows.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first().w or 1.0
    pairs = rows.select("w", "on", F.explode("on").alias("i")).select("w", "i", F.explode("on").alias("j")).filter("i < j")
    load = [0.0] * voters
    for r in pairs.groupBy("i", "j").agg(F.sum("w").alias("w")).collect():  # at most voters squared rows
        a, b = model.toxic[r.i], model.toxic[r.j]
        phi = (r.w / total - a * b) / math.sqrt(a * (1 - a) * b * (1 - b))
        load[r.i] += max(0.0, min(1.0, phi))
        load[r.j] += max(0.0, min(1.0, phi))
    return [1 / (1 + x) for x in load]


def score_toxicity(docs: DataFrame, labelled: DataFrame, may_train: Column | None = None) -> DataFrame:
    """Every row of ``docs`` as ``row`` (its columns but text) with ``score``, from 0 to 1; also ``posterior``, of the label model.

    ``labelled`` has text and label, the rows from which labels may be learned. ``may_train`` says which rows of docs the
    classifier may see with their posteriors (all by default). A null or empty text has no terms and gets the score of one.
    Without labelled rows of both classes every score is 0; without rows to train on, the score is the posterior.
    """
    terms, lexicon = candidates(labelled)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    train = F.coalesce(F.lit(True) if may_train is None else may_train, F.lit(False)).alias("train")
    docs = docs.select(row, train, F.xxhash64("text", F.lit(8)).alias("hash"), F.col("text").cast("string").alias("text"))
    if not lexicon:
        return docs.select("row", F.lit(0.0).alias("score"), F.lit(0.0).alias("posterior"))
    voted = materialize(_votes(_found(docs, terms), lexicon), "toxic-votes")
    voters = len(lexicon) + 6
    model = fit_label_model(voted, voters, len(lexicon))
    voted = voted.withColumn("posterior", _posterior(model))
    counts = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="features")
    counts.setBinary(True)
    sample = voted.filter("train").select("hash", "terms", "posterior").orderBy("hash", "posterior").limit(TRAINING_ROWS)
    sample = materialize(sample.repartition(8), "toxic-training")
    if sample.isEmpty():
        return voted.select("row", F.col("posterior").alias("score"), "posterior")
    both = sample.select("terms", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("w")))).alias("x"))
    both = counts.transform(both.select("terms", "x.label", F.col("x.w").alias("w")).filter("w > 0.001"))
    fitted = LogisticRegression(weightCol="w", regParam=2e-5, standardization=False, maxIter=100).fit(both)
    scored = fitted.transform(counts.transform(voted))
    return scored.select("row", vector_to_array("probability")[1].alias("score"), "posterior")
