"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks of about ``block_words`` words. A source's target gives the
exact number of its blocks that the mix takes: whole rounds over the source, then blocks in order of their number,
the last one cut at the word that meets the target. A tree over the output shards then splits the counts of all
sources: at each node a multivariate hypergeometric draw decides how many blocks of each source go to its left half,
whose size is fixed. A shard's counts name disjoint stretches of the source's permuted blocks, and the documents of a
shard are shuffled inside it.

All draws follow from the seed and from values, never from how rows are partitioned, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.folds import numbered
from tabweave.session import materialize, scratch_path

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
BLOCK_WORDS = 65_536
SHARDS = 16
SEED = 3
#: Words of a shard that one task sorts.
TASK_WORDS = 8_000_000
#: More blocks than this in all make the blocks larger: the draw works on counts below 10 ** 9.
MOST_BLOCKS = 1 << 28
#: Rows of a table of sources or blocks that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 400_000
_PRIME = 2_147_483_647


@dataclass(frozen=True)
class Mix:
    """``sizes``: every row with size, source_size, target and taken. ``parts``: what each shard holds, in order.

    ``sources`` (with their number of blocks), ``placed`` (a row each time a block is taken) and ``partial`` (the rows of blocks that a target
    cuts) say the same of documents by their blocks, without a row for each.
    """

    sizes: DataFrame
    parts: DataFrame
    sources: DataFrame
    placed: DataFrame
    partial: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weighted(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights by the rank of the source by code point, null last, repeating."""
    named = sources.withColumn("__order", F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))))
    ranked = numbered(named, "__order", ranges=max(1, sources.count() // 1_000_000 + 1))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__row") - 1) % len(weights) + 1).cast("int"))
    return ranked.select("source", "source_size", pick.alias("weight"))


def _alike(*key: str) -> Window:
    """Rows of equal key; they are the same in all that counts, so their order is free."""
    return Window.partitionBy(*key).orderBy(F.lit(0))


def _deals(words: int, shards: int) -> int:
    return max(1, -(-words // (shards * TASK_WORDS)))


def _targets(sources: DataFrame, most_times: int) -> DataFrame:
    """Shares of all words by weight; a source's target stops at ``most_times`` its size and the excess is shared again.

    Each round is one aggregate over the sources. The level (words for each unit of weight) only rises, and a source
    that has stopped stays stopped, so the rounds end when no further source stops.
    """
    limit = F.col("source_size") * F.lit(most_times)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    level, stopped = 0.0, -1
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        got = sources.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.coalesce(F.sum(full.cast("long")), F.lit(0)).alias("stopped"),
        ).first()
        if got.stopped == stopped or got.open == 0:
            break
        stopped, level = got.stopped, (total - got.given) / got.open
    target = F.least(F.col("weight") * F.lit(level), limit.cast("double"))
    return sources.withColumn("target", target)


def _split(low: int, high: int, total: int, shards: int) -> tuple[int, int]:
    """Middle shard of a node and how many blocks its left half gets; shard k holds floor or ceiling of the mean."""
    middle = (low + high) // 2
    return middle, middle * total // shards - low * total // shards


def _tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """source_key, shard, n: blocks of each source in each shard. One level of the tree is one grouped step.

    A group holds one row a source. Only nodes of two and more shards are drawn; a node's random numbers depend on the
    seed and its bounds.
    """
    total = int(quotas.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n)
    kinds = "source_key long, low int, high int, n long"

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = (int(x) for x in key)
        rows = rows.sort_values("source_key")
        middle, left = _split(low, high, total, shards)
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        have = rows["n"].to_numpy(np.int64)
        got = rng.multivariate_hypergeometric(have, left, method="marginals")
        parts = [rows.assign(low=low, high=middle, n=got), rows.assign(low=middle, high=high, n=have - got)]
        out = pd.concat(parts)[["source_key", "low", "high", "n"]]
        return out[out["n"] > 0]

    nodes = quotas.select("source_key", F.lit(0).alias("low"), F.lit(shards).alias("high"), "n").filter("n > 0")
    done = None
    while shards > 1:
        leaves = nodes.filter("high - low = 1")
        done = leaves if done is None else done.unionByName(leaves)
        wide = nodes.filter("high - low > 1")
        nodes = materialize(wide.groupBy("low", "high").applyInPandas(draw, kinds), "mix-tree")
        if nodes.agg(F.max(F.col("high") - F.col("low")).alias("w")).first().w in (None, 1):
            break
    leaves = nodes if done is None else done.unionByName(nodes)
    return leaves.select("source_key", F.col("low").alias("shard"), "n")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most_times: int = MOST_TIMES,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> Mix:
    """Mix ``docs`` (doc_id, source, text): shares of all words by the sources' weights.

    ``sizes`` has a row for each row of ``docs``: doc_id, text_hash, source, size, source_size, target (of its source) and taken
    (words of it in the mix, repeats counted, summed from the shards as written). ``parts`` has a row for each time the mix takes a
    document: shard, position, doc_id, text_hash, source, nth (among rows that repeat these), copy and words (less than its size where
    the target cuts it); each shard is a folder of files in the order of :func:`shard_order`. A text without words has size
    0 and is never taken; a null source is a source, last in order. Rows that repeat id and text are documents of their
    own, in the same block. Other columns are ignored. A table without rows gives none.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        word_count(F.col("text").cast("string")).alias("size"),
    )
    sized = sized.withColumn("source_key", F.xxhash64("source", F.col("source").isNull()))
    sized = sized.withColumn("nth", F.row_number().over(_alike("doc_id", "text_hash", "source_key")))
    sized = materialize(sized.withColumn("deal", F.xxhash64("doc_id", "text_hash", F.lit(seed))), "mix-sizes")
    totals = sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    sources = materialize(totals, "mix-sources")
    sources = materialize(
        _targets(_weighted(sources, weights), most_times).withColumn("source_key", F.xxhash64("source", F.col("source").isNull())), "mix-targets"
    )
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    block_words = max(block_words, -(-(words * most_times) // MOST_BLOCKS))
    whole = F.floor(F.round("target") / F.greatest("source_size", F.lit(1)))
    sources = sources.select(
        "*",
        F.ceil(F.col("source_size") / block_words).alias("blocks"),
        whole.alias("rounds"),
        (F.round("target").cast("long") - whole * F.col("source_size")).alias("rest"),
    )
    # blocks: how many words each holds, and those before it in its source; one row for each block
    keyed = sized.filter("size > 0").join(sources.select("source_key", "blocks"), "source_key")
    keyed = materialize(keyed.withColumn("block", F.pmod(F.col("deal"), F.col("blocks"))).drop("blocks"), "mix-blocks")
    filled = keyed.groupBy("source_key", "block").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source_key").orderBy("block")
    filled = filled.withColumn("before", F.sum("words").over(order) - F.col("words")).withColumn("at", F.row_number().over(order) - 1)
    filled = filled.join(sources.select("source_key", "rounds", "rest"), "source_key")
    filled = materialize(filled.withColumn("room", F.col("rest") - F.col("before")), "mix-filled")
    # the block that the target cuts: word offsets inside it; it holds about block_words words, so a window over it is small
    cut = filled.filter("room > 0 AND room < words").select("source_key", "block", "room")
    inside = Window.partitionBy("source_key", "block").orderBy("deal", "doc_id", "text_hash", "nth")
    partial = keyed.join(cut, ["source_key", "block"]).withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    partial = partial.withColumn("words", F.least("size", F.greatest(F.lit(0).cast("long"), F.col("room") - F.coalesce("before", F.lit(0)))))
    # a taken block for each round, and one more where the rest reaches it
    taken = filled.select("source_key", "block", "at", "words", "room", (F.col("rounds") + (F.col("room") > 0).cast("long")).cast("int").alias("times"), "rounds")
    quotas = taken.groupBy("source_key").agg(F.sum("times").alias("n"), F.max("at").alias("last"))
    quotas = materialize(quotas.filter("n > 0"), "mix-quotas")
    leaves = _tree(quotas.select("source_key", "n"), shards, seed)
    # slots of the permuted blocks: shard k of a source holds the next n slots; slots are as many as blocks
    stretch = Window.partitionBy("source_key").orderBy("shard")
    slots = leaves.withColumn("to", F.sum("n").over(stretch)).withColumn("slot", F.explode(F.sequence(F.col("to") - F.col("n"), F.col("to") - 1)))
    copies = taken.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    number = (F.col("copy") - 1).cast("long") * (F.col("last") + 1) + F.col("at")
    copies = copies.join(quotas, "source_key").withColumn("slot", (number * F.lit(_PRIME).cast("long") + F.pmod("source_key", F.lit(1 << 30))) % F.col("n"))
    placed = copies.select("source_key", "block", "copy", "slot", ((F.col("copy") > F.col("rounds")) & (F.col("room") < F.col("words"))).alias("is_cut"))
    placed = materialize(placed.join(slots.select("source_key", "slot", "shard"), ["source_key", "slot"]), "mix-placed")
    return _assembled(sized, sources, keyed, partial, placed, seed, shards, _deals(words, shards))


def _assembled(sized: DataFrame, sources: DataFrame, keyed: DataFrame, partial: DataFrame, placed: DataFrame, seed: int, shards: int, deals: int) -> Mix:
    key = ["source_key", "block"]
    full = keyed.join(placed.filter("NOT is_cut"), key).withColumn("words", F.col("size"))
    some = partial.filter("words > 0").join(placed.filter("is_cut"), key)
    columns = ["shard", "doc_id", "text_hash", "source", "copy", "words", "deal", "nth"]
    parts = full.select(*columns).unionByName(some.select(*columns))
    parts = parts.withColumn("position", F.xxhash64("deal", "copy", F.lit(seed))).drop("deal")
    parts = _written(parts, shards, deals)
    # what the shards hold says what each row gives
    key = [F.col(c) for c in ("doc_id", "text_hash", "source", "nth")]
    held = parts.groupBy(*key).agg(F.sum("words").alias("taken")).select(*[c.alias(f"p_{k}") for k, c in enumerate(key)], "taken")
    same = [c.eqNullSafe(held[f"p_{k}"]) for k, c in enumerate(key)]
    rows = sized.join(held, same, "left").select("doc_id", "text_hash", "source_key", "size", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    about = sources.select("source_key", "source", "source_size", "target")
    sizes = rows.join(about, "source_key").select("doc_id", "text_hash", "source", "size", "source_size", "target", "taken")
    return Mix(sizes, parts, sources, placed, partial)


def in_order(parts: DataFrame, shards: int, deals: int) -> DataFrame:
    """Rows of shards (shard, position, doc_id, copy, nth) in ``shards * deals`` partitions, which hold the shards one after the other, each in its order.

    Positions are hashes, so equal stretches of them hold about equally many rows.
    """
    stretch = F.floor((F.shiftright("position", 32) + (1 << 31)) * deals / (1 << 32))
    dealt = parts.repartitionById(shards * deals, (F.col("shard") * deals + stretch).cast("int"))
    return dealt.sortWithinPartitions("shard", *shard_order())


def _written(parts: DataFrame, shards: int, deals: int) -> DataFrame:
    """``parts`` written to a folder for each shard, in order, and read back."""
    path = scratch_path(parts.sparkSession, "mix-shards")
    in_order(parts, shards, deals).write.partitionBy("shard").parquet(path)
    return parts.sparkSession.read.schema(parts.schema).parquet(path)


def shard_order() -> list[Column]:
    """How the rows of a shard lie: a shuffle by hash, ties by id, copy and number among equal rows."""
    return [F.col("position"), F.col("doc_id"), F.col("copy"), F.col("nth")]


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its word number ``words``."""
    found = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(found, F.lit(1), words.cast("int")), "")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, one row for each time the mix takes one, cut where the target cuts it.

    They lie in the order of the shards, and inside a shard in its order. A document finds its block by its own values, and its block's places
    in the mix in a small table, so texts move once, to their shard. Only in blocks that a target cuts are rows told apart that repeat id,
    text and source.
    """
    seed, shards = options.get("seed", SEED), options.get("shards", SHARDS)
    made = mix(docs, **options)
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(
        row, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.xxhash64(source, source.isNull()).alias("source_key"), word_count(text).alias("size")
    )
    keyed = keyed.filter("size > 0").withColumn("deal", F.xxhash64("doc_id", "text_hash", F.lit(seed)))
    keyed = keyed.join(_small(materialize(made.sources.select("source_key", "blocks"), "mix-block-numbers")), "source_key")
    keyed = keyed.withColumn("block", F.pmod(F.col("deal"), F.col("blocks")))
    key = ["source_key", "block"]
    rows = keyed.join(_small(made.placed), key)
    out = ["row", "shard", "copy", "deal", "doc_id"]
    whole = rows.filter("NOT is_cut").select(*out, F.lit(1).alias("nth"))
    partial = materialize(made.partial.filter("words > 0").select("doc_id", "text_hash", "source_key", "nth", "words"), "mix-partial")
    partial = partial.select(*[F.col(c).alias(f"p_{c}") for c in partial.columns])
    cut = rows.filter("is_cut").withColumn("nth", F.row_number().over(_alike("doc_id", "text_hash", "source_key")))
    met = F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("text_hash") == F.col("p_text_hash")) & (F.col("source_key") == F.col("p_source_key")) & (F.col("nth") == F.col("p_nth"))
    short = F.when(F.col("p_words") < F.col("size"), first_words(F.col("row")["text"].cast("string"), F.col("p_words"))).otherwise(F.col("row")["text"])
    cut = cut.join(partial, met).withColumn("row", F.col("row").withField("text", short)).select(*out, "nth")
    every = whole.unionByName(cut).withColumn("position", F.xxhash64("deal", "copy", F.lit(seed)))
    words = made.sizes.agg(F.coalesce(F.sum("taken"), F.lit(0)).alias("n")).first().n
    return in_order(every, shards, _deals(words, shards)).select("row.*")
