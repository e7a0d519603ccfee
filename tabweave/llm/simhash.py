"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

A table keeps the bits of one mask. The masks come from parities: bit i gets a vector of radius + 1 bits, and mask v (not 0) has the bits
whose vector has an odd number of ones in common with v. The vectors of at most ``radius`` differing bits never span the whole
space, so some v is orthogonal to all of them: its mask has none of these bits, and both fingerprints meet in its table. With radius 3
there are 15 tables of some 34 bits each.

A crowded bucket is split by 15 more masks over the bits that its table leaves out, with the same guarantee inside the bucket. What is
left then is some 14 open bits, so at most 2^14 different fingerprints, however many documents there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import small_batches, stored
from tabweave.llm.components import components
from tabweave.session import materialize

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 3
#: Fingerprints of a bucket above which it is split once more.
CROWDED = 1_000
BROADCAST_BUCKETS = 400_000
#: Each node becomes a row for each mask.
NODES_PER_TASK = 50_000
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end between words."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _bit_counts(words: list[bytes]) -> np.ndarray:
    """How often each bit, highest first, is set in the hashes of the shingles of at least three words."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -SHINGLE].tolist()]
    shingles = [joined[a : b - 1] for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
    hashes = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    return np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text in UTF-8: a bit is set if more than half of the shingle hashes have it."""
    counts, n, words = np.zeros(BITS, np.int64), 0, []
    for piece in _pieces(text):
        words += piece.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
        if len(words) >= SHINGLE:
            counts += _bit_counts(words)
            n += len(words) - SHINGLE + 1
            words = words[1 - SHINGLE :]
    if not n and words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (64 bits as a long) of every row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            prints = np.array([fingerprint(t.as_py() or b"") for t in part.column("text")], np.uint64)
            yield pa.record_batch([part.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fingerprint"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def covering_masks(places: list[int], radius: int) -> list[int]:
    """Masks over bit ``places``, such that any ``radius`` of these places are all outside one of them."""
    vectors = {p: k % ((2 << radius) - 1) + 1 for k, p in enumerate(places)}
    return [sum(1 << p for p, m in vectors.items() if (m & v).bit_count() % 2) for v in range(1, 2 << radius)]


def _long(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _kept(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(_long(mask)).cast("long"))


def _buckets(nodes: DataFrame, radius: int) -> DataFrame:
    """One row for each bucket of more than one node: ``nodes``, an array of (none, doc, bits)."""
    masks = covering_masks(list(range(BITS)), radius)
    tables = F.array(*[F.struct(F.lit(t).alias("at"), _kept(F.col("bits"), m).alias("key")) for t, m in enumerate(masks)])
    rows = nodes.select("none", "doc", "bits", F.inline(tables))
    crowded = rows.groupBy("at", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED).drop("n")
    crowded = stored(crowded, "simhash-crowded")
    n = crowded.count()
    if n:
        small = F.broadcast(crowded) if n <= BROADCAST_BUCKETS else crowded
        finer = []
        for t, m in enumerate(masks):
            open_places = [p for p in range(BITS) if not m >> p & 1]
            more = covering_masks(open_places, radius)
            one = [F.struct(F.lit((t + 1) * 1000 + u).alias("at"), _kept(F.col("bits"), m | x).alias("key")) for u, x in enumerate(more)]
            finer.append((t, F.array(*one)))
        split = None
        for t, one in finer:
            split = F.when(F.col("at") == t, one) if split is None else split.when(F.col("at") == t, one)
        hot = rows.join(small, ["at", "key"], "left_semi").select("none", "doc", "bits", split.alias("finer"))
        rows = rows.join(small, ["at", "key"], "left_anti").select("none", "doc", "bits", "at", "key")
        rows = rows.unionByName(hot.select("none", "doc", "bits", F.inline("finer")))
    # at most CROWDED nodes, or all settings of the bits that two masks leave open
    held = rows.groupBy("at", "key").agg(F.collect_list(F.struct("none", "doc", "bits")).alias("nodes"))
    return held.filter(F.size("nodes") > 1).select("nodes")


def forest(bits: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the place of the first one that links lead to."""
    root = np.full(len(bits), -1)
    left = np.arange(len(bits))
    while len(left):
        first, left = left[0], left[1:]
        root[first] = first
        open_ = [first]
        while open_ and len(left):
            near = np.bitwise_count(bits[left] ^ bits[open_.pop()]) <= radius
            if near.any():
                root[left[near]] = first
                open_ += left[near].tolist()
                left = left[~near]
    return root


_NODE = "struct<none: boolean, doc: bigint, bits: bigint>"


def near_fingerprints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between ``nodes`` (none, doc, bits; no bits twice) that join just those within reach of each other.

    Two nodes are in one component of these links if and only if they are in one component of all pairs that differ in at most
    ``radius`` bits. A bucket gives fewer links than it has nodes.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column("nodes")
            flat = lists.flatten()
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()]).tolist()
            none, doc, bits = (flat.field(k) for k in range(3))
            order_by = doc.fill_null(0).to_numpy(zero_copy_only=False), none.to_numpy(zero_copy_only=False)
            raw = bits.to_numpy().view(np.uint64)
            a, b = [], []
            for start, end in zip(ends, ends[1:]):
                order = start + np.lexsort((raw[start:end], order_by[0][start:end], order_by[1][start:end]))
                root = forest(raw[order], radius)
                linked = np.flatnonzero(root != np.arange(len(root)))
                a.append(order[root[linked]])
                b.append(order[linked])
            ends_of = [flat.take(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (a, b)]
            yield pa.record_batch(ends_of, names=["a", "b"])

    return _buckets(nodes, radius).mapInArrow(run, f"a {_NODE}, b {_NODE}").distinct()


def simhash_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every row of ``docs`` with doc_id, fingerprint (16 hexadecimal digits) and component_id.

    A-Z are lower-cased, words are what is between ASCII spaces, shingles are three words in a row with repeats, and of fewer words the
    whole sequence. A null or empty text, or one without words, has fingerprint zero and is linked like any other. Rows are linked whose
    fingerprints differ in at most ``radius`` bits; component_id is the smallest doc_id reachable. Rows that repeat an id are rows
    of their own, with their own fingerprints. A null doc_id counts only where no other id is reachable. Other columns are ignored; a
    table without rows gives none.
    """
    rows = materialize(fingerprints(docs), "simhash-rows")
    # equal fingerprints meet here; rows combine map-side, however many copies a text has
    nodes = rows.groupBy(F.col("fingerprint").alias("bits")).agg(F.min("doc_id").alias("doc"))
    nodes = stored(nodes.select(F.col("doc").isNull().alias("none"), "doc", "bits"), "simhash-nodes", NODES_PER_TASK)
    # a node's order is that of its doc_id, nulls last: the least of a component has the component's id
    owner = components(near_fingerprints(nodes, radius))
    owner = owner.select(F.col("node.bits").alias("bits"), F.col("component.doc").alias("least"))
    ids = nodes.join(owner, "bits", "left").select("bits", F.coalesce("least", "doc").alias("component_id"))
    found = rows.join(ids, rows["fingerprint"] == ids["bits"], "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
