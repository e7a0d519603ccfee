"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: each segment holds whole documents of about ``SEGMENT_WORDS`` words, laid end
to end with a gap between them, and for each of its terms the ascending word positions. It is built by one
pass without a shuffle and stored as a table, so it serves any number of test sets. A search brings the lists
of the test terms of one segment together, starts each phrase from its term that is rarest there, and
intersects the other lists, adjusted by their offsets, in order of rarity.

Terms are 64-bit hashes of words. Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import ALNUM, batches, binary_parts, signed, small_batches, word_hashes
from tabweave.session import materialize

WINDOW = 10
SEGMENT_WORDS = 2_000_000
#: Test words searched at once, and distinct terms broadcast at most (16 bytes each).
BLOCK_WORDS = 1_000_000
BROADCAST_TERMS = 1_000_000

_POSTINGS = pa.schema(
    [("segment", pa.int64()), ("term", pa.int64()), ("gaps", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int32()))]
)
_POSTINGS_SQL = "segment long, term long, gaps array<int>, doc_ids array<long>, doc_words array<int>"
_MATCHES = pa.schema([("segment", pa.int64()), ("place", pa.int64()), ("item", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
_MATCHES_SQL = "segment long, place long, item long, first long, last long"


@dataclass(frozen=True)
class PositionalIndex:
    """A stored table of postings: a row for each segment and term, and a row without term for a segment's documents."""

    postings: DataFrame

    def documents(self) -> DataFrame:
        """segment, place in the segment, doc_id and n_words of every indexed row."""
        rows = self.postings.filter(F.col("term").isNull())
        both = F.arrays_zip("doc_ids", "doc_words")
        return rows.select("segment", F.posexplode(both).alias("place", "d")).select(
            "segment", F.col("place").cast("long").alias("place"), F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_words").cast("long").alias("n_words")
        )


def _segment(segment: int, hashes: list, counts: list, ids: list) -> Iterator[pa.RecordBatch]:
    words = np.concatenate(counts).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(words + 1)[:-1]])
    terms = np.concatenate(hashes)
    places = (np.arange(len(terms)) + np.repeat(np.arange(len(words)), words)).astype(np.int32)
    order = np.argsort(terms, kind="stable")
    terms, places = terms[order], places[order]
    begin = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
    gaps = np.diff(places, prepend=np.int32(0))
    gaps[begin] = places[begin]
    offsets = np.concatenate([begin, [len(terms)]]).astype(np.int32)
    n = len(begin)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(gaps))
    none = pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))
    yield from batches(pa.table([pa.array(np.full(n, segment)), pa.array(signed(terms[begin])), lists, *none], schema=_POSTINGS))
    assert len(first) == len(ids)
    one = {"segment": [segment], "term": [None], "gaps": [None], "doc_ids": [ids], "doc_words": [words.tolist()]}
    yield pa.RecordBatch.from_pydict(one, schema=_POSTINGS)


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> PositionalIndex:
    """Index every row of ``docs`` (doc_id, text), whole texts; other columns are ignored.

    A null or empty text is a document without words. Rows with equal or null doc_ids are documents of their own.
    A segment ends with the batch in which it reaches ``segment_words`` words; one longer document stays whole.
    """
    small_batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = TaskContext.get().partitionId() << 32, 0
        hashes, counts, ids, words = [], [], [], 0
        for part in parts:
            got, at = word_hashes(*binary_parts(part.column("text")), ALNUM)
            hashes.append(got)
            counts.append(np.diff(at))
            ids += part.column("doc_id").to_pylist()
            words += len(got)
            if words >= segment_words:
                yield from _segment(number + made, hashes, counts, ids)
                hashes, counts, ids, words, made = [], [], [], 0, made + 1
        if ids:
            yield from _segment(number + made, hashes, counts, ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return PositionalIndex(materialize(rows.mapInArrow(run, _POSTINGS_SQL), "positional-index"))


def _items(items: DataFrame, window: int) -> DataFrame:
    """item (a number), item_id and the phrases of each item, as lists of term hashes, with how many terms it has."""
    small_batches(items.sparkSession)
    kinds = "item_id string, terms array<long>"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got, at = word_hashes(*binary_parts(part.column("text")), ALNUM)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(got)))
            yield pa.record_batch([part.column("item_id"), lists], names=["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.filter(F.col("item_id").isNotNull()).mapInArrow(run, kinds).filter(F.size("terms") > 0)
    # equal texts are searched once; the number of an item is a hash of its terms, so it is the same in every run
    whole = rows.groupBy("terms").agg(F.collect_set("item_id").alias("item_ids"))
    return whole.select(F.xxhash64("terms").alias("item"), "terms", "item_ids")


class _Lists:
    """The lists of one segment: positions by term, decoded when first used."""

    def __init__(self, table: pa.Table):
        mask = table.column("term").is_valid()
        rows = table.filter(mask).combine_chunks()
        gaps = rows.column("gaps").combine_chunks() if rows.num_rows else None
        self._at = {t: k for k, t in enumerate(rows.column("term").to_pylist())}
        self._flat = gaps.values.to_numpy() if gaps is not None else np.zeros(0, np.int32)
        self._offsets = gaps.offsets.to_numpy() if gaps is not None else np.zeros(1, np.int32)
        self._known: dict[int, np.ndarray] = {}
        docs = table.filter(pa.compute.invert(mask))
        words = np.array(docs.column("doc_words")[0].as_py() or [], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(words + 1)[:-1]]) if len(words) else words

    def count(self, term: int) -> int:
        k = self._at.get(term)
        return 0 if k is None else int(self._offsets[k + 1] - self._offsets[k])

    def __call__(self, term: int) -> np.ndarray:
        got = self._known.get(term)
        if got is None:
            k = self._at[term]
            got = self._known[term] = np.cumsum(self._flat[self._offsets[k] : self._offsets[k + 1]], dtype=np.int64)
        return got

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Positions at which the phrase begins."""
        by_rarity = sorted((self.count(t), k) for k, t in enumerate(terms))
        if by_rarity[0][0] == 0:
            return np.zeros(0, np.int64)
        found = self(terms[by_rarity[0][1]]) - by_rarity[0][1]
        for _, k in by_rarity[1:]:
            if len(found) == 0:
                break
            there, want = self(terms[k]), found + k
            at = np.searchsorted(there, want)
            at[at == len(there)] = 0
            found = found[there[at] == want]
        return found

    def near(self, terms: list[int], span: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of the shortest stretches of at most ``span`` words that hold every term, in any order.

        A stretch counts if no shorter one inside it holds all terms. Each one ends and begins with a listed word, so
        the ends tried are those within ``span`` words of the rarest term.
        """
        distinct = sorted(set(terms), key=lambda t: (self.count(t), t))
        if self.count(distinct[0]) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rare = self(distinct[0])
        ends = np.unique(np.concatenate([self(t)[self._within(self(t), rare, span)] for t in distinct if self.count(t)]))
        first = ends.copy()
        for t in distinct:
            there = self(t) if self.count(t) else np.zeros(0, np.int64)
            at = np.searchsorted(there, ends, side="right") - 1
            keep = at >= 0
            ends, first, at = ends[keep], first[keep], at[keep]
            if len(ends) == 0:
                return ends, ends
            first = np.minimum(first, there[at])
            keep = ends - first < span
            ends, first = ends[keep], first[keep]
        doc = np.searchsorted(self.starts, first, side="right")
        keep = doc == np.searchsorted(self.starts, ends, side="right")
        ends, first = ends[keep], first[keep]
        new = np.concatenate([[True], first[1:] > first[:-1]]) if len(first) else np.zeros(0, bool)
        return first[new], ends[new]

    @staticmethod
    def _within(places: np.ndarray, rare: np.ndarray, span: int) -> np.ndarray:
        after = np.searchsorted(rare, places - span + 1)
        return (after < len(rare)) & (rare[np.minimum(after, len(rare) - 1)] <= places + span - 1)

    def matches(self, segment: int, item: int, first: np.ndarray, last: np.ndarray) -> pa.Table:
        """Word ranges inside their documents; ranges that overlap or touch become one."""
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
        place = np.searchsorted(self.starts, first, side="right") - 1
        reach = np.maximum.accumulate(last)
        new = np.concatenate([[True], (first[1:] > reach[:-1] + 1) | (place[1:] != place[:-1])])
        begin = np.flatnonzero(new)
        stop = np.concatenate([begin[1:], [len(first)]]) - 1
        base = self.starts[place[begin]]
        n = len(begin)
        return pa.table([np.full(n, segment), place[begin], np.full(n, item), first[begin] - base, reach[stop] - base], schema=_MATCHES)


def _search(index: PositionalIndex, items: DataFrame, find: Callable[[_Lists, list[int]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Run ``find`` for every item in every segment. Items go out in blocks of about ``BLOCK_WORDS`` words."""
    spark = index.postings.sparkSession
    words = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-words // BLOCK_WORDS))
    found = spark.createDataFrame([], _MATCHES_SQL)
    for block in range(blocks):
        own = items.filter(F.pmod("item", F.lit(blocks)) == block)
        terms = own.select(F.explode("terms").alias("term")).distinct()
        phrases = [(r.item, list(r.terms)) for r in own.select("item", "terms").collect()]  # one block of the test set
        if not phrases:
            continue
        small = terms.count() <= BROADCAST_TERMS
        lists = index.postings.join(F.broadcast(terms) if small else terms, "term", "left_semi").select("segment", "term", "gaps")
        ends = index.postings.filter(F.col("term").isNull()).select("segment", "doc_words")
        rows = lists.unionByName(ends, allowMissingColumns=True)

        found = found.unionByName(rows.groupBy("segment").applyInArrow(_searcher(phrases, find), _MATCHES_SQL))
    return found


def _searcher(phrases: list[tuple[int, list[int]]], find: Callable) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        here, segment, got = _Lists(table), table.column("segment")[0].as_py(), [_MATCHES.empty_table()]
        for item, terms in phrases:
            first, last = find(here, terms)
            if len(first):
                got.append(here.matches(segment, item, first, last))
        return pa.concat_tables(got)

    return run


def phrase_matches(index: PositionalIndex, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Where windows of ``window`` consecutive words of an item occur: doc_id, segment, place, item_id, first, last.

    ``first`` and ``last`` count words from 0 in the document; windows of an item that overlap or touch are one range.
    An item of fewer words is one window; items without words, or with a null item_id or text, match nothing. Equal
    items each get their rows.
    """
    prepared = materialize(_items(items, window), "test-items")

    def find(here: _Lists, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        size = min(window, len(terms))
        starts = np.unique(np.concatenate([here.phrase(w) for w in _windows(terms, size, here)] or [np.zeros(0, np.int64)]))
        return starts, starts + size - 1

    return _named(index, prepared, _search(index, prepared, find))


def _windows(terms: list[int], size: int, here: _Lists) -> list[list[int]]:
    """The distinct windows without a term that the segment lacks."""
    absent = [k for k, t in enumerate(terms) if here.count(t) == 0]
    kept, edges = {}, [-1, *absent, len(terms)]
    for a, b in zip(edges, edges[1:]):
        for k in range(a + 1, b - size + 1):
            kept[tuple(terms[k : k + size])] = None
    return [list(w) for w in kept]


def proximity_matches(index: PositionalIndex, items: DataFrame, span: int) -> DataFrame:
    """Where all distinct words of an item lie within ``span`` words of a document, in any order.

    Same columns as :func:`phrase_matches`. Only shortest stretches count: those without a shorter one inside. Stretches
    that overlap or touch are one range. An item with more distinct words than ``span`` matches nothing.
    """
    prepared = materialize(_items(items, span), "test-items")
    return _named(index, prepared, _search(index, prepared, lambda here, terms: here.near(terms, span)))


def _named(index: PositionalIndex, items: DataFrame, found: DataFrame) -> DataFrame:
    named = items.select("item", F.explode("item_ids").alias("item_id"))
    rows = found.join(named, "item").join(index.documents(), ["segment", "place"])
    return rows.select("doc_id", "segment", "place", "item_id", "first", "last", "n_words")


def contamination(index: PositionalIndex, matches: DataFrame) -> DataFrame:
    """One row for each indexed row: doc_id, n_words, n_hit (words inside any match), item_ids (sorted), segment, place."""
    ranges = F.array_sort(F.collect_list(F.struct("first", "last")))
    one = matches.groupBy("segment", "place").agg(ranges.alias("ranges"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    start = F.struct(F.lit(-1).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "ranges",
        start,
        lambda s, r: F.struct(
            F.greatest(s["reach"], r["last"]).alias("reach"),
            (s["n"] + F.greatest(F.lit(0).cast("long"), r["last"] - F.greatest(s["reach"], r["first"] - 1))).alias("n"),
        ),
        lambda s: s["n"],
    )
    one = one.select("segment", "place", covered.alias("n_hit"), "item_ids")
    docs = index.documents().join(one, ["segment", "place"], "left")
    none = F.array().cast("array<string>")
    return docs.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), "segment", "place"
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a window of an item, all columns kept.

    The judged rows come back from the index by their doc_id and the hash of their text, so rows that repeat both stay
    or go together.
    """
    spark_docs = docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    index = build_index(spark_docs.select(F.col("__key").alias("doc_id"), "text"))
    hit = contamination(index, phrase_matches(index, items, window)).filter(F.col("n_hit") > 0)
    return spark_docs.join(hit.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").drop("__key")
