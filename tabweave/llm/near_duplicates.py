"""MinHash near-duplicates with an LSH forest of sorted signature orders.

Documents with equal shingle sets are one node. A node's signature is ``HASHES`` MinHash values, a byte each; tree t
sorts the nodes by the signature read from value t * ``STRIDE`` on, round the end. Neighbours in an order share its longest
common prefixes, so each node's candidates are the ``REACH`` nodes on both sides, if whole signatures agree enough.
Candidates are confirmed on full shingle sets, and confirmed links give components.

The depth adapts to the region: a node is done in a tree if nodes ``REACH`` places away share less than the prefix that chance
explains. Where they share more (very many copies, common passages) the order alone may not put two similar nodes
side by side. There each component found so far is replaced by its few nodes with the most links, and the smaller region is
sorted and searched again; also, each of these nodes meets the region's most linked ones, so a group around one
original comes together. This goes on while new links appear.

That leaves regions of more than one component, whose nodes may still be alike. All their nodes then go through an exact join: shingles
are ordered by how rare they are there, and two sets that are alike share one of the first few of both. Pairs within a component need
no look.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.common import SPACED, binary_parts, mix64, small_batches, stored, word_hashes
from tabweave.llm.components import components
from tabweave.session import materialize

SHINGLE = 5
PERCENT = 85
TREES, STRIDE = 16, 8
HASHES = TREES * STRIDE
REACH = 8
#: The chance at most that a pair just similar enough shares the depth's prefix in no tree.
MISSED = 1e-3
#: Of each component found so far, the nodes that stand for it, and of each region the nodes that all others there meet.
HEADS = 8
HUBS = 16
SORTED_ROWS = 100_000
BROADCAST_NODES = 400_000
SETS_PER_TASK = 2_000
#: Rows of a shingle that meet in one task; those of a shingle with more are dealt out.
POSTINGS = 1_000
#: Counters of shingles by hash. They only order the shingles, so what shares a counter costs time and no links.
COUNTERS = 1 << 20

_mult = mix64(np.arange(1, HASHES + 1, dtype=np.uint64))
_A, _B = (_mult >> np.uint64(32)).astype(np.uint32) | np.uint32(1), _mult.astype(np.uint32)
_STEP = mix64(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def least_agreeing(percent: int) -> int:
    """Equal signature bytes of a candidate: 3.5 standard deviations below what similarity ``percent`` gives."""
    share = percent / 100
    return max(1, round(HASHES * share - 3.5 * math.sqrt(HASHES * share * (1 - share))))


def dense_depth(n: int, percent: int) -> int:
    """Length of the prefix that chance explains among ``n`` nodes, or less where similar pairs would too often share none as long."""
    depth = max(2, math.ceil(math.log(max(n, 2), 256)))
    while depth > 1 and (1 - (percent / 100) ** depth) ** TREES > MISSED:
        depth -= 1
    return depth


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the ascending distinct 64-bit hashes of its five-word shingles; of fewer words, of the whole sequence."""
    words, at = word_hashes(*binary_parts(column), SPACED)
    n = len(words)
    if n >= SHINGLE:
        full = words[: n - SHINGLE + 1] * _STEP[0]
        for k in range(1, SHINGLE):
            full = full + words[k : n - SHINGLE + 1 + k] * _STEP[k]
        full = mix64(full)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(full[a : b - SHINGLE + 1])
        elif b > a:
            yield mix64(np.array([b - a], np.uint64) + (words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    spread = mix64(shingles + np.uint64(0x51ED270B))
    both = np.array([shingles.sum(dtype=np.uint64) + np.uint64(len(shingles)), np.bitwise_xor.reduce(spread)], np.uint64)
    return mix64(both).tobytes()


def signature(shingles: np.ndarray) -> bytes:
    """A byte of each MinHash value of a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        part = x[k : k + 512, None] * _A
        part += _B
        np.minimum(least, part.min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


_SIGNED = "doc_id long, text_hash long, n_shingles long, node binary, signature binary"


def _signed(docs: DataFrame) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts, nodes, signatures = [], [], []
            for shingles in shingle_sets(part.column("text")):
                counts.append(len(shingles))
                nodes.append(set_key(shingles) if len(shingles) else None)
                signatures.append(signature(shingles) if len(shingles) else None)
            yield pa.record_batch(
                [part.column("doc_id"), part.column("text_hash"), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "node", "signature"],
            )

    return docs.mapInArrow(run, _SIGNED)


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("tree", pa.int32()), ("prefix", pa.binary()), ("border", pa.int64()), ("place", pa.int32())])
_FOUND_SQL = "kind int, a binary, b binary, tree int, prefix binary, border long, place int"
PAIR, DENSE, EDGE = 0, 1, 2


class _Order:
    """Consecutive rows of one sorted order: pairs and dense nodes among rows at most ``REACH`` apart."""

    def __init__(self, tree: np.ndarray, keys: np.ndarray, nodes: list[bytes], fresh: int, depth: int, agree: int):
        """Rows before ``fresh`` have met each other already."""
        self.rows: list[tuple] = []
        for w in range(1, min(REACH, len(nodes) - 1) + 1):
            right = np.arange(max(w, fresh), len(nodes))
            left = right - w
            near = (tree[right] == tree[left]) & (keys[right, 0] == keys[left, 0])
            right, left = right[near], left[near]
            if w == REACH:
                far = (keys[right, :depth] == keys[left, :depth]).all(axis=1)
                for k in np.unique(np.concatenate([right[far], left[far]])).tolist():
                    self.rows.append((DENSE, nodes[k], None, int(tree[k]), keys[k, :depth].tobytes(), None, None))
            same = (keys[right] == keys[left]).sum(axis=1) >= agree
            for i, j in zip(right[same].tolist(), left[same].tolist()):
                a, b = sorted((nodes[i], nodes[j]))
                self.rows.append((PAIR, a, b, None, None, None, None))

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[]] * len(_FOUND)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def _forest(nodes: DataFrame, depth: int, agree: int, rows: int) -> DataFrame:
    """Pairs, dense nodes and the edges of partitions from all sorted orders of ``nodes`` (node, signature)."""

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId(), [], 0
        tree, keys, names = np.zeros(0, np.int32), np.zeros((0, HASHES), np.uint8), []
        first, total = [], 0

        def step() -> pa.RecordBatch:
            nonlocal tree, keys, names, held, size
            fresh = len(names)
            tree = np.concatenate([tree, *[p.column("tree").to_numpy() for p in held]])
            keys = np.concatenate([keys, *[np.frombuffer(b"".join(p.column("key").to_pylist()), np.uint8).reshape(-1, HASHES) for p in held]])
            names = names + [n for p in held for n in p.column("node").to_pylist()]
            out = _Order(tree, keys, names, fresh, depth, agree).batch()
            tree, keys, names = tree[-REACH:], keys[-REACH:], names[-REACH:]
            held, size = [], 0
            return out

        def edge(border: int, place: int, t: int, key: bytes, name: bytes) -> tuple:
            return (EDGE, name, None, t, key, border, place)

        for part in parts:
            if len(first) < REACH:
                rows_ = zip(part.column("tree").to_pylist(), part.column("key").to_pylist(), part.column("node").to_pylist())
                first += [edge(number, REACH + total + k, *r) for k, r in enumerate(rows_)][: REACH - len(first)]
            held.append(part)
            size += part.num_rows
            total += part.num_rows
            if size >= 8192:
                yield step()
        if size:
            yield step()
        last = [edge(number + 1, k - len(names) + REACH, int(tree[k]), keys[k].tobytes(), names[k]) for k in range(len(names))]
        if first:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*first, *last), _FOUND)], schema=_FOUND)

    def border(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        names = table.column("a").to_pylist()
        keys = np.frombuffer(b"".join(table.column("prefix").to_pylist()), np.uint8).reshape(-1, HASHES)
        fresh = sum(p < REACH for p in table.column("place").to_pylist())
        return pa.Table.from_batches([_Order(table.column("tree").to_numpy(), keys, names, fresh, depth, agree).batch()])

    turned = [F.concat(F.expr(f"substring(signature, {t * STRIDE + 1}, {HASHES})"), F.expr(f"substring(signature, 1, {t * STRIDE})")) for t in range(TREES)]
    orders = F.array(*[F.struct(F.lit(t).alias("tree"), k.alias("key")) for t, k in enumerate(turned)])
    rows_in = nodes.select("node", F.explode(orders).alias("o")).select("o.tree", "o.key", "node")
    ranges = max(1, -(-rows * TREES // SORTED_ROWS))
    dealt = rows_in.repartitionByRange(ranges, "tree", "key") if ranges > 1 else rows_in.coalesce(1)
    dealt = dealt.sortWithinPartitions("tree", "key", "node")
    found = materialize(dealt.mapInArrow(walk, _FOUND_SQL), "forest")
    # rows near the end of one partition meet those at the head of the next: at most 2 * REACH rows a border
    across = found.filter(F.col("kind") == EDGE).coalesce(max(1, ranges // 1000)).groupBy("border").applyInArrow(border, _FOUND_SQL)
    return materialize(found.filter(F.col("kind") != EDGE).unionByName(across), "forest-rows")


def _pairs(found: DataFrame) -> DataFrame:
    return found.filter(F.col("kind") == PAIR).select("a", "b").distinct()


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """node and its shingles for the nodes in ``wanted``."""
    wanted = nodes.join(F.broadcast(wanted) if few else wanted, "node")
    wanted = stored(wanted.select("node", F.col("rep.doc_id").alias("r_id"), F.col("rep.text_hash").alias("r_hash")), "near-wanted")
    met = docs["text_hash"].eqNullSafe(wanted["r_hash"]) & docs["doc_id"].eqNullSafe(wanted["r_id"])
    texts = docs.join(F.broadcast(wanted) if few else wanted, met).select("node", "text")

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = list(shingle_sets(part.column("text")))
            right = [set_key(s) == n for s, n in zip(got, part.column("node").to_pylist())]
            made = pa.record_batch([part.column("node"), pa.array([s.tobytes() for s in got], pa.binary())], names=["node", "shingles"])
            yield made.filter(pa.array(right))

    made = stored(texts.mapInArrow(sets, "node binary, shingles binary"), "near-sets", SETS_PER_TASK)
    return made.dropDuplicates(["node"])


def _confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full shingle sets have 100 * intersection >= percent * union."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    few = pairs.count() * 2 <= BROADCAST_NODES
    held = _sets(docs, nodes, wanted, few)

    def confirm(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            right = []
            for x, y in zip(part.column("x"), part.column("y")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                right.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(right, pa.bool_()))

    one = pairs.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(held.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return stored(two.mapInArrow(confirm, "a binary, b binary"), "near-links")


def _agreeing(pairs: DataFrame, agree: int) -> DataFrame:
    """Pairs (a, b, signatures x and y) whose signatures agree enough."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("x", "y"))
            yield part.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= agree))

    return pairs.mapInArrow(run, "a binary, b binary").distinct()


def near_links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, owner): every row with its node, confirmed links between nodes (a, b), and the component of linked nodes.

    ``docs`` has doc_id, text_hash and text (binary).
    """
    rows = materialize(_signed(docs), "near-signatures")
    # equal sets meet here; rows combine map-side, however many copies a text has
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node")
    nodes = stored(nodes.agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("signature").alias("signature")), "near-nodes")
    n = nodes.count()
    depth = dense_depth(n, percent)
    found = _forest(nodes.select("node", "signature"), depth, least_agreeing(percent), n)
    tried = stored(_pairs(found), "near-pairs")
    links = _confirmed(docs, nodes, tried, percent)
    owner = components(links)
    dense = stored(found.filter(F.col("kind") == DENSE).select("tree", "prefix", F.col("a").alias("node")).distinct(), "near-dense")
    while not dense.isEmpty():
        new = _deeper(docs, nodes, links, owner, dense, tried, depth, percent)
        if new is None:
            break
        links, tried = links.unionByName(new[0]), tried.unionByName(new[1])
        owner = _grown(owner, new[0])
    if not dense.isEmpty():
        last = _exact(docs, nodes, owner, dense, tried, percent)
        if last is not None:
            links, owner = links.unionByName(last), _grown(owner, last)
    return rows, links, owner


def _grown(owner: DataFrame, links: DataFrame) -> DataFrame:
    return components(owner.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def _deeper(docs: DataFrame, nodes: DataFrame, links: DataFrame, owner: DataFrame, dense: DataFrame, tried: DataFrame, depth: int, percent: int) -> tuple | None:
    """One more round over the dense regions, with a few nodes for each component: new links and pairs tried, or None."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    known = dense.join(degree, "node", "left").join(owner, "node", "left")
    known = stored(known.select("tree", "prefix", "node", F.coalesce("component", "node").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree")), "dense-known")
    most = Window.partitionBy("component").orderBy(F.desc("degree"), "node")
    heads = known.select("component", "node", "degree").distinct().withColumn("r", F.row_number().over(most)).filter(F.col("r") <= HEADS).drop("r")
    heads = stored(heads.join(nodes.select("node", "signature"), "node"), "dense-heads")
    regions = known.select("tree", "prefix", "component").distinct().join(heads, "component").drop("component")
    top = Window.partitionBy("tree", "prefix").orderBy(F.desc("degree"), "node")
    hubs = regions.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= HUBS)
    hubs = hubs.select("tree", "prefix", F.col("node").alias("hub"), F.col("signature").alias("y"))
    star = regions.join(hubs, ["tree", "prefix"]).filter("node <> hub")
    star = star.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), F.col("signature").alias("x"), "y")
    again = _pairs(_forest(heads.select("node", "signature"), depth, least_agreeing(percent), heads.count()))
    pairs = _agreeing(star, least_agreeing(percent)).unionByName(again).distinct().join(tried, ["a", "b"], "left_anti")
    pairs = stored(pairs, "dense-pairs")
    new = _confirmed(docs, nodes, pairs, percent)
    return None if new.isEmpty() else (new, pairs)


def _prefixes(members: DataFrame, percent: int) -> DataFrame:
    """token, node, component, n (size of the set) and at: the first shingles of each set of ``members`` (node, component, shingles).

    Of two sets with similarity ``percent``, the larger one's share of common shingles is at least that, so later ones needn't be looked up.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for part in parts:
            x = np.frombuffer(binary_parts(part.column("shingles"))[0], np.uint64)
            total += np.bincount((x % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["counter", "n"])

    counts = members.select("shingles").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int64)  # at most COUNTERS rows, whatever the input
    often[counts.column("counter").to_numpy()] = counts.column("n").to_numpy()
    shared = members.sparkSession.sparkContext.broadcast(often)

    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            tokens, sizes = [], []
            for x in part.column("shingles"):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                order = np.lexsort((x, shared.value[(x % np.uint64(COUNTERS)).astype(np.int64)]))
                tokens.append(x[order[: len(x) + percent * -len(x) // 100 + 1]])
                sizes.append(len(x))
            many = np.array([len(t) for t in tokens], np.int64)
            row = pa.array(np.repeat(np.arange(len(tokens)), many))
            at = np.concatenate([np.arange(k) for k in many]) if len(many) else many
            token = np.concatenate(tokens).view(np.int64) if tokens else many
            yield pa.record_batch(
                [pa.array(token), part.column("node").take(row), part.column("component").take(row), pa.array(np.repeat(sizes, many).astype(np.int64)), pa.array(at)],
                names=["token", "node", "component", "n", "at"],
            )

    return members.mapInArrow(first, "token long, node binary, component binary, n long, at long")


def _exact(docs: DataFrame, nodes: DataFrame, owner: DataFrame, dense: DataFrame, tried: DataFrame, percent: int) -> DataFrame | None:
    """Links between nodes of dense regions that are not yet in one component: all of them, or None where there are none.

    With a fixed order of shingles, two sets with ``common`` shingles in common share one that is at most at place size - ``common`` of both.
    """
    known = stored(dense.join(owner, "node", "left").withColumn("component", F.coalesce("component", "node")), "exact-known")
    several = known.groupBy("tree", "prefix").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = stored(several.filter("low <> high").select("tree", "prefix"), "exact-regions")
    few = several.count() <= BROADCAST_NODES
    members = known.join(F.broadcast(several) if few else several, ["tree", "prefix"], "left_semi").select("node", "component").distinct()
    members = stored(members, "exact-members")
    n = members.count()
    if not n:
        return None
    sets = _sets(docs, nodes, members.select("node"), n <= BROADCAST_NODES)
    sets = stored(sets.join(F.broadcast(members) if n <= BROADCAST_NODES else members, "node"), "exact-sets", SETS_PER_TASK)
    first = materialize(_prefixes(sets, percent), "exact-prefixes")
    often = first.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("low"), F.max("component").alias("high"))
    often = stored(often.filter(F.col("c") > POSTINGS), "exact-often")  # at most a row for POSTINGS of the prefixes
    dealt = first.join(F.broadcast(often), "token", "left").filter("low IS NULL OR low <> high")
    deals = F.ceil(F.coalesce("c", F.lit(1)) / POSTINGS)
    dealt = dealt.select("token", "node", "component", "n", "at", deals.alias("deals"))
    both = 100 + percent
    short = dealt.filter(f"at + (2 * {percent} * n + {both - 1}) DIV {both} <= n").withColumn("deal", F.pmod(F.xxhash64("node"), F.col("deals"))).alias("s")
    long = dealt.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).alias("l")
    common = f"({percent} * (s.n + l.n) + {both - 1}) DIV {both}"
    met = F.expr(
        "s.token = l.token AND s.deal = l.deal AND s.component <> l.component AND (s.n < l.n OR (s.n = l.n AND s.node < l.node))"
        f" AND s.at + {common} <= s.n AND l.at + {common} <= l.n"
    )
    pairs = short.join(long, met).select(F.least("s.node", "l.node").alias("a"), F.greatest("s.node", "l.node").alias("b")).distinct()
    pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "exact-pairs")
    new = _confirmed(docs, nodes, pairs, percent)
    return None if new.isEmpty() else new


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every row of ``docs`` with n_shingles, component_id and kept; also text_hash.

    Two documents are linked if their sets of five-word shingles have 100 * intersection >= percent * union; component_id is
    the smallest doc_id reachable by links. A null or empty text, or one without words, has no set and is linked with nothing:
    its component is its own doc_id. Rows that repeat an id are rows of their own. A null doc_id counts only where no other id
    is reachable; its row is kept only then. Other columns are ignored; a table without rows gives none.
    """
    small_batches(docs.sparkSession)
    rows, _, owner = near_links(_prepared(docs), percent)
    of_node = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    of_node = of_node.join(owner, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_node = materialize(of_node, "near-components")
    least = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = of_node.join(least, "component").select("node", "component_id")
    joined = rows.join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = joined.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were; of rows that repeat id and text, one.

    Rows without words stay.
    """
    found = near_duplicates(docs, percent).groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("m"))
    found = materialize(found.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), (F.col("n") > 1).alias("__many")), "near-kept")
    text = F.col("text").cast("string")
    keyed = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__text": F.xxhash64(text)})
    rows = keyed.join(found, keyed["__doc"].eqNullSafe(found["__id"]) & keyed["__text"].eqNullSafe(found["__hash"]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if found.filter("__many").isEmpty():
        return rows.select(*columns)
    single = rows.filter("NOT __many").select(*columns)
    return single.unionByName(rows.filter("__many").dropDuplicates(["__doc", "__text"]).select(*columns))
