"""Near-duplicate lines by a segment-partition edit join, in DataFrame expressions only.

Two lines within ``EDITS`` edits share one of EDITS + 1 segments of the shorter line exactly. Each distinct line
gives its segments as index keys (length, segment number, hash), and for each length up to EDITS below its own the substrings that
may equal a segment of a line of that length, at the few places that the edits before and after it leave open. Equal keys
are candidates. They are verified on the full lines with a banded bit-parallel automaton: a bit for each diagonal of the
band, a word for each number of edits. Few lines share a key with another one; only theirs are read again and their characters counted.

Equal lines are one line before the join, so a line that occurs very often takes part once. A key that more than ``CROWD``
lines hold is split by what the lines' character counts have in common: within e edits of each other, a line and one d characters
longer have equal counts once t characters are taken out of the shorter and t + d out of the longer one, for some t up to e - d. Each
line in a crowd gives its counts less every choice of so few characters as further keys, a number that doesn't depend on
the crowd.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import stored
from tabweave.llm.components import components
from tabweave.session import materialize

EDITS = 2
#: Shorter lines are duplicates only if equal.
LEAST_CHARS = 24
BROADCAST_LINES = 400_000
#: Of hashes alone.
BROADCAST_HASHES = 1_000_000
#: Keys that more lines hold are split by character counts.
CROWD = 32
#: Characters whose counts bound the distance from below; the first and the rest of the line in the join, all before the automaton runs.
_COUNTED = " etanoirshldcumpgwy"
_LANES = 16
#: Lanes whose counts are added up for the keys of a crowd, in a byte each: fewer choices of characters, so fewer keys.
_FOLDS = 6
_FOLDED = 0x0F0F0F0F0F0F
_BORROW = 0x101010101010
#: Characters between two looks at whether the automaton is still alive.
_STRIDE = 32


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line and its 128-bit hash (h1, h2), for lines that hold a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = rows.filter(F.regexp_like("line", F.lit(r"[^\x20\x09-\x0D]")))
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(9), "line")})


def _segment(short: Column, longer: Column, k: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment k of a line of ``short * (edits + 1) + longer`` characters: even segments, the last ones longer by one."""
    first = F.lit(edits + 1) - longer
    return short * k + F.greatest(F.lit(0), F.lit(k) - first), short + (F.lit(k) >= first).cast("int")


def _asked(edits: int) -> list[tuple[int, int, int]]:
    """(shorter, segment, shift) of each substring that a line looks up."""
    found = []
    for shorter in range(edits + 1):
        for k in range(edits + 1):
            found += [(shorter, k, shift) for shift in range(max(-k, shorter - (edits - k)), min(k, shorter + (edits - k)) + 1)]
    return found


def _keyed(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` with ``asked``, the keys under which lines of the same length and up to ``edits`` shorter ones may be, in the order of
    :func:`_asked`. Those of its own length without a shift are the keys under which a line is indexed.

    Segment k has at most k edits to its left and edits - k to its right, in an alignment that meets it first; both bound its shift. A
    shift over an end of the line gives another substring, which is a candidate at most.
    """
    parts = edits + 1
    sizes = []
    for shorter in range(edits + 1):
        n = F.col("n") - shorter
        sizes += [n.alias(f"n{shorter}"), F.floor(n / parts).cast("int").alias(f"s{shorter}"), (n % parts).alias(f"l{shorter}")]
    rows = lines.withColumn("n", F.length("line")).select("*", *sizes)
    asked = []
    for shorter, k, shift in _asked(edits):
        start, size = _segment(F.col(f"s{shorter}"), F.col(f"l{shorter}"), k, edits)
        asked.append(F.xxhash64(f"n{shorter}", F.lit(k), F.substr("line", F.greatest(F.lit(0), start + shift) + 1, size)))
    return rows.select(*lines.columns, F.array(*asked).alias("asked"))


def _entries(once: DataFrame, edits: int) -> DataFrame:
    """(key, h1, shorter, held, crowded): the asked keys of ``once`` that one line holds and another asks for, with all lines that ask.

    A line asks for what it holds, so such a key has a holder and two different lines. Keys are dealt once, for the look at each key and
    for the lines of those that stay.
    """
    asked = _asked(edits)
    own = [at for at, (shorter, _, shift) in enumerate(asked) if shorter == 0 and shift == 0]
    rows = once.select("h1", F.posexplode("asked").alias("at", "key")).repartition("key")
    held = F.col("at").isin(own)
    keys = rows.groupBy("key").agg(F.count_if(held).alias("holders"), F.min("h1").alias("low"), F.max("h1").alias("high"))
    keys = keys.filter((F.col("holders") > 0) & (F.col("low") != F.col("high"))).select("key", (F.col("holders") > CROWD).alias("crowded"))
    shorter_of = F.array(*[F.lit(shorter) for shorter, _, _ in asked])
    rows = rows.join(keys.hint("shuffle_hash"), "key")
    return stored(rows.select("key", "h1", F.get(shorter_of, F.col("at")).alias("shorter"), held.alias("held"), "crowded"), "lines-entries")


def _packed_counts(line: Column) -> Column:
    """Counts of the first characters of ``_COUNTED`` and of all others, modulo 16, four bits each.

    Each character is taken out of what the ones before it have left, so the string gets short soon. A step adds the count of the
    step before, which is how much shorter that has made it.
    """

    def lane(a: Column, at: Column) -> Column:
        return F.call_function("shiftleft", (a["before"] - F.length(a["rest"])).bitwiseAND(F.lit(15)).cast("long"), at)

    def step(a: Column, x: Column) -> Column:
        packed = a["packed"].bitwiseOR(lane(a, x["at"]))
        return F.struct(F.replace(a["rest"], x["c"]).alias("rest"), F.length(a["rest"]).alias("before"), packed.alias("packed"))

    chars = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(max(0, 4 * (k - 1))).alias("at")) for k, c in enumerate(_COUNTED[: _LANES - 1])])
    start = F.struct(line.alias("rest"), F.length(line).alias("before"), F.lit(0).cast("long").alias("packed"))

    def finish(a: Column) -> Column:
        others = F.shiftleft(F.length(a["rest"]).bitwiseAND(F.lit(15)).cast("long"), 4 * (_LANES - 1))
        return a["packed"].bitwiseOR(lane(a, F.lit(4 * (_LANES - 2)))).bitwiseOR(others)

    return F.aggregate(chars, start, step, finish)


def _apart(p: Column, q: Column) -> Column:
    """Sum over the counts of how far they are apart, round 16."""
    total = F.lit(0)
    for k in range(_LANES):
        lane = F.shiftright(p, 4 * k).bitwiseAND(F.lit(15).cast("long")).cast("int") - F.shiftright(q, 4 * k).bitwiseAND(F.lit(15).cast("long")).cast("int")
        total = total + F.least(F.abs(lane), 16 - F.abs(lane))
    return total


def _folded(p: Column) -> Column:
    """Packed counts added up to ``_FOLDS`` counts modulo 16, a byte each."""
    total = None
    for fold in range(_FOLDS):
        lanes = [F.shiftright(p, 4 * k).bitwiseAND(F.lit(15).cast("long")) for k in range(fold, _LANES, _FOLDS)]
        byte = F.shiftleft(sum(lanes[1:], lanes[0]).bitwiseAND(F.lit(15).cast("long")), 8 * fold)
        total = byte if total is None else total.bitwiseOR(byte)
    return total


def _folds_apart(p: Column, q: Column) -> Column:
    total = F.lit(0)
    for fold in range(_FOLDS):
        lane = (F.shiftright(p, 8 * fold).bitwiseAND(F.lit(15).cast("long")) - F.shiftright(q, 8 * fold).bitwiseAND(F.lit(15).cast("long"))).cast("int")
        total = total + F.least(F.abs(lane), 16 - F.abs(lane))
    return total


def _taken_out(key: Column, folded: Column, shorter: int, t: int, size: int) -> Column:
    """``key`` split by the folded counts less each choice of ``size`` characters: an array of structs (shorter, t, part)."""
    choices = [F.lit(sum(1 << (8 * k) for k in chosen)).cast("long") for chosen in combinations_with_replacement(range(_FOLDS), size)]

    def split(less: Column) -> Column:
        left = (folded + F.lit(_BORROW) - less).bitwiseAND(F.lit(_FOLDED))
        return F.struct(F.lit(shorter).alias("shorter"), F.lit(t).alias("t"), F.xxhash64(key, F.lit(shorter), F.lit(t), left).alias("part"))

    return F.transform(F.array(*choices), split)


def _meetings(entries: DataFrame, edits: int) -> DataFrame:
    """Pairs of hashes (x, y) of lines that share a key and whose character counts are no further apart than ``edits`` allow."""
    held = entries.filter("held").select("key", "crowded", F.col("h1").alias("x"), F.col("counts").alias("p"))
    asked = entries.select("key", "crowded", "shorter", F.col("h1").alias("y"), F.col("counts").alias("q"))
    near = (F.col("x") != F.col("y")) & (_apart(F.col("p"), F.col("q")) <= 2 * edits)
    sought = asked.filter("NOT crowded").select(F.col("key").alias("wanted"), "y", "q")
    quiet = held.filter("NOT crowded").join(sought, (F.col("key") == F.col("wanted")) & near)
    inside, outside = [], []
    for shorter in range(edits + 1):
        for t in range(edits - shorter + 1):
            inside.append(_taken_out(F.col("key"), F.col("f"), shorter, t, t))
            outside.append(F.when(F.col("shorter") == shorter, _taken_out(F.col("key"), F.col("g"), shorter, t, t + shorter)))
    none = F.array().cast("array<struct<shorter:int,t:int,part:bigint>>")
    split = held.filter("crowded").withColumn("f", _folded(F.col("p")))
    split = split.select("x", "p", "f", F.explode(F.concat(*inside)).alias("k")).select("x", "p", "f", "k.*")
    sought = asked.filter("crowded").withColumn("g", _folded(F.col("q")))
    sought = sought.select("y", "q", "g", F.explode(F.concat(*[F.coalesce(o, none) for o in outside])).alias("k"))
    sought = sought.select("y", "q", "g", F.col("k.part").alias("wanted"))
    # of the choices that make two lines' counts equal only the smallest takes out no character that both could keep
    least = _folds_apart(F.col("f"), F.col("g")) == 2 * F.col("t") + F.col("shorter")
    crowd = split.join(sought, (F.col("part") == F.col("wanted")) & least & near)
    met = quiet.select("x", "y").unionByName(crowd.select("x", "y"))
    return stored(met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "lines-met")


def _shared_start(a: Column, b: Column) -> Column:
    """Number of characters that two strings start with alike, up to 2^20 - 1: equal pieces of falling powers of two."""
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(20))])
    least = F.least(F.length(a), F.length(b))

    def longer(n: Column, more: Column) -> Column:
        return F.when((n + more <= least) & (F.substr(a, n + 1, more) == F.substr(b, n + 1, more)), n + more).otherwise(n)

    return F.aggregate(powers, F.lit(0), longer)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most ``edits``.

    What both start with costs no edit and is left out. Bit d of word e, after j characters of b: the first j + d - edits characters
    of a are within e edits of them. One step makes all diagonals at once. No bit comes back once all are gone, which is looked at after
    every ``_STRIDE`` characters.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1

    def start(e: int) -> Column:
        return F.lit(((1 << (e + 1)) - 1) << edits)

    def run(x: Column, y: Column) -> Column:
        begin = F.struct(*[start(e).alias(f"r{e}") for e in range(edits + 1)])

        def step(r: Column, c: Column, j: Column) -> Column:
            equal = [F.when(F.get(x, j + d - edits) == c, 1 << d).otherwise(0) for d in range(width)]
            match = sum(equal[1:], equal[0])
            new: list[Column] = []
            for e in range(edits + 1):
                here = r[f"r{e}"].bitwiseAND(match)
                if e:
                    old = r[f"r{e - 1}"]
                    here = here.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[e - 1], 1).bitwiseAND(F.lit(full)))
                new.append(here)
            return F.struct(*[n.alias(f"r{e}") for e, n in enumerate(new)])

        def stride(r: Column, k: Column) -> Column:
            stop = F.least(k + _STRIDE, F.size(y))
            pairs = F.arrays_zip(F.slice(y, k + 1, stop - k).alias("c"), F.sequence(k, stop - 1).alias("j"))
            return F.when(r[f"r{edits}"] == 0, r).otherwise(F.aggregate(pairs, r, lambda r, p: step(r, p["c"], p["j"])))

        last = F.aggregate(F.sequence(F.lit(0), F.size(y) - 1, F.lit(_STRIDE)), begin, stride)[f"r{edits}"]
        return F.call_function("shiftright", last, F.size(x) - F.size(y) + edits).bitwiseAND(F.lit(1)) == 1

    def rest(n: Column) -> Column:
        # an empty string splits to one empty piece, so that both are non-empty is asked first
        none_left = F.least(F.length(a), F.length(b)) == n
        halves = F.struct(F.split(F.substr(a, n + 1), "").alias("x"), F.split(F.substr(b, n + 1), "").alias("y"))
        return F.when(none_left, True).otherwise(F.transform(F.array(halves), lambda s: run(s["x"], s["y"]))[0])

    # where one string starts the other, their lengths tell the distance
    return F.when(F.abs(F.length(a) - F.length(b)) <= edits, F.transform(F.array(_shared_start(a, b)), rest)[0]).otherwise(False)


def _counts(line: Column) -> Column:
    return F.array(*[F.length(line) - F.length(F.replace(line, F.lit(c))) for c in _COUNTED])


def line_links(docs: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """(lines, links): each distinct line once, as its node (doc_id and line_no of its first place, then its hash h1, h2) with n, how
    often it occurs; and pairs of nodes (a, b) of lines of at least ``LEAST_CHARS`` characters within ``edits`` edits of each other.

    The hash is part of the node, so rows that repeat a doc_id, or have none, keep their lines apart.
    """
    all_lines = _lines(docs)
    first = all_lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("place"), F.count(F.lit(1)).alias("n"))
    distinct = materialize(first.select(F.struct("place.doc_id", "place.line_no", "h1", "h2").alias("node"), "n"), "lines-distinct")
    length = F.length("line")
    # of a line that occurs again only its first place goes on; most lines occur once and need no look
    repeated = distinct.filter("n > 1").select(F.col("node.h1").alias("r1"), F.col("node.h2").alias("r2"), F.struct("node.doc_id", "node.line_no").alias("first"))
    again = stored(repeated, "lines-again")
    few = again.count() <= BROADCAST_LINES
    once = all_lines.filter(length >= LEAST_CHARS).join(F.broadcast(again) if few else again, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left")
    once = once.filter(F.col("first").isNull() | (F.col("first") == F.struct("doc_id", "line_no"))).select("h1", "line", F.col("first").isNotNull().alias("again"))
    once = materialize(_keyed(once, edits).select("h1", "again", "asked"), "lines-keyed")
    # a row that repeats as a whole has its lines at one place
    once = once.filter("NOT again").unionByName(once.filter("again").dropDuplicates()).drop("again")
    entries = _entries(once, edits)
    # different lines of one h1 meet under that hash, which no key tells apart
    shared = distinct.groupBy(F.col("node.h1").alias("x")).count().filter("count > 1").select("x", F.col("x").alias("y"))
    shared = stored(shared, "lines-shared")
    # the lines that share a key, once each; h1 alone may stand for several lines, which are then all compared
    wanted = stored(entries.select("h1").unionByName(shared.select(F.col("x").alias("h1"))).distinct(), "lines-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_HASHES else wanted
    nodes = stored(distinct.select("node", F.col("node.h1").alias("h1")).join(wanted, "h1", "left_semi").select("node"), "lines-nodes")
    texts = all_lines.filter(length >= LEAST_CHARS).join(wanted, "h1", "left_semi").select(F.struct("doc_id", "line_no", "h1", "h2").alias("node"), "line")
    texts = texts.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    texts = stored(texts.select("node", F.col("node.h1").alias("h1"), "line", _packed_counts(F.col("line")).alias("counts")), "lines-texts", 2_000)
    entries = stored(entries.join(texts.select("h1", "counts"), "h1"), "lines-counted")
    met = _meetings(entries, edits).unionByName(shared)
    ends = met.select(F.col("x").alias("h1")).unionByName(met.select(F.col("y").alias("h1"))).distinct()
    texts = stored(texts.join(ends, "h1", "left_semi").withColumn("counts", _counts(F.col("line"))), "lines-compared", 2_000)
    one = met.join(texts.select(F.col("h1").alias("x"), F.col("node").alias("a"), F.col("line").alias("s"), F.col("counts").alias("p")), "x")
    two = one.join(texts.select(F.col("h1").alias("y"), F.col("node").alias("b"), F.col("line").alias("t"), F.col("counts").alias("q")), "y")
    apart = F.aggregate(F.zip_with("p", "q", lambda x, y: F.abs(x - y)), F.lit(0), lambda n, x: n + x)
    two = two.filter((F.col("x") != F.col("y")) | (F.col("a") < F.col("b")))
    near = two.filter(apart <= 2 * edits).repartition(F.col("x"), F.col("y")).filter(within_edits(F.col("s"), F.col("t"), edits))
    return distinct, stored(near.select("a", "b").distinct(), "lines-links")


def line_duplicates(docs: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """(documents, dropped): a row for each doc_id, and each line to drop.

    Lines linked within ``edits`` edits, directly or through others, or equal, are a class; its first line by doc_id and line number
    (nulls first, ties by hash) stays. Lines under ``LEAST_CHARS`` characters are duplicates only if equal. ``documents``: doc_id,
    n_lines (with a word), n_kept, n_near (distinct lines first seen there with links) and n_links (their links to different
    lines). ``dropped``: doc_id, line_no and hash (h1, h2) of first places that are not kept, for lines that only resemble an
    earlier one. Null texts have no lines. Rows that repeat a doc_id, or have none, are counted in one row of ``documents``; their lines
    are told apart by the hash. Lines without a word always stay.
    """
    distinct, links = line_links(docs, edits)
    owner = components(links)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).join(owner, "node")
    degree = degree.select("node", "degree", (F.col("node") != F.col("component")).alias("later"))
    known = distinct.join(degree, "node", "left").select("node.*", "degree", F.coalesce("later", F.lit(False)).alias("later"))
    known = materialize(known, "lines-known")
    firsts = known.groupBy("doc_id").agg(
        F.count_if(~F.col("later")).alias("n_kept"), F.count("degree").alias("n_near"), F.coalesce(F.sum("degree"), F.lit(0)).cast("long").alias("n_links")
    )
    counts = F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), counts.cast("long").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_lines"))
    none = F.lit(0).cast("long")
    joined = lines.join(firsts.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")), "left")
    documents = joined.select("doc_id", "n_lines", *[F.coalesce(c, none).alias(c) for c in ("n_kept", "n_near", "n_links")])
    return documents, known.filter("later").select("doc_id", "line_no", "h1", "h2")


def without_duplicate_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` with each text rebuilt from the lines that stay; other columns as they were.

    A line stays where it is the first of its class, or holds no word. Rows with equal doc_id and text keep the same lines. A null text stays null.
    """
    distinct, links = line_links(docs, edits)
    owner = components(links).select("node", "component")
    kept = distinct.join(owner, "node", "left").filter("component IS NULL OR component = node").select("node")
    text, owned = F.col("text").cast("string"), F.col("doc_id").cast("long")
    keys = {"__k1": F.xxhash64(owned, text), "__k2": F.xxhash64(F.lit(9), owned, text)}
    lines = docs.filter(text.isNotNull()).select(owned.alias("doc_id"), *[k.alias(n) for n, k in keys.items()], F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    worded = F.regexp_like("line", F.lit(r"[^\x20\x09-\x0D]"))
    named = lines.filter(worded).withColumn("node", F.struct("doc_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(9), "line").alias("h2")))
    stay = named.join(kept, "node", "left_semi").select("__k1", "__k2", "line_no", "line")
    stay = stay.unionByName(lines.filter(~worded).select("__k1", "__k2", "line_no", "line"))
    # a set, so that equal rows give each line once
    made = stay.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_set(F.struct("line_no", "line"))).alias("__lines"))
    made = made.select("__k1", "__k2", F.array_join(F.col("__lines.line"), "\n").alias("__text"))
    rows = docs.withColumns(keys).join(made, ["__k1", "__k2"], "left")
    return rows.withColumn("text", F.when(text.isNotNull(), F.coalesce("__text", F.lit("")))).select(*[F.col(f"`{c}`") for c in docs.columns])
