"""Spelling variants: words one edit from a much more frequent one, found on a bit-sliced position index.

A block of the vocabulary is an index with a bitset for each (position, letter): bit w says that word w has this letter there. All
words of the block are asked at once, letter by letter. For each question two sets of words are carried on: those equal to what was read
(zero errors), and those one edit away (one error), the latter for a replaced letter at the same position and for a letter
more in the word at the position after. A step is a few operations on 64-word slots, and at the end the sets of one error are the near
words. A letter less is the same pair seen from the other word.

Words meet only where they can be near: one edit leaves the first or the second half of the shorter word unchanged, so a block holds groups of
words with one half in common, and a question reads the slots of its own group. A group larger than a block is
dealt to several; its questions go to each, its words to one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import small_batches, stored
from tabweave.session import materialize

# fixed values of the task: which runs are changed, and what a word and a form need
CHANGED = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
FORM_TIMES = 5

#: Bytes of a text whose runs are held at once, and different words a task counts before it passes them on.
PIECE = 1 << 20
HELD_WORDS = 200_000
#: Words and letters of a block of the index, and (question, slot) pairs that are asked together.
BLOCK_WORDS, BLOCK_LETTERS = 1 << 14, 1 << 22
ASKED = 1 << 16
#: Positions of the index held at once.
WINDOW = 32

# A-Z, a-z and U+00C0 to U+00FF, in UTF-8
_RUN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+")
_OTHER = re.compile(rb"[^A-Za-z\x80-\xBF\xC3]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end outside runs."""
    at = 0
    while at < len(text):
        found = _OTHER.search(text, at + PIECE)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def runs_of(text: bytes) -> Counter:
    """How often a text has each run, A-Z lower-cased."""
    found: Counter = Counter()
    for piece in _pieces(text):
        found.update(_RUN.findall(piece.lower()))  # of bytes: A-Z only
    return found


def _changed(prefix: bytes, run: bytes) -> str:
    h = zlib.crc32(prefix + run)
    letters = run.decode()
    if h % CHANGED == 0:
        at = h % len(letters)
        letters = letters[:at] + letters[at + 1 :]
    return letters


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n: how often the documents have each word of enough letters, after the planted deletions."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for part in parts:
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                prefix = f"{'' if doc is None else doc}:".encode()
                for run_, n in runs_of(text.as_py() or b"").items():
                    if len(run_) >= LEAST_LETTERS:  # at least as many bytes as letters
                        word = _changed(prefix, run_)
                        if len(word) >= LEAST_LETTERS:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        if held:
            yield out()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class PositionIndex:
    """Bitsets of a block of words for each (position, letter)."""

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        self.width = int(self.length.max(initial=0))
        self.letters, coded = np.unique(_points(words, self.width), return_inverse=True)
        self.chars = coded.reshape(len(words), self.width).astype(np.int32)
        self.slots = -(-len(words) // 64)
        place = np.arange(len(words))
        self.slot, self.bit = place // 64, np.uint64(1) << (place % 64).astype(np.uint64)
        self.at, self.table = -1, None

    def coded(self, words: list[str], width: int) -> np.ndarray:
        """Words as rows of letter numbers; letters that the index has not get a number of their own."""
        points = _points(words, width)
        at = np.searchsorted(self.letters, points)
        at[at == len(self.letters)] = 0
        return np.where(self.letters[at] == points, at, len(self.letters))

    def holding(self, chosen: np.ndarray) -> np.ndarray:
        """The bitset of chosen words."""
        out = np.zeros(self.slots, np.uint64)
        np.bitwise_or.at(out, self.slot[chosen], self.bit[chosen])
        return out

    def rows(self, position: int) -> np.ndarray:
        """Bitsets (letter, slot) at a position; past the longest word there are none."""
        if self.table is None or not self.at <= position < self.at + len(self.table):
            self.at = position - position % WINDOW
            self.table = np.zeros((WINDOW, len(self.letters) + 1, self.slots), np.uint64)
            for p in range(self.at, min(self.at + WINDOW, self.width)):
                here = np.flatnonzero(self.length > p)
                np.bitwise_or.at(self.table[p - self.at], (self.chars[here, p], self.slot[here]), self.bit[here])
        return self.table[position - self.at]

    def near(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (question, word) one edit apart, the word as long as the question or one letter longer.

        Questions are rows of ``chars``, all of one length; each is asked of the words ``start`` to ``end``, without the last.
        """
        m = chars.shape[1]
        equal, longer = self.holding(self.length == m), self.holding(self.length == m + 1)
        many = np.where(end > start, (end - 1) // 64 - start // 64 + 1, 0)
        total = np.cumsum(many)
        cuts = np.searchsorted(total, np.arange(ASKED, (total[-1] if len(total) else 0) + ASKED, ASKED), side="right")
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chars)]):
            n = many[a:b]
            q = np.repeat(np.arange(a, b), n)
            if not len(q):
                continue
            s = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + start[q] // 64
            low, high = np.clip(start[q] - s * 64, 0, 63), np.clip(end[q] - s * 64, 1, 64)
            range_ = (_ALL << low.astype(np.uint64)) & (_ALL >> (64 - high).astype(np.uint64))
            zero = (equal | longer)[s] & range_
            replaced, more = np.zeros_like(zero), np.zeros_like(zero)
            here = self.rows(0)[chars[q, 0], s]
            for k in range(m):
                after = self.rows(k + 1)[chars[q, k], s]  # this letter, one position later in the word
                onward = self.rows(k + 1)[chars[q, k + 1], s] if k + 1 < m else None
                replaced = (replaced & here) | (zero & ~here)
                more = (more | zero) & after
                zero, here = zero & here, onward
            hits = (replaced & equal[s]) | ((more | zero) & longer[s])
            some = np.flatnonzero(hits)
            bits = np.unpackbits(hits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(bits)
            yield q[some[row]], s[some[row]] * 64 + bit


_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _points(words: list[str], width: int) -> np.ndarray:
    """Code points of words, zeros behind the last."""
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)


def _asking(words: list[str], n: np.ndarray, groups: np.ndarray, asks: np.ndarray, member: np.ndarray, second: np.ndarray, size: int) -> pa.RecordBatch:
    """For each word of a block its near words there: how many, and the one with most occurrences.

    Words that ask are ``size`` letters long; members have as many or one more, and are sought by those of their group. ``second`` marks groups by
    the second half: what also agrees in the first half was found there.
    """
    members, asked = np.flatnonzero(member), np.flatnonzero(asks)
    index = PositionIndex([words[k] for k in members])
    start, end = (np.searchsorted(groups[members], groups[asked], side=side) for side in ("left", "right"))
    first_half = np.array([w[: size // 2] for w in words])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda k: (-n[k], words[k]))] = np.arange(len(words))
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for q, w in index.near(index.coded([words[k] for k in asked], size), start, end):
        q, w = asked[q], members[w]
        new = ~(second[q] & (first_half[q] == first_half[w]))
        q, w = q[new], w[new]
        longer = index.length[np.searchsorted(members, w)] > size
        # words of one length ask for each other; of two lengths only the shorter one asks
        for x, y in ((q, w), (w[longer], q[longer])):
            np.add.at(count, x, 1)
            np.minimum.at(best, x, rank[y])
    at = np.flatnonzero(count)
    form = np.argsort(rank)[best[at]]
    columns = [pa.array([words[k] for k in at], pa.string()), pa.array(count[at]), pa.array([words[k] for k in form], pa.string()), pa.array(n[form])]
    return pa.record_batch(columns, names=["word", "n_near", "form", "form_n"])


def _block_words(size: int) -> int:
    return max(64, min(BLOCK_WORDS, BLOCK_LETTERS // max(size, 1)))


def _blocks(table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
    """What the whole groups of a sorted table find, and the rows that are left: the last group, which may go on."""
    columns = [table.column(c).to_numpy() for c in ("size", "second", "half", "block")]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.append(np.flatnonzero(new), table.num_rows)
    if not last:
        starts = starts[:-1]
    sizes, at, made = columns[0], 0, []
    while at < starts[-1]:
        # as many whole groups as make a block, one at least, all with one size
        fit = np.searchsorted(starts, at + _block_words(int(sizes[at])), side="right") - 1
        stop = int(starts[max(fit, np.searchsorted(starts, at) + 1)])
        stop = min(stop, at + int(np.searchsorted(sizes[at:stop], sizes[at], side="right")))
        part = table.slice(at, stop - at)
        n, asks, member, second = (part.column(c).to_numpy() for c in ("n", "asks", "member", "second"))
        made.append(_asking(part.column("word").to_pylist(), n, np.cumsum(new[at:stop]), asks, member, second, int(sizes[at])))
        at = stop
    return made, table.slice(int(starts[-1]))


_NEAR_SQL = "word string, n_near long, form string, form_n long"


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n for those of ``words`` (word, n; no word twice) that have a word one edit away.

    n_near is the number of such words, form the one of them with the largest n, ties the smallest by code points.
    """
    kept = words.select("word", "n", F.char_length("word").alias("m")).filter("m > 0")
    halves = []
    for shorter in (F.col("m"), F.col("m") - 1):
        half = F.floor(shorter / 2).cast("int")
        for second, key in ((False, F.substring(F.col("word"), F.lit(1), half)), (True, F.expr("reverse(word)").substr(F.lit(1), shorter - half))):
            halves.append(F.struct(shorter.alias("size"), F.lit(second).alias("second"), key.alias("half"), (shorter == F.col("m")).alias("asks")))
    rows = materialize(kept.select("word", "n", F.inline(F.array(*halves))), "spelling-halves")
    keys = ["size", "second", "half"]
    most = F.greatest(F.lit(64), F.least(F.lit(BLOCK_WORDS), F.floor(F.lit(BLOCK_LETTERS) / F.greatest(F.col("size"), F.lit(1)))))
    crowded = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).withColumn("blocks", F.ceil(F.col("c") / most)).filter("blocks > 1").drop("c")
    crowded = stored(crowded, "spelling-crowded")
    # a row for a block's words at least; Spark sees the size of the stored table and chooses the join
    dealt = rows.join(crowded, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).alias("block")
    alone = dealt.filter("blocks = 1").select(*keys, "word", "n", "asks", F.lit(True).alias("member"), F.lit(0).cast("long").alias("block"))
    spread = dealt.filter("blocks > 1")
    several = spread.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).filter("asks OR block = own")
    several = several.select(*keys, "word", "n", "asks", (F.col("block") == F.col("own")).alias("member"), "block")
    order = [*keys, "block"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            held.append(part)
            if sum(p.num_rows for p in held) >= 2 * BLOCK_WORDS:
                made, left = _blocks(pa.Table.from_batches(held).combine_chunks(), False)
                yield from made
                held = left.to_batches()
        if held:
            yield from _blocks(pa.Table.from_batches(held).combine_chunks(), True)[0]

    every = alone.unionByName(several).repartition(*order).sortWithinPartitions(*order, "word")
    found = every.mapInArrow(run, _NEAR_SQL)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form", "form_n"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", "b.form_n")


def spelling_forms(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with n_near, form, form_n and root.

    A word's form is its near word with the largest n, ties the smallest by code points, if that n is at least ``FORM_TIMES`` times the
    word's; root is where forms lead to, the word itself if it has none. Each step multiplies n, so they end.
    """
    known = words.join(near_words(words), "word", "left")
    far = F.col("form_n") >= FORM_TIMES * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n"))
    known = materialize(known, "spelling-known")
    led = stored(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-led")
    while True:  # the way doubles each round
        onward = led.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(led.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-led")
        led = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    out = known.join(led, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Every word of ``docs`` with form, root, n, n_near and form_n.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; a run whose crc32 with its doc_id is a multiple of
    ``CHANGED`` loses a letter. Words of at least ``LEAST_LETTERS`` letters count if all documents together have them ``LEAST_COUNT`` times.
    A null doc_id is an empty text in the crc32; a null text has no words. Rows that repeat count again. Other columns are
    ignored; a table without words gives no rows.
    """
    words = stored(word_counts(docs).filter(F.col("n") >= LEAST_COUNT), "spelling-words")
    return spelling_forms(words)
