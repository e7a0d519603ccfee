"""N-grams of token arrays, counted and looked up for a whole Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are counted in one go; longer batches are cut between rows.
PIECE = 2_000_000


def _pieces(tokens: pa.ListArray) -> Iterator[pa.ListArray]:
    """The rows in runs of at most ``PIECE`` tokens, or a single row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(tokens):
        stop = max(start + 1, int(np.searchsorted(ends, done + PIECE, side="right")))
        yield tokens.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def _places(tokens: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All tokens, and the row of each."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    return tokens.flatten(), np.repeat(np.arange(len(tokens)), sizes)


def _following(at: np.ndarray, n: int, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which of the runs of n - 1 tokens from the places ``at`` have a known n-th token in their row."""
    last = at + n - 1
    inside = np.minimum(last, len(rows) - 1)
    return (last < len(rows)) & (rows[inside] == rows[at]) & (codes[inside] >= 0)


def count_grams(tokens: pa.ListArray, sizes: tuple[int, int], words: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """``(term, corpus_count, documents)`` of the n-grams for n from ``sizes[0]`` to ``sizes[1]``, once each for a piece of the rows.

    With ``words``, only n-grams made of these.
    """
    for piece in _pieces(tokens):
        flat, rows = _places(piece)
        if words is None:
            coded = flat.dictionary_encode()
            codes, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        else:
            codes, known = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64), words
        at, width = np.flatnonzero(codes >= 0), max(1, len(known))
        ids, names = codes[at], known
        for n in range(1, sizes[1] + 1):
            if n > 1:
                at, ids = (part[_following(at, n, rows, codes)] for part in (at, ids))
                pairs, ids = np.unique(ids * width + codes[at + n - 1], return_inverse=True)
                names = pc.binary_join_element_wise(names.take(pa.array(pairs // width)), known.take(pa.array(pairs % width)), " ")
            if n < sizes[0] or not len(at):
                continue
            total = np.bincount(ids, minlength=len(names))
            held = np.bincount(np.unique(rows[at] * len(names) + ids) % len(names), minlength=len(names))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(seen)), pa.array(total[seen], "int64"), pa.array(held[seen], "int64")], ["term", "corpus_count", "documents"]
            )


class Finder:
    """Finds the terms of a vocabulary in token arrays, along the words they start with."""

    def __init__(self, terms: list[str]):
        split = [t.split(" ") for t in terms]
        self.terms = pa.array(terms, "string")
        self.words = pa.array(sorted({w for t in split for w in t}), "string")
        code = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        before = {(): 0}
        for n in range(1, max(map(len, split), default=0) + 1):
            # starts of n words by (start of n - 1 words, word), and the term that each one is, or -1
            found = sorted({before[tuple(t[: n - 1])] * len(code) + code[t[n - 1]]: tuple(t[:n]) for t in split if len(t) >= n}.items())
            whole = {tuple(t): i for i, t in enumerate(split) if len(t) == n}
            self.steps.append((np.array([k for k, _ in found]), np.array([whole.get(start, -1) for _, start in found])))
            before = {start: i for i, (_, start) in enumerate(found)}

    def find(self, tokens: pa.ListArray) -> pa.ListArray:
        """For each row the terms that it holds, as often as it holds them."""
        flat, rows = _places(tokens)
        codes = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.flatnonzero(codes >= 0)
        ids = np.zeros(len(at), dtype=np.int64)
        hit_rows, hits = [rows[:0]], [ids[:0]]
        for n, (keys, term) in enumerate(self.steps, 1):
            at, ids = (part[_following(at, n, rows, codes)] for part in (at, ids))
            wanted = ids * len(self.words) + codes[at + n - 1]
            ids = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            same = keys[ids] == wanted
            at, ids = at[same], ids[same]
            whole = term[ids] >= 0
            hit_rows.append(rows[at[whole]])
            hits.append(term[ids[whole]])
        row, hit = np.concatenate(hit_rows), np.concatenate(hits)
        ends = np.cumsum(np.bincount(row, minlength=len(tokens)))
        found = self.terms.take(pa.array(hit[np.argsort(row, kind="stable")]))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), found)
