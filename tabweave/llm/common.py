"""What several operators of this package share: batches, word hashes on bytes, files in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabweave.session import materialize

BATCH_ROWS = 256
CHUNK_BYTES = 2 << 20

# fixed values: the characters that do not belong to a word, as byte tables over UTF-8
_SPACES = [0x20, *range(0x09, 0x0E)]
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32
SPACED = np.ones(256, dtype=bool)
SPACED[_SPACES] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: texts are long, and a batch is what a Python worker holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def stored(df: DataFrame, name: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """A table in the shared folder, read back in as few tasks as its rows need: many steps over few rows stay cheap."""
    table = materialize(df, name)
    return table.coalesce(max(1, -(-table.count() // rows_per_task)))


def small_files(df: DataFrame, bytes_per_task: int) -> int:
    """Number of tasks for a stage that makes one file a task, from the size Spark's statistics give the input.

    Where the statistics know nothing (they then give a size no table has), it is the session's number of shuffle partitions.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // bytes_per_task))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK_BYTES * 2), base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        _powers[base] = known
    return known[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, A-Z lower-cased, and where each row's words begin.

    ``table`` says which bytes, after lower-casing, belong to words. A word's hash depends on its bytes
    alone. Works on pieces of about two megabytes that end outside words, so a long text needs no more
    memory than its bytes and one number a word.
    """
    found, begins, n, at = [], [], len(data), 0
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    while at < n:
        end = min(n, at + CHUNK_BYTES)
        low = _LOW[data[at:end]]
        inside = table[low]
        if end < n:
            out = np.flatnonzero(~inside)
            if len(out) == 0:
                end = _word_end(data, offsets, table, end)
                low = _LOW[data[at:end]]
                inside = table[low]
            else:
                end = at + int(out[-1]) + 1
                low, inside = low[: out[-1] + 1], inside[: out[-1] + 1]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        start = np.flatnonzero(inside & (~before | edge[at:end]))
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        stop = np.flatnonzero(inside & (~after | edge[at + 1 : end + 1])) + 1
        total = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power(_P, len(low)), out=total[1:])
        found.append(mix64((total[stop] - total[start]) * _power(_P_INVERSE, len(low) + 1)[start]))
        begins.append(start + at)
        at = end
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    places = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return hashes, np.searchsorted(places, offsets)


def _word_end(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, at: int) -> int:
    """First place from ``at`` on that is outside a word or where a row begins."""
    row = offsets[np.searchsorted(offsets, at)]
    while at < row:
        out = np.flatnonzero(~table[_LOW[data[at : min(row, at + CHUNK_BYTES)]]])
        if len(out):
            return at + int(out[0])
        at = min(row, at + CHUNK_BYTES)
    return int(row)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def batches(table: pa.Table, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches(max_chunksize=rows)


def filesystem(uri: str):
    """pyarrow's file system for a folder or file of the shared store, and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class AttemptFile:
    """A file that one task attempt writes under a name of its own.

    Only the manifest row of a successful attempt names the file, so what a lost or repeated attempt
    left behind is never read.
    """

    def __init__(self, folder: str, stem: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}"
        self._fs, path = filesystem(self.uri)
        self._fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self._out = self._fs.open_output_stream(path, compression=None)
        self.size = 0

    def write(self, piece: bytes) -> int:
        """Returns the offset at which the piece begins."""
        at = self.size
        self._out.write(piece)
        self.size += len(piece)
        return at

    def close(self) -> None:
        self._out.close()


def open_input(uri: str):
    store, path = filesystem(uri)
    return store.open_input_file(path)
