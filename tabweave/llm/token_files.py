"""Token ids in binary files: one frame a document, one dictionary for all, an offset index in each file.

A file holds, in this order: the magic ``TOKD``, a version byte, the width of an id in bytes, two zero
bytes, the SHA-256 of the dictionary (32 bytes), one zstandard frame a document (made with the shared
dictionary, from the ids as little-endian unsigned integers of that width), the index (doc_id, number of ids
and frame end of each document, as three little-endian int64 arrays, then one byte a document that is 1 if
its doc_id is null), and a footer: documents, index offset (int64), magic. A document is read by its index
row and one range of bytes. The dictionary lies beside the files and is checked by its hash.

Documents lie in ascending order of doc_id (null first, then by text hash and text among equal ids) within
a file and from file to file; the manifest, one row a file, gives the order and the ids before each file.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm.common import AttemptFile, filesystem, open_input, small_batches, small_files
from tabweave.session import materialize, scratch_path

MAGIC = b"TOKD"
HEAD = len(MAGIC) + 4 + 32
DICTIONARY_BYTES = 112_640
SAMPLE_DOCUMENTS = 1_000
SAMPLE_CHARS = 8_192
FILE_BYTES = 16 << 20
LEVEL = 3
#: Distinct words, and pieces of words, that a Python worker remembers, from one task to the next.
REMEMBERED = 300_000

# fixed values: below U+0250, the letters, numbers and the rest as the vocabulary's splitting rule divides them
_PLAIN = re.compile(r"[^\t\n\r -~\xa1-ɏ]")
_PIECES = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^\sa-zA-Z0-9\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ\xb2\xb3\xb9\xbc-\xbe]+"
)
# fixed values: the letters that stand for the bytes of a text in a byte-level vocabulary
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {chr(b): chr(b) for b in _SHOWN} | {chr(b): chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
_AS_LETTERS = str.maketrans(_BYTE_LETTERS)
_SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@dataclass(frozen=True)
class TokenFiles:
    """What was written: the manifest (one row a file) and the folder of the dictionary."""

    manifest: DataFrame
    dictionary_uri: str
    dictionary_sha256: str


class _Memory:
    """Results by key. When the new half is full the old half is forgotten; what is still in use moves to the new one."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def make(self, key: str, how: Callable[[str], bytes]) -> bytes:
        found = self._old.get(key)
        if found is None:
            found = how(key)
        self.new[key] = found
        return found

    def turn(self) -> None:
        if len(self.new) > REMEMBERED:
            self._old, self.new = self.new, {}


_memories: dict[str, tuple[_Memory, _Memory]] = {}


@functools.cache
def _loaded(path: str) -> tuple:
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        return Tokenizer.from_file(path), json.load(f)


class Encoder:
    """Ids of whole texts by a tokenizers file, as little-endian bytes, with an end id after each text.

    A vocabulary that lower-cases, drops white space and splits by words encodes each piece of a word by itself. For it,
    texts of plain Latin characters are cut at white space, and each word is encoded when it is first met; others go
    to the library whole. Other vocabularies always get whole texts. The ids are the same either way.
    """

    def __init__(self, path: str, end_id: int):
        self._tokenizer, rules = _loaded(path)
        self._model = self._tokenizer.model
        size = max(self._tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.kind = np.dtype("<u2") if size <= 65_536 else np.dtype("<u4")
        self._end = np.array([end_id], self.kind).tobytes()
        self._by_words = self._independent(rules)
        self._words, self._pieces = _memories.setdefault(path, (_Memory(), _Memory()))

    @staticmethod
    def _independent(rules: dict) -> bool:
        steps = [s.get("type") for s in (rules.get("normalizer") or {}).get("normalizers", [])]
        cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            steps == ["NFC", "Replace", "Lowercase"]
            and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0].get("pattern", {}).get("Regex") == _SPLIT_RULE
            and cuts[1].get("use_regex") is False
            and cuts[1].get("add_prefix_space") is False
            and all("<|" in t["content"] for t in rules.get("added_tokens", []))
        )

    def _ids(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind.itemsize == 2 else 'I'}", *ids)

    def _piece(self, piece: str) -> bytes:
        return self._ids([t.id for t in self._model.tokenize(piece.encode().decode("latin-1").translate(_AS_LETTERS))])

    def _word(self, word: str) -> bytes:
        known = self._pieces.new
        return b"".join([known[p] if p in known else self._pieces.make(p, self._piece) for p in _PIECES.findall(word)])

    def __call__(self, text: str) -> bytes:
        if not self._by_words or "<|" in text or _PLAIN.search(text):
            return self._ids(self._tokenizer.encode(text, add_special_tokens=False).ids) + self._end
        words = text.lower().split()
        made = list(map(self._words.new.get, words))
        if None in made:
            self._words.turn()
            self._pieces.turn()
            known = self._words.new
            made = [m if m is not None else known.get(w) or self._words.make(w, self._word) for w, m in zip(words, made)]
        return b"".join(made) + self._end


def _encoded(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, end_id)
        for part in parts:
            yield pa.record_batch({"ids": pa.array([encode(t.as_py() or "") for t in part.column("text")], pa.binary())})

    return run


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from the id arrays of the sampled documents, or nothing if they are too few.

    The sample: the ``SAMPLE_DOCUMENTS`` documents of at most ``SAMPLE_CHARS`` characters with the smallest hash of
    doc_id and text. At most 8 million characters reach the driver, whatever the input's size.
    """
    spark = docs.sparkSession
    order = F.xxhash64("doc_id", "text", F.lit(10))
    few = docs.filter(F.length("text").between(1, SAMPLE_CHARS)).orderBy(order).limit(SAMPLE_DOCUMENTS).select("text")
    small_batches(spark)
    samples = sorted(bytes(r.ids) for r in few.mapInArrow(_encoded(tokenizer, end_id), "ids binary").collect())
    samples = [s for s in samples if len(s) >= 8]
    try:
        size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 4)
        trained = zstandard.train_dictionary(size, samples, k=64, d=8, level=LEVEL)
    except (zstandard.ZstdError, ValueError):  # too few or too equal samples: frames without a dictionary
        return b""
    return trained.as_bytes()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, file_bytes: int = FILE_BYTES) -> TokenFiles:
    """Encode every text and write the files; see the module for their form.

    Reads the columns ``doc_id`` and ``text`` alone; others, whatever their names, are ignored. A null text is
    empty and yields the end id. Rows with equal or null ids are documents of their own. A table without rows
    yields no file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = scratch_path(spark, "token-files")
    raw = train_dictionary(docs, tokenizer, end_id)
    sha = hashlib.sha256(raw).digest()
    uri = f"{folder}/dictionary-{sha.hex()[:16]}"
    store, path = filesystem(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(raw)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, number = Encoder(tokenizer, end_id), None, TaskContext.get().partitionId()
        shared = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, **shared)
        ids, counts, ends = [], [], []
        for part in parts:
            if part.num_rows and out is None:
                out = AttemptFile(folder, f"tokens-{number:07d}")
                out.write(MAGIC + bytes([1, encode.kind.itemsize, 0, 0]) + sha)
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                encoded = encode(text.as_py() or "")
                out.write(pack.compress(encoded))
                ids.append(doc)
                counts.append(len(encoded) // encode.kind.itemsize)
                ends.append(out.size)
        if out is None:
            return
        at = out.size
        out.write(np.array([i or 0 for i in ids], "<i8").tobytes())
        out.write(np.array(counts, "<i8").tobytes() + np.array(ends, "<i8").tobytes())
        out.write(bytes(i is None for i in ids))
        out.write(np.array([len(ids), at], "<i8").tobytes() + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pylist(
            [{"file": out.uri, "part": number, "documents": len(ids), "ids": sum(counts), "bytes": out.size}],
            schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]),
        )

    keyed = docs.withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(small_files(docs, file_bytes), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    files = dealt.select("doc_id", "text").mapInArrow(write, "file string, part int, documents long, ids long, bytes long")
    files = materialize(files, "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    manifest = files.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    return TokenFiles(manifest, uri, sha.hex())


class TokenReader:
    """One file: its index, and single documents by their place in it."""

    def __init__(self, uri: str, dictionary: bytes):
        self._in = open_input(uri)
        size = self._in.size()
        tail = self._in.read_at(20, size - 20)
        head = self._in.read_at(HEAD, 0)
        if tail[16:] != MAGIC or head[:4] != MAGIC or head[4] != 1:
            raise ValueError(f"{uri} is not a token file")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.kind = np.dtype(f"<u{head[5]}")
        n, at = np.frombuffer(tail[:16], "<i8")
        raw = self._in.read_at(int(n) * 25, int(at))
        self.doc_ids, self.counts, self.ends = np.frombuffer(raw[: 24 * n], "<i8").reshape(3, n)
        self.missing = np.frombuffer(raw[24 * n :], np.uint8).astype(bool)
        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self._unpack = zstandard.ZstdDecompressor(**shared)

    def ids(self, k: int) -> np.ndarray:
        start = HEAD if k == 0 else int(self.ends[k - 1])
        frame = self._in.read_at(int(self.ends[k]) - start, start)
        got = np.frombuffer(self._unpack.decompress(frame), self.kind)
        if len(got) != self.counts[k]:
            raise ValueError("a frame holds another number of ids than its index row says")
        return got

    def close(self) -> None:
        self._in.close()


def read_dictionary(files: TokenFiles) -> bytes:
    with open_input(files.dictionary_uri) as f:
        raw = f.read()
    if hashlib.sha256(raw).hexdigest() != files.dictionary_sha256:
        raise ValueError("the dictionary file has changed")
    return raw


def token_digests(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids), file and place."""
    raw = read_dictionary(files)
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, place long"
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string()), ("place", pa.int64())])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                source = TokenReader(row["file"], raw)
                starts = row["ids_before"] + np.concatenate([[0], np.cumsum(source.counts)[:-1]]).astype(np.int64)
                for a in range(0, len(starts), 4096):
                    places = range(a, min(a + 4096, len(starts)))
                    crc = [zlib.crc32(source.ids(k).astype("<u4").tobytes()) for k in places]
                    cut = slice(a, a + 4096)
                    yield pa.record_batch(
                        [
                            pa.array(source.doc_ids[cut], mask=source.missing[cut]),
                            pa.array(starts[cut]),
                            pa.array(source.counts[cut]),
                            pa.array(crc, pa.int64()),
                            pa.array([row["file"]] * len(places)),
                            pa.array(places, pa.int64()),
                        ],
                        schema=schema,
                    )
                source.close()

    rows = files.manifest.select("file", "ids_before")
    return rows.repartition(max(1, files.manifest.count())).mapInArrow(read, kinds)
