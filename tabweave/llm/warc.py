"""Dictionary-compressed WARC files: one zstandard frame a record, the dictionary in a leading skippable frame.

A file begins with a skippable frame (magic 0x184D2A5D) that holds a zstandard dictionary built from records of
that file; each record, the warcinfo first, is one frame compressed with it. A reader needs nothing but the
file, and a record can be read by its offset alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import AttemptFile, open_input, small_batches
from tabweave.session import materialize, scratch_path

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 112_640
#: The dictionary of a file is trained on the first records of that file, up to this many bytes; all are written with it.
TRAINING_BYTES = 4 << 20
LEVEL = 3
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def record_types(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, size, record_type and refers_to of every page.

    Of pages with equal payloads of at least ``least_bytes`` bytes, those with the smallest page_id are responses and the
    others revisit it. A null page_id comes after all others; a null html is an empty payload. Rows that repeat the
    smallest page_id are all responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    # only digests that occur again go on; the counts combine before the shuffle, however often one digest occurs
    again = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = materialize(again.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "warc-repeats")
    joined = rows.join(again, "digest", "left")
    repeat = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("size") >= least_bytes)
    return joined.select(
        "page_id", "url", "payload", "digest", "size",
        F.when(repeat, "revisit").otherwise("response").alias("record_type"),
        F.when(repeat, F.col("first")).alias("refers_to"),
    )


def _uri(url: str) -> str:
    """A url in a header: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit carries the response's HTTP header without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
        return zstandard.train_dictionary(size, samples, k=256, d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too equal records
        return b""


def write_warc(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every page as a record; returns the manifest, one row a file: file, records, bytes.

    Reads page_id, url and html; other columns are ignored. ``date`` is the capture date of the records, as the table has none.
    A task writes one file; a table without rows gives none.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "warc")
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pack = None
        waiting, held, records = [], 0, 0

        def begin() -> None:
            nonlocal out, pack
            raw = _dictionary([w[:65_536] for w in waiting])
            pack = zstandard.ZstdCompressor(level=LEVEL, **({"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}))
            out = AttemptFile(folder, f"part-{TaskContext.get().partitionId():07d}.warc.zst")
            if raw:
                frame = zstandard.ZstdCompressor(level=19).compress(raw)
                out.write(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
            info = b"software: tabweave\r\nformat: WARC file version 1.1\r\n"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:sha256:{hashlib.sha256(raw).hexdigest()}>\r\nWARC-Date: {date}\r\n"
            head += f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            out.write(pack.compress(head.encode() + info + b"\r\n\r\n"))
            for w in waiting:
                out.write(pack.compress(w))

        for part in parts:
            names = ("page_id", "url", "digest", "refers_to")
            for page, url, digest, refers, payload in zip(*[part.column(c).to_pylist() for c in names], part.column("payload"), strict=True):
                made = record(page, url, payload.as_py(), digest, refers, date)
                records += 1
                if out is None:
                    waiting.append(made)
                    held += len(made)
                    if held >= TRAINING_BYTES:
                        begin()
                        waiting = []
                else:
                    out.write(pack.compress(made))
        if records:
            if out is None:
                begin()
            out.close()
            yield pa.record_batch([[out.uri], [records], [out.size]], schema=schema)

    made = record_types(pages).select("page_id", "url", "payload", "digest", "refers_to")
    return materialize(made.mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


def read_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one file, read frame by frame."""
    with open_input(uri) as source:
        head = source.read(8)
        raw = b""
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(source.read(struct.unpack("<I", head[4:])[0]))
            head = b""
        unpack = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}))
        rest = head
        frame, pieces = unpack.decompressobj(), []
        while True:
            chunk = rest or source.read(1 << 20)
            rest = b""
            if not chunk:
                break
            pieces.append(frame.decompress(chunk))
            if frame.eof:
                rest = frame.unused_data
                yield parse_record(b"".join(pieces))
                frame, pieces = unpack.decompressobj(), []
        if any(pieces):
            raise ValueError(f"{uri} ends inside a record")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def _id(value: str | None) -> int | None:
    return int(value[len(_ID) + 1 : -1]) if value and len(value) > len(_ID) + 2 else None


def read_warc(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes and payload_digest of every page record, and its payload (null for a revisit).

    A response's size and digest are computed from its payload and must agree with its headers; a revisit has them from its
    headers.
    """
    small_batches(spark)
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    )

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for uri in part.column("file").to_pylist():
                rows, held = [], 0
                for fields, block in read_records(uri):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    full = fields["WARC-Type"] == "response"
                    if full and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"a payload in {uri} doesn't have the digest of its header")
                    rows.append((_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], _id(fields.get("WARC-Refers-To")), size, digest, payload if full else None))
                    held += len(payload)
                    if len(rows) >= 256 or held >= 8 << 20:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    kinds = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(read, kinds)
