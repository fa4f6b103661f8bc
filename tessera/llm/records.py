"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A data file holds records one after another: length of the payload (8 bytes, unsigned), masked crc32 of those bytes (4),
payload, masked crc32 of the payload (4). All numbers are little-endian. The payload of a document is: 1 if it has an
id else 0 (1 byte), doc_id (8, signed), width of an id (1: 2 or 4 bytes), ids. An index file beside it has for
each record its offset (8) and its number of ids (4), so that records can be read in any order.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import strings
from .tokens import END_OF_TEXT, crc, encoder

_HEAD, _TAIL, _META, _ENTRY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<BqB"), struct.Struct("<QI")
#: Bytes that a reader holds at once, unless one record is longer.
BLOCK = 1 << 22
MANIFEST = "part long, path string, n_records long, n_tokens long"


def masked(data: bytes) -> int:
    """crc32, rotated and shifted, so that a checksum of data that holds checksums stays sound."""
    x = zlib.crc32(data)
    return ((x >> 15 | x << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _TAIL.pack(masked(length)), payload, _TAIL.pack(masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload that begins at a place, and the place after its record. Raises ValueError where a checksum is wrong."""
    length, check = _HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"the length at {at} is damaged")
    start = at + _HEAD.size
    payload = data[start : start + length]
    if masked(payload) != _TAIL.unpack_from(data, start + length)[0]:
        raise ValueError(f"the record at {at} is damaged")
    return payload, start + length + _TAIL.size


def _open(path: str):
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    return fs, at


def payload_of(key: int | None, width: int, ids: bytes) -> bytes:
    return _META.pack(key is not None, key or 0, width) + ids


def index_entry(offset: int, n: int) -> bytes:
    return _ENTRY.pack(offset, n)


def write_records(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text") -> list[dict]:
    """Encodes every whole text, ends it with id 1 and writes records in ascending key order under path. Returns the manifest.

    Rows are dealt by ranges of the key and a hash of the text and sorted by them (nulls first). Bytes that aren't UTF-8 are encoded as U+FFFD. Each task streams
    its range into a data and an index file of a new name, so that a task which runs again leaves no broken file: only
    names in the manifest count. The manifest has one entry per file; it is also written to path/manifest.json. A null or
    empty text is a record of the end id alone. Repeated rows are records of their own; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # rows of one key, or without one, and even equal rows are dealt to several ranges
    order = [F.col("key"), F.xxhash64("text"), F.col("uid")]
    dealt = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        width, end = np.dtype(enc.kind).itemsize, np.array([END_OF_TEXT], enc.kind).tobytes()
        name = f"{path}/part-{part:06d}-{uuid.uuid4().hex}"
        fs, at = _open(name)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        n = tokens = offset = 0
        with fs.open_output_stream(f"{at}.records") as data, fs.open_output_stream(f"{at}.index") as index:
            for batch in batches:
                for i, x in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                    ids = enc.encode(x) + end
                    record = frame(payload_of(i, width, ids))
                    data.write(record)
                    index.write(index_entry(offset, len(ids) // width))
                    offset += len(record)
                    tokens += len(ids) // width
                    n += 1
        if n:
            yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "n_records": n, "n_tokens": tokens}])
        else:
            fs.delete_file(f"{at}.records")
            fs.delete_file(f"{at}.index")

    manifest = sorted((r.asDict() for r in dealt.mapInArrow(run, MANIFEST).collect()), key=lambda r: r["part"])  # one row per file
    fs, at = _open(path)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(path: str) -> list[dict]:
    fs, at = _open(f"{path}/manifest.json")
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())


def _records(name: str) -> Iterator[bytes]:
    """Payloads of a data file in order, by blocks that the index gives."""
    fs, at = _open(name)
    with fs.open_input_file(f"{at}.index") as f:
        offsets = np.frombuffer(f.read(), np.dtype([("offset", "<u8"), ("n", "<u4")]))["offset"]
    with fs.open_input_file(f"{at}.records") as f:
        ends = np.append(offsets[1:], f.size())
        i = 0
        while i < len(offsets):
            j = max(i + 1, int(np.searchsorted(ends, offsets[i] + BLOCK, "right")))
            f.seek(int(offsets[i]))
            block, here = f.read(int(ends[j - 1] - offsets[i])), 0
            for _ in range(j - i):
                payload, here = unframe(block, here)
                yield payload
            i = j


def payload_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, key, width = _META.unpack_from(payload)
    return key if known else None, np.frombuffer(payload, f"<u{width}", offset=_META.size)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Reads the files under path back: per record doc_id, n_tokens, ids_crc32, its place, and start, the number of ids in all records before it."""
    manifest = read_manifest(path)
    before, rows = 0, []
    for r in manifest:
        rows.append((r["part"], r["path"], before))
        before += r["n_tokens"]
    files = spark.createDataFrame(rows, "part long, path string, before long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                start, out = r["before"], []
                for k, payload in enumerate(_records(r["path"])):
                    key, ids = payload_ids(payload)
                    out.append((key, start, len(ids), crc(ids), r["part"], k))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "part", "record"]

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    dealt = files.repartitionByRange(max(1, len(rows)), "part")
    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))
