"""Packing along a Hilbert curve: documents that are near in a projection of their token vectors share sequences."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored, strings
from .hashing import BASE, mix
from .tokens import PACK_END, crc, encoder

LENGTH = 4096
#: Dimensions of the projection and bits of each on the curve.
DIMS, BITS = 3, 10
#: Bytes of ids in a range, on average, at most.
RANGE = 128 << 20
#: By how much places are stretched before they are cut into cells.
SPREAD = 6.0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long"
#: A piece as ranges write it: its place in the range, and its ids where it has no sequence yet.
LEFT = PIECES + ", ids binary, range long, place long"
#: Ranges whose ends are packed together, some 16 MB.
TOGETHER = 1024
_DIRECTIONS: dict[int, np.ndarray] = {}


def directions(vocabulary: int) -> np.ndarray:
    """A pseudo-random number of mean 0 and variance 1, evenly spread, per token id and dimension, from hashes of both."""
    if vocabulary not in _DIRECTIONS:
        with np.errstate(over="ignore"):
            x = mix(np.arange(1, vocabulary * DIMS + 1, dtype=np.uint64) * BASE)
        u = (x >> np.uint64(11)).astype(np.float64) / (1 << 53)
        _DIRECTIONS[vocabulary] = (np.sqrt(12) * (u - 0.5)).astype(np.float32).reshape(vocabulary, DIMS)
    return _DIRECTIONS[vocabulary]


def project(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """A document's hashed token vector along DIMS directions: the mean direction of its tokens, zero without any."""
    return np.full(len(ids), 1 / len(ids), np.float32) @ directions(vocabulary).take(ids, 0) if len(ids) else np.zeros(DIMS, np.float32)


def cells(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cells of a cube with 2**bits cells a side; places near zero, where most are, are spread out."""
    unit = 0.5 + np.arctan(SPREAD * places.astype(np.float64)) / np.pi
    return np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def hilbert_key(cell: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows): fold the axes bit by bit, then interleave."""
    x = np.array(cell, np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(n):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[i] ^= swap
            x[0] ^= np.where(on, low, swap if i else 0)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ flip) >> b & 1)
    return key


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, curve_key, width, ids) of each row: its ids with id 2 at the end as bytes, and its place on the curve."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([PACK_END], enc.kind).tobytes()
        vocabulary = enc.known.library.get_vocab_size()
        for batch in batches:
            ids, places = [], np.zeros((batch.num_rows, DIMS), np.float32)
            for k, x in enumerate(strings(batch.column(1))):
                b = enc.encode(x)
                places[k] = project(np.frombuffer(b, enc.kind), vocabulary)
                ids.append(b + end)
            width = np.dtype(enc.kind).itemsize
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert_key(cells(places))), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "curve_key", "width", "ids"])

    return spread(rows).mapInArrow(run, "doc_id long, curve_key long, width int, ids binary")


def cut(pieces: Iterator[tuple], first: int, short: bool) -> Iterator[tuple]:
    """Lays (doc, doc_tokens, curve_key, start, ids) end to end and cuts them into sequences of LENGTH, numbered from first.

    Gives rows of PIECES and ids. What is left at the end becomes sequences whose lengths are powers of two, largest first, if short; else it
    comes with its ids and no sequence. Pieces are held back only while they lie in the sequence that isn't full yet.
    """
    full, used, open_pieces = first, 0, []

    def row(d, n, ck, start, part, sequence, offset, ids=None):
        return (d, start, len(part), crc(part), n, sequence, offset, ck, ids)

    for d, n, ck, start, x in pieces:
        while len(x):
            take = min(LENGTH - used, len(x))
            open_pieces.append((d, n, ck, start, x[:take]))
            used, start, x = used + take, start + take, x[take:]
            if used == LENGTH:
                at = 0
                for d2, n2, k2, s2, part in open_pieces:
                    yield row(d2, n2, k2, s2, part, full, at)
                    at += len(part)
                full, used, open_pieces = full + 1, 0, []
    if not short:
        yield from (row(*p, None, None, p[4].astype("<u4").tobytes()) for p in open_pieces)
        return
    room = at = 0
    for d, n, ck, start, part in open_pieces:
        while len(part):
            if at == room:  # the next sequence: the largest power of two within what is left
                full, at, room = full + (room > 0), 0, 1 << (used.bit_length() - 1)
                used -= room
            take = min(room - at, len(part))
            yield row(d, n, ck, start, part[:take], full, at)
            part, start, at = part[take:], start + take, at + take


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in schema.split(", ")]
    while held := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*held, strict=True), strict=False)], names=names)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """PIECES of all documents, packed into sequences of at most LENGTH ids in the order of the curve.

    The ids are written once to the shared folder, then dealt by ranges of (curve_key, doc_id, row), at least as many as there are shuffle
    partitions and as their size asks for, so that a hot key is split. Each range is one stream of ids cut every LENGTH ids. Less than LENGTH ids are left at
    its end; those of TOGETHER ranges in a row are one more stream, whose end is cut into sequences of powers of two. So no
    sequence has padding, and all but a dozen for each TOGETHER ranges are full, however many ranges there are. A sequence_id is the range's
    number, or beyond all of these that of TOGETHER ranges, and the sequence's in it.

    A null or empty text is its end id alone; bytes that aren't UTF-8 are encoded as U+FFFD. Repeated rows are packed each. Other columns
    are ignored. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    ids = stored(tokenized(docs, tokenizer, key, text))
    size = ids.agg(F.sum(F.length("ids"))).first()[0] or 0
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    order = ["curve_key", "doc_id", "uid"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc, ck, width, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.frombuffer(raw, f"<u{width}")
                yield doc, len(x), ck, 0, x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = ((*r, part, k) for k, r in enumerate(cut(read(batches), part << 40, False)))
        yield from _batches(rows, LEFT)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ends of ranges, in order, those of TOGETHER ranges in a row alike."""
        pieces = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
        for group, rows in groupby(pieces, lambda r: r[5] // TOGETHER):
            ends = ((d, n, ck, start, np.frombuffer(raw, "<u4")) for d, n, ck, start, raw, _ in rows)
            yield from _batches((r[:8] for r in cut(ends, (1 << 62) + (group << 40), True)), PIECES)

    dealt = ids.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    laid = stored(dealt.select("doc_id", "curve_key", "width", "ids").mapInArrow(run, LEFT))
    done = laid.filter("sequence_id is not null").select([x.split(" ")[0] for x in PIECES.split(", ")])
    ends = laid.filter("sequence_id is null").withColumn("together", F.floor(F.col("range") / TOGETHER))
    ends = ends.repartition("together").sortWithinPartitions("together", "range", "place")
    return done.unionByName(ends.select("doc_id", "doc_tokens", "curve_key", "start", "ids", "range").mapInArrow(again, PIECES))
