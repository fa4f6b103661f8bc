"""N-gram Jaccard join with Bayesian candidate pruning: MinHash values compared step by step, survivors verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .blocks import LINKS, by_unit, column, links_batch, pairs, units
from .common import fresh, spread, stored, texts
from .components import components
from .hashing import BASE, mix, ngram_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values of a set, and the chance that a pair at the threshold shares no band of them.
VALUES, MISS = 160, 4e-6
#: MinHash values compared between two looks at the posterior, and the chance of a link below which a pair goes.
STEP, TOLERANCE = 32, 1e-6
#: Pairs whose whole sketches are compared in one go, so that these stay small.
SLICE = 1 << 14
_SKETCH = "key long, d1 long, d2 long, sketch binary"


def shingles(b: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words of a text; a shorter text is one shingle, one without words none."""
    words = word_hashes(np.frombuffer(b, np.uint8))
    if not len(words):
        return words
    return np.unique(ngram_hashes(words, min(SHINGLE, len(words))))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * BASE)
    return (x[:VALUES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[VALUES:] >> np.uint64(32)).astype(np.uint32)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of a set, 16 bits of each."""
    mul, add = _permutations()
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        y = low[at : at + 256, None] * mul + add
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(best, y.min(0), out=best)
    best = best.astype(np.uint64)
    return (mix(best) >> np.uint64(48)).astype(np.uint16)


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    n = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        a = mix((mix(hashes).sum(dtype=np.uint64) + n).reshape(1))
        b = mix((mix(hashes ^ BASE).sum(dtype=np.uint64) ^ n).reshape(1))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each STEP values the fewest matches with which the posterior chance of reaching the threshold is tolerance or more.

    From a uniform prior, n values with m matches leave Beta(m + 1, n - m + 1), whose mass above t is the chance that a
    binomial of n + 1 trials with t has m successes at most.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def banding(threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bands, values in each) of the candidate search: the widest bands that a pair at the threshold misses with a chance of MISS at most."""
    for rows in range(VALUES, 0, -1):
        bands = VALUES // rows
        if (1 - threshold**rows) ** bands <= MISS:
            return bands, rows
    raise ValueError(f"{VALUES} MinHash values find no pairs at a similarity of {threshold}")


def candidates(sketches: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray, need: list[int], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs that share a band, those that share no earlier one and that the posterior keeps."""
    matches = np.zeros(len(i), np.int16)
    for k, least in enumerate(need):
        same = sketches[i, k * STEP : (k + 1) * STEP] == sketches[j, k * STEP : (k + 1) * STEP]
        matches += same.sum(1, dtype=np.int16)
        ok = matches >= least
        i, j, matches = i[ok], j[ok], matches[ok]
    used, ok = bands * rows, np.zeros(len(i), bool)
    for s in range(0, len(i), SLICE):
        a, b = i[s : s + SLICE], j[s : s + SLICE]
        first = (sketches[a, :used].reshape(-1, bands, rows) == sketches[b, :used].reshape(-1, bands, rows)).all(2).argmax(1)
        ok[s : s + SLICE] = first == band[a]
    return i[ok], j[ok]


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j, for pairs sorted by i: each i is marked once, its partners are counted together."""
    used, inverse = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = inverse[: len(i)], inverse[len(i) :]
    size = np.array([len(sets[u]) for u in used])
    start = np.concatenate(([0], np.cumsum(size)))
    vocabulary, ids = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    mark = np.zeros(len(vocabulary), np.int32)
    out = np.zeros(len(i), np.int64)
    edges = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        own = ids[start[a[s]] : start[a[s] + 1]]
        mark[own] = 1
        for c in range(s, e, 2048):
            part = b[c : min(e, c + 2048)]
            n = size[part]
            stop = np.cumsum(n)
            at = np.arange(stop[-1]) - np.repeat(stop - n, n) + np.repeat(start[part], n)
            out[c : c + len(part)] = np.add.reduceat(mark[ids[at]], stop - n)
        mark[own] = 0
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                hashes = shingles(text.as_py() or b"")
                rows.append((key, *(digest(hashes) if len(hashes) else (None, None)), sketch(hashes).tobytes() if len(hashes) else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "d1", "d2", "sketch"])

    return spread(docs).mapInArrow(run, _SKETCH)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, n_links (other rows whose shingle sets have a Jaccard of threshold or more), class_id, kept.

    class_id is the smallest doc_id that links lead to, kept is true for it. Texts of one shingle set, such as copies, are
    one set with a weight, so that copies are never expanded into pairs. Sets that share a band of MinHash values are
    compared: bands of any size are worked off block by block, pairs exist only inside a task, and
    every pair that the posterior keeps is verified on the whole sets. The bands follow from the threshold; one too low for
    any is refused. A text without words, null or empty, and a row
    whose key is null link with nothing. Repeated rows are rows each; where rows of one doc_id differ, its links are those
    of all its texts. Other columns are ignored.
    """
    return _classes(docs, key, text, threshold).drop("d1", "d2")


def _classes(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """near_duplicates() with the digest (d1, d2) of each row's shingle set, null where it links with nothing."""
    row = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    sketches = stored(_sketches(row))
    known = sketches.filter("d1 is not null and key is not null")
    sets = stored(known.groupBy("d1", "d2").agg(F.min("key").alias("item"), F.count("*").alias("weight"), F.first("sketch").alias("sketch")))
    need, (bands, rows_each) = least_matches(threshold), banding(threshold)

    buckets = F.array(*[F.xxhash64(F.lit(b), F.substring(F.col("sketch"), 2 * rows_each * b + 1, 2 * rows_each)) for b in range(bands)])
    members = sets.select("item", "d1", F.posexplode(buckets).alias("band", "bucket")).select("bucket", "band", "item", "d1")
    held = units(members, "d1").join(sets.select("item", "d1", "weight", "sketch"), ["item", "d1"])

    def alive(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = _matrix(rows)
        band, keep = column(rows, "band"), np.zeros(rows.num_rows, bool)
        for i, j in pairs(starts, column(rows, "side")):
            i, j = candidates(x, band, i, j, need, bands, rows_each)
            keep[i] = keep[j] = True
        if keep.any():
            yield from rows.filter(pa.array(keep)).select([n.split(" ")[0] for n in unit_schema.split(", ")]).combine_chunks().to_batches()

    unit_schema = "bucket long, part_a int, part_b int, side int, band int, item long, d1 long, weight long, sketch binary"
    survivors = stored(by_unit(held, alive, unit_schema))

    def exact_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py() or b"") for x in batch.column(2).cast(pa.binary())]
            match = np.array([len(h) > 0 and digest(h)[0] == d for h, d in zip(found, batch.column(1).to_pylist(), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(match)), batch.column(1).filter(pa.array(match)), pa.array([h.tobytes() for h, ok in zip(found, match, strict=True) if ok], pa.binary())], names=["item", "d1", "hashes"])

    wanted = survivors.select("item", "d1").distinct()
    # the wanted sets grow with the corpus, so this join is never a broadcast
    whole = wanted.hint("merge").join(row.select(F.col("key").alias("item"), "text"), "item").select("item", "d1", "text")
    hashes = whole.mapInArrow(exact_sets, "item long, d1 long, hashes binary").dropDuplicates(["item", "d1"])

    def verify(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = _matrix(rows)
        band, item, weight = column(rows, "band"), column(rows, "item"), column(rows, "weight")
        own = [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()]
        size = np.array([len(h) for h in own])
        for i, j in pairs(starts, column(rows, "side")):
            i, j = candidates(x, band, i, j, need, bands, rows_each)
            if len(i):
                common = overlaps(own, i, j)
                ok = (common >= threshold * (size[i] + size[j] - common) - 1e-9) & (item[i] != item[j])
                if ok.any():
                    yield links_batch(item, weight, i[ok], j[ok])

    found = stored(by_unit(survivors.join(hashes, ["item", "d1"]), verify, LINKS))
    links = found.groupBy("item").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("item").alias("a"), F.col("root").alias("b")))
    per_set = sets.select("d1", "d2", "item", "weight").join(links, "item", "left").join(roots, "item", "left").select("d1", "d2", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "item").alias("class_id"))
    out = sketches.select("key", F.when(F.col("key").isNotNull(), F.col("d1")).alias("d1"), "d2").join(per_set, ["d1", "d2"], "left")
    return out.select(
        F.col("key").alias("doc_id"),
        "d1",
        "d2",
        F.coalesce(F.col("weight") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_id", "key").alias("class_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _matrix(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(rows.num_rows, VALUES)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs but for near duplicates: of each class the row with the smallest key stays.

    It is decided per row. Of rows with one key and one shingle set, such as repeated rows, one stays; which one of those
    is open. A row goes only if its own text isn't kept, whatever becomes of other texts under its key. As in
    near_duplicates, texts of one key that no smaller key holds have their links in common. Rows without words and rows
    whose key is null all stay.
    """
    found = stored(_classes(docs, key, text, threshold).select("doc_id", "d1", "d2", "kept"))
    gone_key, own, own_text, d1, d2, row = fresh(docs, "gone_key", "own_key", "own_text", "set_d1", "set_d2", "own_row")
    gone = found.filter("not kept").select(F.col("doc_id").alias(gone_key)).distinct()
    shared = stored(found.filter("doc_id is not null").groupBy(F.col("doc_id").alias(gone_key)).count().filter("count > 1").select(gone_key))
    once = lambda keys: docs.join(keys, docs[f"`{key}`"] == keys[gone_key], "left_anti")
    if shared.isEmpty():
        return once(gone)
    # only rows whose key comes again need their digests once more
    rows = docs.join(shared, docs[f"`{key}`"] == shared[gone_key], "left_semi").withColumn(own_text, F.col(f"`{text}`").cast("string"))

    names = [*docs.columns, d1, d2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x) for x in texts(batch.column(batch.num_columns - 1))]
            pairs = [digest(h) if len(h) else (None, None) for h in sets]
            made = [pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    told = rows.mapInArrow(run, StructType([*docs.schema.fields, StructField(d1, LongType()), StructField(d2, LongType())]))
    told = told.withColumn(own, F.col(f"`{key}`").cast("long")).withColumn(row, F.when(F.col(d1).isNull(), F.monotonically_increasing_id()))
    lost = found.filter("not kept").select(F.col("doc_id").alias(own), F.col("d1").alias(d1), F.col("d2").alias(d2)).distinct()
    stays = told.dropDuplicates([own, d1, d2, row]).join(lost, [own, d1, d2], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return once(gone.union(shared).distinct()).unionByName(stays)
