"""Near duplicates among embeddings by collision counting over sorted one-dimensional projections.

A vector asks with a window around its place in each sorted projection; another collides with it once for each window that
holds it, and pairs with enough collisions are verified. Places are scaled so that differences have the spread of the
distance itself, whatever the length of the vectors: DISTANCE for pairs at the threshold, sqrt(2) for unrelated ones. So a
window that hardly misses a pair holds half of all unrelated vectors, and no window tells pairs from others by more than
sqrt(2) / DISTANCE, some 4.5 for a cosine of 0.95: collisions of whole sorted projections grow with the square of the
rows. Therefore windows are asked within cells of several further projections at once, from as many tables of cells as it takes
to bring every pair at the threshold together; the sorting, the windows and the counting happen in each cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LINKS, PAIRS, by_unit, column, links_batch, units
from .common import stored
from .components import components

THRESHOLD = 0.95
#: Projections whose window collisions are counted, and the chance that a pair at the threshold is lost there or while routing.
COUNTED, LOSS = 32, 0.005
#: Unlike vectors that a vector meets in one table of the routing, on average.
COMPANY = 256
#: Widths of cells, in spreads of a pair at the threshold, among which plan() chooses.
WIDTHS = (4, 5, 6, 8, 10, 12)
#: Steps per unit in which places are kept for counting; a window is one step wider for it.
STEPS = 31


def _mean_share(width: float, spread: float) -> float:
    """The chance that two places whose difference is normal fall in one cell of a grid with a random shift."""
    t = width / spread
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, threshold: float) -> tuple[int, int, float]:
    """(tables, projections per table, cell width) for n vectors: pairs at the threshold meet in a table but for a chance of LOSS.

    Differences along a random direction are near normal. Of WIDTHS the one that takes the fewest tables; they grow about as n**0.2.
    """
    near, out = math.sqrt(max(2 - 2 * threshold, 1e-6)), []
    for w in WIDTHS:
        p, q = _mean_share(w * near, near), _mean_share(w * near, math.sqrt(2))
        k = max(1, math.ceil(math.log(max(n / COMPANY, 2)) / -math.log(q)))
        out.append((max(1, math.ceil(math.log(LOSS) / math.log1p(-(p**k)))), k, w * near))
    return min(out)


def least_collisions(counted: int = COUNTED, loss: float = LOSS) -> tuple[int, float]:
    """(collisions, window in spreads): of the counted windows, a pair at the threshold has fewer with a chance below loss."""
    window = 3.0
    p = math.erf(window / math.sqrt(2))
    tail, need = 0.0, 0
    for k in range(counted + 1):
        tail += math.comb(counted, k) * p**k * (1 - p) ** (counted - k)
        if tail > loss / 10:
            need = k
            break
    return need, window


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    g = np.random.default_rng([seed, dim]).standard_normal((dim, n))
    return g * (math.sqrt(dim) / np.linalg.norm(g, axis=0))


def _by_length(v: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors in double precision) for each length among the rows."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    ends = v.offsets.to_numpy()
    length, values = np.diff(ends), v.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(length):
        at = np.flatnonzero(length == dim)
        x = values[ends[at][:, None] + np.arange(dim)]
        x = x / np.abs(x).max(1, keepdims=True)
        yield at, x / np.linalg.norm(x, axis=1, keepdims=True)


def windows(starts: np.ndarray, place: np.ndarray, w: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j), each pair once, of rows of one unit whose places differ by w at most, PAIRS at a time or what one row has.

    Rows are sorted by unit and place, so that the window above a row is a run, found by binary search.
    """
    n = len(place)
    if not n:
        return
    far = 2 * float(np.abs(place).max()) + 2 * w + 1
    key = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * far + place
    order = np.argsort(key, kind="stable")
    key = key[order]
    many = np.searchsorted(key, key + w, "right") - np.arange(n) - 1
    total = np.concatenate(([0], np.cumsum(many)))
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(total, total[row] + PAIRS, "right")) - 1)
        k = many[row:stop]
        if k.sum():
            i = np.repeat(np.arange(row, stop), k)
            j = np.arange(k.sum()) - np.repeat(total[row:stop] - total[row], k) + i + 1
            yield order[i], order[j]
        row = stop


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of vectors: key, n_links (other rows at a cosine of threshold or more), component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do those of
    another length; such rows are kept as components of their own. Equal vectors are one class with a weight, so copies
    cost one row. Cells of any size are worked off block by block; collisions are counted on ids and rounded places alone,
    and only rows of pairs that have enough of them fetch their vectors, which are verified in double precision. A pair is counted in the
    first table that it shares. Rows with equal keys count as rows each; null keys link with nothing.
    """
    row = vectors.select(F.col(f"`{key}`").cast("long").alias("vec"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("vec").isNotNull() & F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    classes = stored(row.filter(good).groupBy("v").agg(F.min("vec").alias("item"), F.count("*").alias("weight")))
    found = stored(_links(classes, classes.count(), threshold))
    links = found.groupBy("item").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("item").alias("a"), F.col("root").alias("b")))
    per_class = classes.join(links, "item", "left").join(roots, "item", "left").select("v", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "item").alias("root"))
    out = row.withColumn("key_v", F.when(good, F.col("v"))).join(per_class.withColumnRenamed("v", "key_v"), "key_v", "left")
    return out.select(
        F.col("vec").alias("vec_id"),
        F.coalesce(F.col("weight") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """LINKS between class vectors of equal length."""
    tables, k, width = plan(n, threshold)
    need, spreads = least_collisions()
    w = spreads * math.sqrt(max(2 - 2 * threshold, 1e-6)) * STEPS + 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.random.default_rng(3).integers(0, 1 << 63, tables * k, np.int64).astype(np.uint64) | np.uint64(1)
        shift = np.random.default_rng(2).random(tables * k) * width
        for batch in batches:
            held, seen = np.zeros((batch.num_rows, tables), np.uint32), np.zeros((batch.num_rows, COUNTED), np.int8)
            for at, x in _by_length(batch.column(1)):
                dim = x.shape[1]
                cell = np.floor((x @ directions(dim, tables * k, 1) + shift) / width).astype(np.int64).astype(np.uint64)
                keys = (cell * odd).reshape(len(at), tables, k).sum(2, dtype=np.uint64) + np.uint64(dim)
                keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                held[at] = keys >> np.uint64(32)
                seen[at] = np.clip(np.rint(x @ directions(dim, COUNTED, 4) * STEPS), -127, 127)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in held], pa.binary()), pa.array([r.tobytes() for r in seen], pa.binary())], names=["item", "cells", "seen"])

    hashed = stored(classes.select("item", "v").mapInArrow(cells, "item long, cells binary, seen binary"))
    # a bucket is (table, cell): the cells' bytes are split by column expressions
    at = lambda t: F.xxhash64(F.lit(t), F.substring(F.col("cells"), 4 * t + 1, 4))
    members = hashed.select("item", F.posexplode(F.array(*[at(t) for t in range(tables)])).alias("table", "bucket")).select("bucket", "table", "item")
    held = units(members, "item").join(hashed, "item")
    unit_schema = "bucket long, part_a int, part_b int, side int, table int, item long"
    names = [x.split(" ")[0] for x in unit_schema.split(", ")]

    def candidates(rows: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs with enough collisions that share no earlier table."""
        seen = np.frombuffer(b"".join(rows.column("seen").to_pylist()), np.int8).reshape(rows.num_rows, COUNTED).astype(np.int16)
        keys = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.uint32).reshape(rows.num_rows, tables)
        table, side = column(rows, "table"), column(rows, "side")
        across = np.repeat(np.add.reduceat(side, starts[:-1]) > 0, np.diff(starts)) if len(side) else side
        for i, j in windows(starts, seen[:, 0].astype(np.float64), w):
            ok = ~across[i] | (side[i] != side[j])
            i, j = i[ok], j[ok]
            count = np.ones(len(i), np.int16)
            for c in range(1, COUNTED):
                count += np.abs(seen[i, c] - seen[j, c]) <= w
                if c in (3, 7, 15):  # too many misses already
                    ok = count >= need - COUNTED + c + 1
                    i, j, count = i[ok], j[ok], count[ok]
            ok = count >= need
            i, j = i[ok], j[ok]
            if len(i):
                ok = (keys[i] == keys[j]).argmax(1) == table[i]
                yield i[ok], j[ok]

    def alive(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(rows.num_rows, bool)
        for i, j in candidates(rows, starts):
            keep[i] = keep[j] = True
        if keep.any():
            yield from rows.filter(pa.array(keep)).select(names).combine_chunks().to_batches()

    survivors = stored(by_unit(held, alive, unit_schema))

    def verify(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        item, weight = column(rows, "item"), column(rows, "weight")
        unit, place = {}, np.zeros(rows.num_rows, np.int64)
        for own, x in _by_length(rows.column("v")):
            unit[x.shape[1]] = x
            place[own] = np.arange(len(own))
        length = np.array([0])
        if len(unit) > 1:
            length = np.diff(rows.column("v").combine_chunks().offsets.to_numpy())
        for i, j in candidates(rows, starts):
            good = np.zeros(len(i), bool)
            for dim, x in unit.items():
                own = np.flatnonzero((length[i] == dim) & (length[j] == dim)) if len(unit) > 1 else np.arange(len(i))
                for s in range(0, len(own), 65536):
                    part = own[s : s + 65536]
                    good[part] = np.einsum("ij,ij->i", x[place[i[part]]], x[place[j[part]]]) >= threshold
            if good.any():
                yield links_batch(item, weight, i[good], j[good])

    whole = survivors.join(hashed, "item").join(classes.select("item", "weight", "v"), "item")
    return by_unit(whole, verify, LINKS)
