"""Regions of large frames: tiles are labelled apart, their labels meet along the borders, and are joined by rounds of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..env import stored
from ..functions import scalars as fn
from ..sources.relations import cut
from . import graph
from .tracking import with_previous

Alike = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Neighbours to look at from each place: those to the right and below, and for eight neighbours the lower diagonals.
FOUR, EIGHT = ((0, 1), (1, 0)), ((0, 1), (1, 0), (1, 1), (1, -1))
#: Places that a task labels at once.
PLACES = 1 << 16
LABELS = "video int, frame int, label long, area long, top int, left int, bottom int, right int, ring array<struct<place: long, what: array<int>>>"


def _ends(dy: int, dx: int) -> tuple[tuple, tuple]:
    """Of a stack of tiles the places that have a neighbour dy below and dx beside, and these neighbours."""
    y, left, right = slice(None, -dy or None), slice(max(0, -dx), -dx if dx > 0 else None), slice(max(0, dx), dx if dx < 0 else None)
    return (slice(None), y, left), (slice(None), slice(dy, None), right)


def label_stack(mask: np.ndarray, what: np.ndarray, steps: tuple, alike: Alike) -> np.ndarray:
    """Of a stack of square tiles, for each place of the mask the least place that links lead to, the tile's size squared elsewhere.

    Every place takes the least label around it, then the label of its label, until nothing changes: a whole batch at once.
    """
    n, side = mask.shape[0], mask.shape[1]
    none = side * side
    links = []
    for dy, dx in steps:
        a, b = _ends(dy, dx)
        links.append((a, b, mask[a] & mask[b] & alike(what[a], what[b])))
    lab = np.where(mask, np.arange(none).reshape(side, side), none)
    while True:
        new = lab.copy()
        for a, b, on in links:
            least = np.where(on, np.minimum(new[a], new[b]), none)
            new[a] = np.minimum(new[a], least)
            new[b] = np.minimum(new[b], least)
        flat = np.concatenate((new.reshape(n, none), np.full((n, 1), none)), 1)
        new = np.take_along_axis(flat, new.reshape(n, none), 1).reshape(new.shape)
        new = np.where(mask, new, none)
        if (new == lab).all():
            return lab
        lab = new


def stacks(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many tiles that they have at most PLACES places, of one tile at least."""
    size = max(1, PLACES // (tile * tile))
    return (batch.slice(i, size) for batch in batches for i in range(0, batch.num_rows, size))


def label_tiles(tiles: DataFrame, tile: int, wide: int, steps: tuple, alike: Alike) -> DataFrame:
    """LABELS of tiles (video, frame, ty, tx, mask, what): one row for each region of each tile, with its places on the tile's ring.

    mask has a 0 or 1 for each place of a tile, what the same number of values for each. A label, like a place, counts through the whole
    frame, which is wide places wide. A task labels so many tiles of an Arrow batch at a time that they have about PLACES places.
    """
    ring = np.zeros((tile, tile), bool)
    ring[0] = ring[-1] = ring[:, 0] = ring[:, -1] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stacks(batches, tile):
            video, frame, ty, tx = (batch.column(i).to_numpy() for i in range(4))
            mask = batch.column(4).flatten().to_numpy().reshape(-1, tile, tile) > 0
            what = batch.column(5).flatten().to_numpy().reshape(len(video), tile, tile, -1)
            lab = label_stack(mask, what, steps, alike)
            b, y, x = np.nonzero(mask)
            if not len(b):
                continue
            key = b * tile * tile + lab[b, y, x]
            found, at, area = np.unique(key, return_inverse=True, return_counts=True)
            home, place = np.divmod(found, tile * tile)
            whole = lambda h, yy, xx: (ty[h].astype(np.int64) * tile + yy) * wide + tx[h] * tile + xx
            order, starts = np.argsort(at, kind="stable"), np.concatenate(([0], np.cumsum(area)[:-1]))
            line, row = ty[b].astype(np.int32) * tile + y, tx[b].astype(np.int32) * tile + x
            box = [f.reduceat(v[order], starts).astype(np.int32) for f, v in ((np.minimum, line), (np.minimum, row), (np.maximum, line), (np.maximum, row))]
            edge = np.flatnonzero(ring[y, x])
            edge = edge[np.argsort(at[edge], kind="stable")]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(at[edge], minlength=len(found)))))
            flat = what[b[edge], y[edge], x[edge]]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(edge) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel().astype(np.int32)))
            inner = pa.StructArray.from_arrays([pa.array(whole(b[edge], y[edge], x[edge])), values], ["place", "what"])
            columns = [pa.array(video[home].astype(np.int32)), pa.array(frame[home].astype(np.int32)), pa.array(whole(home, place // tile, place % tile)), pa.array(area.astype(np.int64)), *map(pa.array, box), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), inner)]
            yield pa.RecordBatch.from_arrays(columns, names=["video", "frame", "label", "area", "top", "left", "bottom", "right", "ring"])

    return tiles.select("video", "frame", "ty", "tx", "mask", "what").mapInArrow(run, LABELS)


def joined_regions(labels: DataFrame, tile: int, wide: int, steps: tuple, same: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(video, frame, region, area, top, left, bottom, right): the regions of whole frames from the LABELS of their tiles; region is the least place.

    Places on rings meet their neighbours in other tiles by an equi-join on the place; where same() holds of what both carry,
    their labels are one region. The labels are read twice.
    """
    keys = ["video", "frame"]
    rim = labels.select(*keys, "label", F.explode("ring").alias("p")).select(*keys, "label", "p.place", "p.what")
    y, x = F.expr(f"place div {wide}"), F.col("place") % wide
    home = lambda yy, xx: F.struct(F.floor(yy / tile), F.floor(xx / tile))
    other = F.array(*[F.struct((y + dy).alias("y"), (x + dx).alias("x")) for dy, dx in steps])
    out = rim.withColumn("home", home(y, x)).withColumn("to", F.explode(other)).filter(F.col("to.x").between(0, wide - 1)).filter(home(F.col("to.y"), F.col("to.x")) != F.col("home"))
    here = out.select(*keys, (F.col("to.y") * wide + F.col("to.x")).alias("place"), F.col("label").alias("a"), F.col("what").alias("left"))
    met = here.join(rim.select(*keys, "place", F.col("label").alias("b"), F.col("what").alias("right")), [*keys, "place"])
    if same is not None:
        met = met.filter(same(F.col("left"), F.col("right")))
    root = graph.roots(met.select(*keys, "a", "b"), keys).withColumnRenamed("item", "label")
    whole = labels.drop("ring").join(root, [*keys, "label"], "left")
    return whole.groupBy(*keys, F.coalesce("root", "label").alias("region")).agg(F.sum("area").alias("area"), F.min("top").alias("top"), F.min("left").alias("left"), F.max("bottom").alias("bottom"), F.max("right").alias("right"))


def mask_regions(frames: DataFrame, side: int, tile: int, level: int) -> DataFrame:
    """(video, frame, region, area, top, left, bottom, right): the 8-connected regions of the pixels above a level, of frames (video, frame, px) cut into tiles.

    Frames are cut before they are exploded; nothing after that holds a whole frame. Frames without such pixels have no rows. Frames of
    one tile have no borders, so that their labels are the regions and there is no shuffle.
    """
    n = side // tile
    grid = F.array(*[F.struct(F.lit(a).alias("ty"), F.lit(b).alias("tx")) for a in range(n) for b in range(n)])
    one = lambda g: F.struct(g["ty"].alias("ty"), g["tx"].alias("tx"), F.transform(cut(F.col("px"), side, g["ty"] * tile, g["tx"] * tile, tile, tile), lambda v: (v > level).cast("int")).alias("mask"))
    tiles = frames.select("video", "frame", F.explode(F.transform(grid, one)).alias("t")).select("video", "frame", "t.ty", "t.tx", "t.mask", F.col("t.mask").alias("what"))
    labels = label_tiles(tiles.filter(F.array_max("mask") > 0), tile, side, EIGHT, lambda a, b: np.ones(a.shape[:-1], bool))
    if n == 1:
        return labels.select("video", "frame", F.col("label").alias("region"), "area", "top", "left", "bottom", "right")
    return joined_regions(stored(labels), tile, side, EIGHT)


def block_moves(frames: DataFrame, side: int, block: int, reach: int) -> DataFrame:
    """(video, frame, by, bx, mode, dy, dx) of each block of a frame that has one before: of its own place and those reach to the four sides, the nearest.

    mode is 0 where the block's own place differs by less than 1 a pixel, 4 where the nearest does by less than 4, else 1; only mode 4 has a
    vector. Of equals the earlier of own, up, down, left, right wins. Blocks are cut before they are exploded.
    """
    n, area = side // block, block * block
    grid = F.array(*[F.struct(F.lit(a * block).alias("y"), F.lit(b * block).alias("x")) for a in range(n) for b in range(n)])
    moves = ((0, 0), (-reach, 0), (reach, 0), (0, -reach), (0, reach))

    def one(g: Column) -> Column:
        now = cut(F.col("px"), side, g["y"], g["x"], block, block)

        def tried(k: int, dy: int, dx: int) -> Column:
            y, x = g["y"] - dy, g["x"] - dx
            inside = y.between(0, side - block) & x.between(0, side - block)
            return F.when(inside, F.struct(fn.sad(now, cut(F.col("prev"), side, y, x, block, block)).alias("sad"), F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")))

        found = F.array(*[tried(k, dy, dx) for k, (dy, dx) in enumerate(moves)])
        return F.struct((g["y"] / block).cast("int").alias("by"), (g["x"] / block).cast("int").alias("bx"), F.get(found, F.lit(0))["sad"].alias("own"), F.array_min(F.array_compact(found)).alias("best"))

    df = with_previous(frames).filter("prev is not null").select("video", "frame", F.explode(F.transform(grid, one)).alias("b"))
    mode = F.when(F.col("b.own") < area, 0).when(F.col("b.best.sad") < 4 * area, 4).otherwise(1)
    df = df.select("video", "frame", "b.by", "b.bx", mode.alias("mode"), F.col("b.best").alias("best"))
    return df.select("video", "frame", "by", "bx", "mode", F.when(F.col("mode") == 4, F.col("best.dy")).otherwise(0).alias("dy"), F.when(F.col("mode") == 4, F.col("best.dx")).otherwise(0).alias("dx"))


def _one_kind(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Modes equal over the whole history, and vectors nowhere more than 1 apart in all."""
    d = np.abs(a - b).reshape(*a.shape[:-1], -1, 3)
    return (d[..., 0] == 0).all(-1) & (d[..., 1] + d[..., 2] <= 1).all(-1)


def _one_kind_column(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    at = lambda i, k: F.get(d, 3 * i + k)
    return F.forall(F.sequence(F.lit(0), (F.size(a) / 3).cast("int") - 1), lambda i: (at(i, 0) == 0) & (at(i, 1) + at(i, 2) <= 1))


def history_regions(moves: DataFrame, rows: int, tile: int, history: int = 10, active: int = 3, least: int = 4) -> DataFrame:
    """(video, frame, n_regions, largest): regions of blocks that behaved alike over the last history frames, for frames that have so many.

    Blocks (video, frame, by, bx, mode, dy, dx) that weren't mode 0 in more than active of these frames take part; two side by
    side or one above the other are joined if their modes are equal throughout and their vectors at most 1 apart in each frame. Regions of less than least blocks don't
    count. Frames are square, of rows x rows blocks, cut into tiles.
    """
    w = Window.partitionBy("video", "by", "bx").orderBy("frame").rowsBetween(1 - history, 0)
    past = moves.withColumn("past", F.collect_list(F.array("mode", "dy", "dx")).over(w)).filter(F.size("past") == history)
    past = past.select("video", "frame", "by", "bx", F.flatten("past").alias("what"), F.size(F.filter("past", lambda p: F.get(p, F.lit(0)) != 0)).alias("n"))
    home = [F.floor(F.col(c) / tile).cast("int") for c in ("by", "bx")]
    cell = F.struct((F.col("by") % tile * tile + F.col("bx") % tile).alias("i"), (F.col("n") > active).cast("int").alias("on"), "what")
    tiles = past.groupBy("video", "frame", home[0].alias("ty"), home[1].alias("tx")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    tiles = tiles.select("video", "frame", "ty", "tx", F.col("c.on").alias("mask"), F.flatten("c.what").alias("what"))
    found = joined_regions(stored(label_tiles(tiles, tile, rows, FOUR, _one_kind)), tile, rows, FOUR, _one_kind_column)
    sums = found.filter(F.col("area") >= least).groupBy("video", "frame").agg(F.count("*").alias("n_regions"), F.max("area").alias("largest"))
    all_ = past.select("video", "frame").distinct()
    return all_.join(sums, ["video", "frame"], "left").select("video", "frame", F.coalesce("n_regions", F.lit(0)).alias("n_regions"), F.coalesce("largest", F.lit(0)).alias("largest"))
