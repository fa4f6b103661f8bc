"""Objects of frames by joins and windows: matches by cells, tracks, and the states of an object's parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..env import stored
from ..functions import scalars as fn
from . import graph

#: Side to which a part's mask is brought before it is hashed, and how finely its shape and share of mask count.
HASH_SIDE, SHAPES, SHARES = 32, 5, 10
#: A part is at least so many columns wide; parts are parted by at least so many without mask.
PART_WIDTH, PART_GAP = 2, 1
PART = "struct<part: int, x: int, y: int, w: int, h: int, key: string, mask: array<int>>"


def near_pairs(now: DataFrame, then: DataFrame, keys: list[str], within: float) -> DataFrame:
    """(keys, a, b, dist) of all points (keys, id, cx, cy) of the two tables that are nearer than within.

    Points fall into cells as wide as that; a point meets the nine cells around its own by an equi-join, so no task holds all pairs.
    Here and below joins are merges at every size: a few bytes of Parquet hold a region, so that Spark would broadcast millions through the driver.
    """
    cell = lambda c: F.floor(F.col(c) / within)
    right = then.select(*keys, F.col("id").alias("b"), F.col("cx").alias("x2"), F.col("cy").alias("y2"), cell("cx").alias("gx"), cell("cy").alias("gy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = now.select(*keys, F.col("id").alias("a"), "cx", "cy", around.alias("n")).select(*keys, "a", "cx", "cy", (cell("cx") + F.col("n.i")).alias("gx"), (cell("cy") + F.col("n.j")).alias("gy"))
    dist = F.sqrt((F.col("cx") - F.col("x2")) * (F.col("cx") - F.col("x2")) + (F.col("cy") - F.col("y2")) * (F.col("cy") - F.col("y2")))
    return left.join(right.hint("merge"), [*keys, "gx", "gy"]).withColumn("dist", dist).filter(F.col("dist") < within).select(*keys, "a", "b", "dist")


def greedy_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): one-to-one pairs, nearest first, then by a, then by b.

    A pair that is the first of all that share an end with it is one that this order would take; rounds take all of these at once and
    drop what they rule out, until no pair is left.
    """
    left, taken = stored(pairs), None
    while left.limit(1).count():
        first = lambda k: F.min(F.struct("dist", "a", "b")).over(Window.partitionBy(*keys, k))
        marked = stored(left.withColumn("own", F.struct("dist", "a", "b")).withColumn("won", (first("a") == F.col("own")) & (first("b") == F.col("own"))).drop("own"))
        won = marked.filter("won").select(*keys, "a", "b")
        taken = won if taken is None else taken.unionByName(won)
        rest = marked.filter("not won").drop("won")
        left = stored(rest.join(won.select(*keys, "a").hint("merge"), [*keys, "a"], "left_anti").join(won.select(*keys, "b").hint("merge"), [*keys, "b"], "left_anti"))
    return left.select(*keys, "a", "b") if taken is None else taken


def tracks(found: DataFrame, within: float) -> DataFrame:
    """found (video, frame, id, cx, cy, ...) with obj: regions that greedy matches of each frame with the next join, the first one's frame and id.

    obj is frame * 2**32 + id of the first region, so that objects of a video are numbered in the order in which they come.
    """
    now = found.select("video", "frame", "id", "cx", "cy")
    pairs = near_pairs(now, now.withColumn("frame", F.col("frame") + 1), ["video", "frame"], within)
    node = lambda f, i: F.shiftleft(F.col(f).cast("long"), 32) + F.col(i) if isinstance(f, str) else F.shiftleft(f.cast("long"), 32) + F.col(i)
    links = greedy_pairs(pairs, ["video", "frame"]).select("video", node("frame", "a").alias("a"), node(F.col("frame") - 1, "b").alias("b"))
    root = graph.roots(links, ["video"]).withColumnRenamed("item", "node")
    return found.withColumn("node", node("frame", "id")).join(root.hint("merge"), ["video", "node"], "left").withColumn("obj", F.coalesce("root", "node")).drop("node", "root")


def lasting(tracked: DataFrame, history: int = 5) -> DataFrame:
    """The rows of objects that have at least history of them: others never lock, and so have no events."""
    return tracked.withColumn("_n", F.count("*").over(Window.partitionBy("video", "obj"))).filter(F.col("_n") >= history).drop("_n")


def otsu(values: np.ndarray) -> int:
    """The level above which values are mask, by the largest variance between the two sides; the lowest of equals."""
    n = np.bincount(values, minlength=256)
    below, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where((below > 0) & (above > 0), below * above * (total / below - (total[-1] - total) / above) ** 2, 0)
    return int(apart.argmax())


def filled(mask: np.ndarray) -> np.ndarray:
    """mask with its holes: what isn't mask and can't be reached from the border by steps to the four sides."""
    free = np.pad(~mask, 1, constant_values=True)
    out = np.zeros_like(free)
    out[0, 0] = True
    while True:
        wide = np.pad(out, 1)
        grown = free & (out | wide[:-2, 1:-1] | wide[2:, 1:-1] | wide[1:-1, :-2] | wide[1:-1, 2:])
        if (grown == out).all():
            return ~out[1:-1, 1:-1]
        out = grown


def opened(mask: np.ndarray) -> np.ndarray:
    """What 2 x 2 squares of mask cover."""
    corner = mask[:-1, :-1] & mask[1:, :-1] & mask[:-1, 1:] & mask[1:, 1:]
    out = np.zeros_like(mask)
    for dy in (0, 1):
        for dx in (0, 1):
            out[dy : dy + corner.shape[0], dx : dx + corner.shape[1]] |= corner
    return out


def parts_of(patch: np.ndarray) -> list[tuple]:
    """(part, x, y, w, h, key, mask) of a patch of levels: parts of its mask from left to right, each cut to its rows.

    The mask is what lies above Otsu's level, holes filled, opened where it is wider and taller than six. Without a part that is
    wide enough the whole patch is one. key hashes the mask at HASH_SIDE x HASH_SIDE by nearest places, with its shape and share of mask.
    """
    mask = filled(patch > otsu(patch.ravel()))
    if min(mask.shape) > 6:
        mask = opened(mask)
    on = np.concatenate(([False], mask.any(0), [False]))
    edge = np.flatnonzero(on[1:] != on[:-1])
    runs = [(a, b) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    joined = runs[:1]
    for a, b in runs[1:]:
        if a - joined[-1][1] < PART_GAP:
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    wide = [r for r in joined if r[1] - r[0] >= PART_WIDTH] or [(0, mask.shape[1])]
    out = []
    for i, (a, b) in enumerate(wide):
        rows = np.flatnonzero(mask[:, a:b].any(1))
        if not len(rows):
            continue
        m = mask[rows[0] : rows[-1] + 1, a:b]
        h, w = m.shape
        to = lambda n: np.arange(HASH_SIDE) * n // HASH_SIDE
        digest = hashlib.md5(np.packbits(m[to(h)][:, to(w)]).tobytes()).hexdigest()
        out.append((i, int(a), int(rows[0]), w, h, f"{digest}_{int(w / h * SHAPES)}_{int(m.mean() * SHARES)}", m.astype(int).ravel().tolist()))
    return out


def patch_parts(tracked: DataFrame, frames: DataFrame, side: int) -> DataFrame:
    """tracked (video, frame, obj, top, left, bottom, right, ...) with parts, those of the frame's pixels in its box: array<PART>.

    Boxes are cut out of their frame before they leave it; a task holds an Arrow batch of patches.
    """
    keep = ["video", "frame", "obj", "top", "left", "bottom", "right", "cx", "cy"]
    w = F.col("right") - F.col("left") + 1
    lines = F.transform(F.sequence("top", "bottom"), lambda y: F.slice("px", y * side + F.col("left") + 1, w))
    rows = tracked.join(frames.hint("merge"), ["video", "frame"]).select(*keep, F.flatten(lines).alias("patch"), w.alias("w"))
    names = ["part", "x", "y", "w", "h", "key", "mask"]
    kind = pa.list_(pa.struct([*((n, pa.int32()) for n in names[:5]), ("key", pa.string()), ("mask", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, p, strict=True)) for p in parts_of(np.array(v.as_py()).reshape(-1, n.as_py()))] for v, n in zip(batch.column(len(keep)), batch.column(len(keep) + 1), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found, kind)], names=[*keep, "parts"])

    head = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{head}, parts array<{PART}>")


def exclusive_or(old: Column, new: Column) -> Column:
    """Places where two masks (w, h, mask) differ, laid over each other by their upper left corners."""
    h, w = F.greatest(old["h"], new["h"]), F.greatest(old["w"], new["w"])
    at = lambda m, i: F.when((i % w < m["w"]) & (F.floor(i / w) < m["h"]), F.get(m["mask"], (F.floor(i / w) * m["w"] + i % w).cast("int"))).otherwise(0)
    return F.size(F.filter(F.sequence(F.lit(0), h * w - 1), lambda i: at(old, i) != at(new, i)))


EVENTS = "video int, obj long, frame int, type string, part int, old_state int, new_state int, area int"


def micro_events(tracked: DataFrame, history: int = 5, overlap: float = 0.85, stray: float = 2) -> DataFrame:
    """EVENTS of objects (video, obj, frame, box, centre, parts), an object's rows in the order of frames.

    LOCK: the mean overlap of the history - 1 boxes before with this one is above overlap, or the centre strayed at most stray either way over all of
    them, and it wasn't so a row before. From an object's first LOCK on, each of its parts has states, numbered from 0 in the order in which
    their keys are first seen: INIT_MICRO_STATE for the first; MICRO_STATE_CHANGE whenever the key isn't that of the part's
    row before, with the area of the exclusive or against the old state's mask where the state is new. A state's mask is that of its first row.
    """
    w = Window.partitionBy("video", "obj").orderBy("frame")
    last = w.rowsBetween(1 - history, 0)
    box = F.struct("left", "top", (F.col("right") - F.col("left") + 1).alias("w"), (F.col("bottom") - F.col("top") + 1).alias("h"))
    df = tracked.withColumn("past", F.collect_list(box).over(last))
    now = F.get("past", F.size("past") - 1)
    one = lambda b: fn.iou(b["left"], b["top"], b["w"], b["h"], now["left"], now["top"], now["w"], now["h"])
    mean = F.aggregate(F.transform(F.slice("past", 1, history - 1), one), F.lit(0.0), lambda a, v: a + v) / (history - 1)
    moved = lambda c: F.max(c).over(last) - F.min(c).over(last)
    df = df.withColumn("dx", moved("cx")).withColumn("dy", moved("cy"))
    df = df.withColumn("locked", (F.size("past") == history) & ((mean > overlap) | (F.col("dx") <= stray) & (F.col("dy") <= stray)))
    df = df.withColumn("lock", F.col("locked") & ~F.lag("locked", 1, False).over(w)).withColumn("begun", F.max("locked").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = stored(df.select("video", "obj", "frame", "lock", "begun", "parts").filter("begun"))
    none = F.lit(None).cast("int")
    locks = df.filter("lock").select("video", "obj", "frame", F.lit("LOCK").alias("type"), none.alias("part"), none.alias("old_state"), none.alias("new_state"), none.alias("area"))

    seen = df.select("video", "obj", "frame", F.explode("parts").alias("p")).select("video", "obj", "frame", "p.part", "p.key", F.struct("p.w", "p.h", "p.mask").alias("shape"))
    keys = ["video", "obj", "part"]
    first = seen.groupBy(*keys, "key").agg(F.min("frame").alias("first"), F.min_by("shape", "frame").alias("mask"))
    states = stored(first.withColumn("state", (F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).cast("int")))
    at = Window.partitionBy(*keys).orderBy("frame")
    told = seen.select(*keys, "frame", "key").join(states.select(*keys, "key", "state", "first").hint("merge"), [*keys, "key"]).withColumn("old", F.lag("state").over(at))
    told = told.filter("old is null or old <> state")
    masks = states.select(*keys, "state", "mask")
    new = told.join(masks.withColumnRenamed("mask", "new_mask").hint("merge"), [*keys, "state"]).join(masks.select(*keys, F.col("state").alias("old"), F.col("mask").alias("old_mask")).hint("merge"), [*keys, "old"], "left")
    area = F.when(F.col("old").isNotNull() & (F.col("first") == F.col("frame")), exclusive_or(F.col("old_mask"), F.col("new_mask")))
    kind = F.when(F.col("old").isNull(), "INIT_MICRO_STATE").otherwise("MICRO_STATE_CHANGE")
    return locks.unionByName(new.select("video", "obj", "frame", kind.alias("type"), "part", F.col("old").alias("old_state"), F.col("state").alias("new_state"), area.alias("area")))
