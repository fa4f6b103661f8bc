"""Points in polygons by bands, quadtrees of any depth from tables of sums, a cache of seen patches, and cuts against a background."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from ..functions import scalars as fn
from .decision import let
from .tracking import with_previous


def points_in_polygons(points: DataFrame, edges: DataFrame, keys: list[str], band: float) -> DataFrame:
    """(keys, id, poly) of the points (keys, id, x, y) in or on the polygons whose edges (keys, poly, x1, y1, x2, y2) are given, in any order.

    An edge is filed under the bands of that height which it touches, a point under its own, and the two meet by an equi-join. A point
    is inside if the ray from it to the right crosses an odd number of edges, each without its upper end, and on the border if it lies on an edge.
    """
    at = lambda c: F.floor(c / band)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    filed = edges.withColumn("band", F.explode(F.sequence(at(low), at(high))))
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    met = points.withColumn("band", at(y)).join(filed, [*keys, "band"])
    # twice the area of point and edge, signed: 0 where the point is on the edge's line
    turn = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
    on = (turn == 0) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(low, high)
    crosses = ((y1 > y) != (y2 > y)) & (F.when(y2 > y1, turn).otherwise(-turn) > 0)
    sums = met.groupBy(*keys, "id", "poly").agg(F.sum(crosses.cast("int")).alias("n"), F.max(on).alias("on"))
    return sums.filter((F.col("n") % 2 == 1) | F.col("on")).select(*keys, "id", "poly")


def sum_table(values: Column, side: int) -> Column:
    """Of a square of values, row by row, the sums of all above and to the left of each corner: (side + 1) ** 2 of them."""
    zero = F.lit(0).cast("long")
    line = lambda v, y: F.aggregate(F.slice(v, y * side + 1, side), F.struct(zero.alias("s"), F.array(zero).alias("t")), lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["t"], F.array(a["s"] + x)).alias("t")))["t"]
    first = F.array_repeat(zero, side + 1)
    down = lambda a, r: let(F.zip_with(a["last"], r, lambda p, q: p + q), lambda s: F.struct(s.alias("last"), F.concat(a["all"], F.array(s)).alias("all")))
    lines = let(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda y: line(v, y)))
    return F.flatten(F.aggregate(lines, F.struct(first.alias("last"), F.array(first).alias("all")), down)["all"])


def sobel(px: Column, side: int) -> Column:
    """The sum of the absolute slopes both ways at each pixel, by 3 x 3 weights; the edge repeats beyond itself."""

    def one(i: Column) -> Column:
        y, x = F.floor(i / side).cast("int"), i % side
        at = lambda dy, dx: F.get(px, fn.clamp(y + dy, 0, side - 1) * side + fn.clamp(x + dx, 0, side - 1))
        across = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
        along = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
        return F.abs(across) + F.abs(along)

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), one)


def deep_quadtree(frames: DataFrame, side: int, least: int) -> DataFrame:
    """(video, frame, y, x, size, tag): the leaves of each frame's quadtree; a frame without one before has none.

    A square is split in four while the variance of what its pixels changed since the frame before is above 1/2 and it is larger than least. A leaf
    is EDGE if its mean slope is above 40, else CHAOS if that variance is above 3/2, else MOTION if the mean change is above 1/2, else FLAT.
    All come from tables of sums in whole numbers, level by level, until nothing splits.
    """
    df = with_previous(frames)
    moved = F.zip_with("px", "prev", lambda a, b: F.abs(a - b))
    tables = let(moved, lambda m: F.struct(sum_table(m, side).alias("m"), sum_table(F.transform(m, lambda v: v * v), side).alias("mm"), sum_table(sobel(F.col("px"), side), side).alias("e")))
    square = lambda y, x, s: F.struct(y.cast("int").alias("y"), x.cast("int").alias("x"), s.cast("int").alias("s"))

    def leaves(t: Column) -> Column:
        def total(k: str, q: Column) -> Column:
            at = lambda y, x: F.get(t[k], y * (side + 1) + x)
            return at(q["y"] + q["s"], q["x"] + q["s"]) - at(q["y"], q["x"] + q["s"]) - at(q["y"] + q["s"], q["x"]) + at(q["y"], q["x"])

        n = lambda q: q["s"].cast("long") * q["s"]
        spread = lambda q: n(q) * total("mm", q) - total("m", q) * total("m", q)
        splits = lambda q: (q["s"] > least) & (2 * spread(q) > n(q) * n(q))
        parts = lambda q: let((q["s"] / 2).cast("int"), lambda h: F.array(square(q["y"], q["x"], h), square(q["y"], q["x"] + h, h), square(q["y"] + h, q["x"], h), square(q["y"] + h, q["x"] + h, h)))

        def tagged(q: Column) -> Column:
            tag = F.when(total("e", q) > 40 * n(q), "EDGE").when(2 * spread(q) > 3 * n(q) * n(q), "CHAOS").when(2 * total("m", q) > n(q), "MOTION").otherwise("FLAT")
            return F.struct(q["y"].alias("y"), q["x"].alias("x"), q["s"].alias("size"), tag.alias("tag"))

        start = F.struct(F.array(square(F.lit(0), F.lit(0), F.lit(side))).alias("open"), F.array().cast("array<struct<y:int,x:int,s:int>>").alias("done"))
        level = lambda a, _: F.struct(F.flatten(F.transform(F.filter(a["open"], splits), parts)).alias("open"), F.concat(a["done"], F.filter(a["open"], lambda q: ~splits(q))).alias("done"))
        levels = (side // least).bit_length()
        return F.transform(F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, level)["done"], tagged)

    return df.select("video", "frame", F.explode(let(tables, leaves)).alias("q")).select("video", "frame", "q.*")


class SeenPatches:
    """The last size patches of a video. A patch is known if one whose sides differ by at most slack, brought to its size by nearest places,
    is within a mean squared error; the oldest such wins. What is shown, the known one or else the patch, is kept as the newest."""

    def __init__(self, size: int, slack: int, most: float) -> None:
        self.kept: deque = deque()
        self.size, self.slack, self.most = size, slack, most

    def meet(self, patch: np.ndarray) -> tuple[int | None, bool]:
        """Its place from the oldest, or None, and whether the oldest had to go."""
        h, w = patch.shape
        place, shown = None, patch
        for i, old in enumerate(self.kept):
            if abs(old.shape[0] - h) <= self.slack and abs(old.shape[1] - w) <= self.slack:
                sized = old[np.arange(h) * old.shape[0] // h][:, np.arange(w) * old.shape[1] // w]
                if ((sized - patch) ** 2).sum() < self.most * h * w:
                    place, shown = i, sized
                    break
        self.kept.append(shown)
        gone = len(self.kept) > self.size
        if gone:
            self.kept.popleft()
        return place, gone


def seen_before(patches: DataFrame, size: int = 255, slack: int = 4, most: float = 10.0) -> DataFrame:
    """(video, frame, id, entry, evicted) of patches (video, frame, id, w, patch), in the order of frame and id: SeenPatches of each video.

    Rows stream through a task in that order; it holds the patches kept of one video, size of them at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video = seen = None
        for batch in batches:
            out = []
            for v, f, i, w, p in zip(*(batch.column(k) for k in range(5)), strict=True):
                if v != video:
                    video, seen = v, SeenPatches(size, slack, most)
                out.append((v.as_py(), f.as_py(), i.as_py(), *seen.meet(np.array(p.as_py()).reshape(-1, w.as_py()))))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)], names=["video", "frame", "id", "entry", "evicted"])

    rows = patches.select("video", "frame", F.col("id").cast("long").alias("id"), "w", "patch").repartition("video").sortWithinPartitions("video", "frame", "id")
    return rows.mapInArrow(run, "video int, frame int, id long, entry int, evicted boolean")


def background_cuts(frames: DataFrame, cut: float = 40.0, near: int = 30, alpha: float = 0.005) -> DataFrame:
    """(video, frame, diff, is_cut, background) of each frame (video, frame, red, green, blue: arrays) of a video, in order.

    diff is the mean difference of the frame's L, a and b to the background, rounded; above cut the background becomes the frame. Else each pixel
    whose three differences are all at most near is blended in by alpha, and the others wait. The first frame is the background.
    background is what it is after the frame, a list of L, a and b in turn. A fold over a video's frames: whether it starts anew
    depends on all it was before. A log is kept in groups of 32 frames, so that appending to it copies little.
    """
    at = lambda c, i: F.get(c, i)
    lab = F.flatten(F.transform(F.sequence(F.lit(0), F.size("red") - 1), lambda i: colour.lab8(at("red", i), at("green", i), at("blue", i))))
    held = frames.select("video", F.struct("frame", lab.alias("lab")).alias("f")).groupBy("video").agg(F.array_sort(F.collect_list("f")).alias("series"))
    line = "struct<frame:int,diff:double,is_cut:boolean,background:array<double>>"

    def step(a: Column, f: Column) -> Column:
        first = F.size(a["bg"]) == 0
        bg8 = lambda v: F.floor(v + 0.5)
        n = F.size(f["lab"])
        apart = F.zip_with(f["lab"], a["bg"], lambda v, b: F.abs(v - bg8(b)))

        def told(d: Column) -> Column:
            mean = F.when(first, 0.0).otherwise(F.aggregate(d, F.lit(0).cast("long"), lambda s, v: s + v).cast("double") / n)

            def moved(m: Column) -> Column:
                far = lambda i: F.greatest(at(d, F.floor(i / 3).cast("int") * 3), at(d, F.floor(i / 3).cast("int") * 3 + 1), at(d, F.floor(i / 3).cast("int") * 3 + 2)) > near
                blend = F.transform(a["bg"], lambda b, i: F.when(far(i), b).otherwise((1 - alpha) * b + alpha * at(f["lab"], i)))
                new = F.when(first | (m > cut), F.transform(f["lab"], lambda v: v.cast("double"))).otherwise(blend)

                def logged(b: Column) -> Column:
                    row = F.struct(f["frame"].alias("frame"), m.alias("diff"), (~first & (m > cut)).alias("is_cut"), b.alias("background"))
                    full = F.size(a["group"]) == 31
                    group = F.concat(a["group"], F.array(row))
                    return F.struct(b.alias("bg"), F.when(full, F.array().cast(f"array<{line}>")).otherwise(group).alias("group"), F.when(full, F.concat(a["out"], F.array(group))).otherwise(a["out"]).alias("out"))

                return let(new, logged)

            return let(mean, moved)

        return let(apart, told)

    start = F.struct(F.array().cast("array<double>").alias("bg"), F.array().cast(f"array<{line}>").alias("group"), F.array().cast(f"array<array<{line}>>").alias("out"))
    done = F.aggregate("series", start, step, lambda a: F.concat(F.flatten(a["out"]), a["group"]))
    return held.select("video", F.explode(done).alias("r")).select("video", "r.frame", F.round("r.diff", 6).alias("diff"), "r.is_cut", "r.background")
