"""Motion search within rows: each frame carries the one before, and a block's offsets are scored by array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..sources.relations import cut
from .decision import let
from .tracking import with_previous


def _scored(frames: DataFrame, block: int, reach: int, side: int, at_least: int, score: Callable[[Column, Column], dict[str, Column]], least: Callable[[Column], Column]) -> DataFrame:
    """(video, frame, by, bx, found): of each block that changed by at_least, the least of least() over what score() makes of its offsets.

    A block is compared with what the frame before shows dy, dx before it, for offsets up to reach that stay in the frame. All
    blocks are scored before the frame is exploded, so that no block carries it. The only shuffle is the one that puts frames beside the
    ones before them.
    """
    n, wide = side // block, 2 * reach + 1
    grid = F.array(*[F.struct(F.lit(y).alias("by"), F.lit(x).alias("bx")) for y in range(n) for x in range(n)])
    offsets = F.array(*[F.struct(F.lit(o // wide - reach).alias("dy"), F.lit(o % wide - reach).alias("dx")) for o in range(wide * wide)])

    def one(g: Column) -> Column:
        top, left = g["by"] * block, g["bx"] * block
        patch = lambda px, dy, dx: cut(F.col(px), side, top - dy, left - dx, block, block)
        inside = F.filter(offsets, lambda o: (top - o["dy"]).between(0, side - block) & (left - o["dx"]).between(0, side - block))

        def found(now: Column) -> Column:
            def tried(o: Column) -> Column:
                return let(patch("prev", o["dy"], o["dx"]), lambda t: F.struct(*[c.alias(name) for name, c in {**score(now, t), "dy": o["dy"], "dx": o["dx"]}.items()]))

            best = F.array_min(F.transform(F.transform(inside, tried), least))
            moved = fn.sad(now, patch("prev", F.lit(0), F.lit(0))) >= at_least
            return F.struct(g["by"].alias("by"), g["bx"].alias("bx"), moved.alias("moved"), F.when(moved, best).alias("found"))

        return let(patch("px", F.lit(0), F.lit(0)), found)

    df = with_previous(frames).select("video", "frame", F.explode(F.transform(grid, one)).alias("b")).filter("b.moved")
    return df.select("video", "frame", "b.by", "b.bx", "b.found")


def search(frames: DataFrame, block: int, reach: int, side: int, at_least: int = 1) -> DataFrame:
    """(video, frame, by, bx, dy, dx, ssd, sum_now, sum_then): for each block that changed, the offset of the least squared error.

    Of equal errors the least dy, then dx, wins. Blocks that differ from their place by less than at_least in all are left out.
    """
    score = lambda now, then: {"ssd": fn.ssd(now, then), "sum_now": fn.array_sum(now), "sum_then": fn.array_sum(then)}
    order = lambda s: F.struct(*[s[c].alias(c) for c in ("ssd", "dy", "dx", "sum_now", "sum_then")])
    found = _scored(frames, block, reach, side, at_least, score, order)
    return found.select("video", "frame", "by", "bx", "found.dy", "found.dx", "found.ssd", "found.sum_now", "found.sum_then")


def correlated(frames: DataFrame, block: int, reach: int, side: int) -> DataFrame:
    """(video, frame, by, bx, dy, dx, correlation, ssd): for each block that changed, the offset of the largest normalised correlation.

    Patches of one level have none and are passed over; of equal correlations the least dy, then dx, wins.
    """
    n = block * block

    def score(now: Column, then: Column) -> dict[str, Column]:
        a, b = fn.array_sum(now), fn.array_sum(then)
        cross = fn.array_sum(F.zip_with(now, then, lambda x, y: x * y))
        spread = (n * fn.array_sum(F.transform(now, lambda x: x * x)) - a * a).cast("double") * (n * fn.array_sum(F.transform(then, lambda x: x * x)) - b * b)
        return {"r": F.when(spread > 0, F.round((n * cross - a * b) / F.sqrt(spread), 6)), "ssd": fn.ssd(now, then)}

    order = lambda s: F.when(s["r"].isNotNull(), F.struct((-s["r"]).alias("less"), s["dy"].alias("dy"), s["dx"].alias("dx"), s["ssd"].alias("ssd")))
    found = _scored(frames, block, reach, side, 1, score, order).filter("found is not null")
    return found.select("video", "frame", "by", "bx", "found.dy", "found.dx", (F.lit(0.0) - F.col("found.less")).alias("correlation"), "found.ssd")


def shifts(found: DataFrame, area: int, most: int = 24) -> DataFrame:
    """Adds shift, the truncated difference of mean levels, where it is at most most: motion with a fade."""
    shift = (F.col("sum_now") / area - F.col("sum_then") / area).cast("int")
    return found.withColumn("shift", shift).filter(F.abs("shift") <= most)
