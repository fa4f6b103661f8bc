"""Closed-loop coding, where each block is predicted from what the decoder has, and covers of equal modes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..sources.relations import cut

#: Price of a unit of error, step of the quantiser, mean change from which a block starts afresh.
RATE, STEP, CUT = 0.012, 27, 35
#: Frames whose log lines are kept together.
GROUP = 32


def _bound(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def closed_loop(frames: DataFrame, side: int, block: int) -> DataFrame:
    """(video, by, bx, frame, mode, bytes, sse) of the blocks of frames (video, frame, px).

    A fold over each block's series in order: its state is the decoded block and a slow background. A block that changed by more than CUT a
    pixel is a key. One within 4 of the decoded block is skipped. Else the cheapest of raw, background, solid and residual wins, the
    earlier of equals; a cost is bytes + RATE * the sum of absolute errors, and the background may stand in only where
    it is near in mean, square and largest error. A series is as long as its video.
    """
    n, area = side // block, block * block
    grid = F.array(*[F.struct(F.lit(y).alias("by"), F.lit(x).alias("bx"), cut(F.col("px"), side, F.lit(y * block), F.lit(x * block), block, block).alias("px")) for y in range(n) for x in range(n)])
    rows = frames.select("video", "frame", F.explode(grid).alias("g")).select("video", "frame", "g.*")
    series = rows.groupBy("video", "by", "bx").agg(F.array_sort(F.collect_list(F.struct("frame", "px"))).alias("series"))
    result = "array<struct<frame:int,mode:string,bytes:int,sse:long>>"

    def choice(cost: Column, rank: int, mode: str, size: Column, got: Column) -> Column:
        return F.struct(cost.cast("double").alias("cost"), F.lit(rank).alias("rank"), F.lit(mode).alias("mode"), size.cast("int").alias("bytes"), got.alias("got"))

    def options(e: Column) -> Column:
        now, then, back, coded = e["now"], e["then"], e["back"], e["coded"]
        price = lambda size, got: size + RATE * fn.sad(now, got)
        level = F.array_repeat(F.floor(fn.array_sum(now) / area).cast("int"), area)
        near = (fn.sad(now, back) < 6 * area) & (fn.ssd(now, back) < 40 * area) & (fn.largest_diff(now, back) < 14)
        nnz = F.size(F.filter(e["q"], lambda v: v != 0))
        size = F.when(2 * nnz < area, 1 + 2 * nnz).otherwise(1 + area)
        found = F.array(
            choice(price(F.lit(area + 1), then), 0, "raw", F.lit(area + 1), now),
            F.when(near, choice(price(F.lit(1), back), 1, "background", F.lit(1), back)),
            F.when(F.array_max(now) - F.array_min(now) < 10, choice(price(F.lit(2), level), 2, "solid", F.lit(2), level)),
            choice(price(size, coded), 3, "residual", size, coded),
        )
        best = F.array_min(F.array_compact(found))
        return F.when(fn.largest_diff(now, then) < 4, choice(F.lit(0), 0, "skip", F.lit(0), then)).otherwise(best)

    def step(a: Column, x: Column) -> Column:
        def coded(e: Column) -> Column:
            return _bound(F.struct(e["now"].alias("now"), e["then"].alias("then"), e["back"].alias("back"), e["q"].alias("q"), F.zip_with(e["then"], e["q"], lambda p, q: fn.dequantize(p, q, STEP)).alias("coded")), options)

        now, then = x["px"], a["decoded"]
        fresh = (F.size(then) == 0) | (fn.sad(now, then) > CUT * area)
        parts = F.struct(now.alias("now"), then.alias("then"), F.transform(a["background"], lambda v: v.cast("int")).alias("back"), F.zip_with(now, then, lambda v, p: fn.quantize(v - p, STEP)).alias("q"))
        best = F.when(fresh, choice(F.lit(0), 0, "key", F.lit(area), now)).otherwise(_bound(parts, coded))

        def moved(b: Column) -> Column:
            blend = F.zip_with(F.arrays_zip(then.alias("then"), a["background"].alias("bg")), b["got"], lambda o, v: F.when((F.abs(v - o["then"]) < 2) & (F.abs(v - o["bg"]) < 4), 0.95 * o["bg"] + 0.05 * v).otherwise(o["bg"]))
            log = F.struct(x["frame"].alias("frame"), b["mode"].alias("mode"), b["bytes"].alias("bytes"), fn.ssd(now, b["got"]).cast("long").alias("sse"))
            background = F.when(fresh, F.transform(now, lambda v: v.cast("double"))).otherwise(blend)
            group, full = F.concat(a["group"], F.array(log)), F.size(a["group"]) == GROUP - 1
            return F.struct(b["got"].alias("decoded"), background.alias("background"), F.when(full, F.array().cast(result)).otherwise(group).alias("group"), F.when(full, F.concat(a["out"], F.array(group))).otherwise(a["out"]).alias("out"))

        return _bound(best, moved)

    start = F.struct(F.array().cast("array<int>").alias("decoded"), F.array().cast("array<double>").alias("background"), F.array().cast(result).alias("group"), F.array().cast(f"array<{result}>").alias("out"))
    whole = F.aggregate("series", start, step, lambda a: F.concat(F.flatten(a["out"]), a["group"]))
    df = series.select("video", "by", "bx", F.explode(whole).alias("o"))
    return df.select("video", "by", "bx", "o.frame", "o.mode", "o.bytes", "o.sse")


def boxes_of_equal_modes(modes: np.ndarray, longest: int = 8) -> list[tuple[int, int, int, int]]:
    """Greedy cover of a grid of modes by boxes (y, x, h, w) of one mode, each grown in width, then in height: every cell once."""
    taken = np.zeros(modes.shape, bool)
    out = []
    for y, x in np.ndindex(modes.shape):
        if taken[y, x]:
            continue
        w = h = 1
        while w < longest and x + w < modes.shape[1] and not taken[y, x + w] and modes[y, x + w] == modes[y, x]:
            w += 1
        while h < longest and y + h < modes.shape[0] and not taken[y + h, x : x + w].any() and (modes[y + h, x : x + w] == modes[y, x]).all():
            h += 1
        taken[y : y + h, x : x + w] = True
        out.append((y, x, h, w))
    return out


def dynamic_boxes(modes: DataFrame, rows: int, cols: int) -> DataFrame:
    """(video, frame, by, bx, h, w, mode): the boxes that cover each frame's grid of modes (video, frame, by, bx, mode)."""
    grid = modes.groupBy("video", "frame").agg(F.array_sort(F.collect_list(F.struct("by", "bx", "mode"))).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for video, frame, cells in batch.itertuples(index=False):
                names = np.full((rows, cols), "", object)
                for c in cells:
                    names[c["by"], c["bx"]] = c["mode"]
                out += [(video, frame, y, x, h, w, names[y, x]) for y, x, h, w in boxes_of_equal_modes(names)]
            yield pd.DataFrame(out, columns=["video", "frame", "by", "bx", "h", "w", "mode"])

    return grid.mapInPandas(run, "video int, frame int, by int, bx int, h int, w int, mode string")
