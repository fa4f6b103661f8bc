"""Frames as images: cosine reconstruction, quadtrees, level centres and holes of masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from .tracking import cosine_basis


def dct_error(frames: DataFrame, side: int, keep: int) -> DataFrame:
    """(video, frame, mse) of a frame against what its keep x keep lowest cosine coefficients give back, all within a row."""
    rows = cosine_basis(side, keep)
    waves = [[a * b for a in rows[ky] for b in rows[kx]] for ky in range(keep) for kx in range(keep)]
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    df = frames.withColumn("_c", F.transform(F.lit(waves), lambda w: total(F.zip_with("px", w, lambda p, b: p * b))))
    back = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: total(F.zip_with("_c", F.lit(waves), lambda c, w: c * F.get(w, i))))
    df = df.withColumn("_back", back)
    return df.select("video", "frame", F.round(total(F.zip_with("px", "_back", lambda p, g: (p - g) * (p - g))) / (side * side), 3).alias("mse"))


def opened_closed(frames: DataFrame, side: int) -> DataFrame:
    """(video, frame, opened, closed): the frames after grey opening and closing over 3 x 3 pixels, which shrink at the borders."""
    cells = F.sequence(F.lit(0), F.lit(side * side - 1))

    def near(px: str, best) -> Column:
        def one(i: Column) -> Column:
            y, x = F.floor(i / side).cast("int"), i % side
            held = lambda dy, dx: F.when((y + dy).between(0, side - 1) & (x + dx).between(0, side - 1), F.get(px, i + dy * side + dx))
            return best(F.array(*[held(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))

        return F.transform(cells, one)

    df = frames.withColumn("_low", near("px", F.array_min)).withColumn("_high", near("px", F.array_max))
    return df.select("video", "frame", near("_low", F.array_max).alias("opened"), near("_high", F.array_min).alias("closed"))


def quadtree(frames: DataFrame, side: int, limit: float) -> DataFrame:
    """(video, frame, side, tag, area): a frame's smallest squares, of a quarter of its side, each counted with the leaf that holds it.

    A square of side s is split in four while its variance is above limit and s is more than a quarter of the frame's side. A leaf
    is EDGE if its levels span more than 40, else CHAOS if its variance is above 1.5, else FLAT.
    """
    least, n = side // 4, 4

    def square(px: Column, size: int) -> Column:
        y, x = F.floor(F.col("cell") / n).cast("int") * least, F.col("cell") % n * least
        y, x = F.floor(y / size).cast("int") * size, F.floor(x / size).cast("int") * size
        held = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.get(px, (y + F.floor(i / size).cast("int")) * side + x + i % size))
        return F.transform(F.array(held), lambda v: F.struct(_variance(v, size * size).alias("var"), (F.array_max(v) - F.array_min(v)).alias("span"), F.lit(size).alias("side")))

    df = frames.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    squares = {s: F.get(square(F.col("px"), s), F.lit(0)) for s in (side, side // 2, least)}
    df = df.select("video", "frame", *[v.alias(f"_{s}") for s, v in squares.items()])
    leaf = F.when(F.col(f"_{side}.var") <= limit, F.col(f"_{side}")).when(F.col(f"_{side // 2}.var") <= limit, F.col(f"_{side // 2}")).otherwise(F.col(f"_{least}"))
    df = df.select("video", "frame", leaf.alias("leaf"))
    tag = F.when(F.col("leaf.span") > 40, "EDGE").when(F.col("leaf.var") > 1.5, "CHAOS").otherwise("FLAT")
    return df.select("video", "frame", "leaf.side", tag.alias("tag"), F.lit(least * least).alias("area"))


def _variance(v: Column, n: int) -> Column:
    s, ss = fn.array_sum(v), fn.array_sum(F.transform(v, lambda x: x * x))
    return (n * ss - s * s).cast("double") / (n * n)


def level_centres(df: DataFrame, value: str, k: int, rounds: int) -> DataFrame:
    """(k, centre, n): centres of k groups of levels 0..255 by Lloyd's rounds from even levels; the nearest, lowest of equals, takes a level.

    Rounds run over the histogram, which has 256 rows at most whatever the number of pixels.
    """
    h = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("v", "n")).alias("h"))

    def near(c: Column, v: Column) -> Column:
        return F.array_min(F.transform(c, lambda x, i: F.struct(F.abs(v - x).alias("d"), i.alias("i"))))["i"]

    def owned(c: Column) -> Column:
        """Per centre the sum and number of its pixels, in one pass over the histogram."""
        own = F.transform("h", lambda s: F.struct(near(c, s["v"]).alias("i"), s["v"].alias("v"), s["n"].alias("n")))
        part = lambda o, i, f: F.aggregate(F.filter(o, lambda s: s["i"] == i), F.lit(0).cast("long"), lambda a, s: a + f(s))
        return F.get(F.transform(F.array(own), lambda o: F.transform(c, lambda x, i: F.struct(x.alias("c"), part(o, i, lambda s: s["v"] * s["n"]).alias("s"), part(o, i, lambda s: s["n"]).alias("n")))), F.lit(0))

    first = F.array(*[F.lit(255.0 * i / (k - 1)) for i in range(k)])
    moved = lambda c: F.transform(owned(c), lambda g: F.when(g["n"] > 0, g["s"].cast("double") / g["n"]).otherwise(g["c"]))
    df = h.withColumn("c", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda c, _: moved(c)))
    df = df.select(F.posexplode(owned(F.col("c"))).alias("k", "g"))
    return df.select("k", F.round("g.c", 6).alias("centre"), F.col("g.n").alias("n"))


def holes(frames: DataFrame, side: int, level: int) -> DataFrame:
    """(video, frame, n_filled): pixels of a mask above a level that filling its holes would add, for frames that have any.

    What isn't mask and touches the border, or such a pixel beside it, is outside. A task grows the outside of an Arrow batch of frames at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            free = np.pad(np.stack(batch["px"].to_numpy()).reshape(-1, side, side) <= level, ((0, 0), (1, 1), (1, 1)), constant_values=True)
            outside = np.zeros_like(free)
            outside[:, 0] = outside[:, -1] = outside[:, :, 0] = outside[:, :, -1] = True
            while True:
                grown = outside.copy()
                grown[:, 1:] |= outside[:, :-1]
                grown[:, :-1] |= outside[:, 1:]
                grown[:, :, 1:] |= outside[:, :, :-1]
                grown[:, :, :-1] |= outside[:, :, 1:]
                grown &= free
                if (grown == outside).all():
                    break
                outside = grown
            out = batch[["video", "frame"]].assign(n_filled=(free & ~outside).sum((1, 2)))
            yield out[out.n_filled > 0]

    return frames.select("video", "frame", "px").mapInPandas(run, "video int, frame int, n_filled long")
