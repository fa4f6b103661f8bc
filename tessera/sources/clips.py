"""Test clips as DataFrames of pixels, drawn by rules; noise is a hash of the place, so it is the same each time."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values in rule(): centres, sizes, levels and periods of the clips.


def _disc(cx, cy, r: int) -> Column:
    x, y = F.col("x"), F.col("y")
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r


def _box(x0, y0, x1, y1) -> Column:
    return F.col("x").between(x0, x1) & F.col("y").between(y0, y1)


def _shift(axis: int) -> Column:
    return (F.pmod(F.xxhash64(F.lit(axis), "frame"), F.lit(7)) - 3).cast("int")


def rule(name: str, h: int, w: int) -> Column:
    """The level of a clip's pixels."""
    when, f, x = F.when, F.col("frame"), F.col("x")
    rules = {
        "motion": when(_disc(50 + 5 * f, F.lit(h // 2), 40), 255).otherwise(0),
        "cache": when((F.floor(f / 15) % 2 == 0) & _box(200, 200, 440, 280), 76).otherwise(0),
        "palette": when(_box(250, 200, 450, 400), 150).when(_box(100, 100, 300, 300), 29).otherwise(50),
        "baseline": F.floor(127 * (1 + F.sin(f / 10.0))).cast("int"),
        "entropy": F.pmod(F.xxhash64("frame", "y", "x"), F.lit(256)).cast("int"),
        "jitter": when(_box(200 + _shift(1), 200 + _shift(2), 400 + _shift(1), 400 + _shift(2)), 255).otherwise(0),
        "fade": when(_disc(50 + 4 * f, F.lit(h // 3), 50), F.greatest(F.lit(10), 255 - 2 * f)).otherwise(0),
        "moire": when(x % F.greatest(F.lit(1), 4 - F.floor(f / 30)) == 0, 255).otherwise(0),
        "scaling": when(_box(50, 50, F.least(F.lit(w - 50), 100 + 4 * f), F.least(F.lit(h - 50), 50 + 2 * f)), 200).when(_box(0, h - 20, F.least(F.lit(400), 10 * f), h), 120).otherwise(30),
        "square": when(_box(100 + 2 * f, F.lit(100), 299 + 2 * f, F.lit(299)), 141).otherwise(0),
    }
    return rules[name].cast("int")


def clip(spark: SparkSession, name: str, frames: int = 90, h: int = 480, w: int = 640) -> DataFrame:
    """(video, frame, y, x, v) of a clip; nothing is gathered anywhere, pixels are computed from their number."""
    n = spark.range(frames * h * w)
    at = n.select(F.expr(f"cast(id div {h * w} as int)").alias("frame"), F.expr(f"cast(id div {w} % {h} as int)").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    return at.select(F.lit(name).alias("video"), "frame", "y", "x", rule(name, h, w).alias("v"))


NAMES = ("motion", "cache", "palette", "baseline", "entropy", "jitter", "fade", "moire", "scaling", "square")
