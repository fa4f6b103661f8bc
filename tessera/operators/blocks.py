"""Block modes: what each way to code a block would cost, and the cheapest by a cascade.

Blocks come as rows with an array px of N pixels and prev, the block to predict from, null at the start of a video. Each
candidate is a struct (cost, bytes, mode) that is null where its gate fails. A cost is bytes + rate * SAD. All is column
arithmetic on arrays, so that after the shuffle that found prev there is none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn


@dataclass(frozen=True)
class Gates:
    """Prices and limits. palette, dither and residual are tried only while the cheapest so far costs more than that."""

    step: int = 27
    rate: float = 0.012
    skip_max: int = 4
    solid_range: int = 10
    palette: float = 10
    dither: float = 12
    residual: float = 10
    dense: float = 12


def stats(df: DataFrame) -> DataFrame:
    """Adds n, mn, mx, rng, sad and largest (difference to prev)."""
    df = df.withColumn("n", F.size("px")).withColumn("mn", F.array_min("px")).withColumn("mx", F.array_max("px"))
    return df.withColumn("rng", F.col("mx") - F.col("mn")).withColumn("sad", fn.sad(F.col("px"), F.col("prev"))).withColumn("largest", fn.largest_diff(F.col("px"), F.col("prev")))


def _candidate(ok: Column, size: Column, sad: Column, mode: str, gates: Gates) -> Column:
    return F.when(ok, F.struct((size + gates.rate * sad).alias("cost"), size.cast("int").alias("bytes"), F.lit(mode).alias("mode")))


def solid(df: DataFrame) -> DataFrame:
    """Adds level, the truncated mean, and solid_sad."""
    df = df.withColumn("level", (fn.array_sum(F.col("px")) / F.col("n")).cast("int"))
    return df.withColumn("solid_sad", fn.sad(F.col("px"), F.array_repeat("level", F.col("n"))))


def palette(df: DataFrame) -> DataFrame:
    """Adds colours, the sorted distinct pixels, and indices, each pixel's place among them where there are at most four."""
    df = df.withColumn("colours", F.array_sort(F.array_distinct("px")))
    codes = F.transform("px", lambda v: (F.array_position("colours", v) - 1).cast("int"))
    return df.withColumn("indices", F.when(F.size("colours") <= 4, codes))


def two_colours(df: DataFrame) -> DataFrame:
    """Adds low and high, the truncated means on either side of the middle of the range, and two_sad, two_ssd, two_max."""
    middle = F.expr("(mn + mx) div 2")
    mean = lambda xs: F.when(F.size(xs) > 0, (fn.array_sum(xs) / F.size(xs)).cast("int")).otherwise(0)
    df = df.withColumn("_mid", middle)
    df = df.withColumn("low", mean(F.filter("px", lambda v: v <= F.col("_mid")))).withColumn("high", mean(F.filter("px", lambda v: v > F.col("_mid"))))
    df = df.withColumn("_two", F.transform("px", lambda v: F.when(v > F.col("_mid"), F.col("high")).otherwise(F.col("low"))))
    px, two = F.col("px"), F.col("_two")
    return df.withColumn("two_sad", fn.sad(px, two)).withColumn("two_ssd", fn.ssd(px, two)).withColumn("two_max", fn.largest_diff(px, two)).drop("_mid", "_two")


def dither(df: DataFrame) -> DataFrame:
    """Adds levels, four from the least pixel to the largest, dither_codes, the nearest of them (lowest of equals), and dither_sad."""
    df = df.withColumn("levels", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("mn") + F.floor(i * F.col("rng") / 3).cast("int")))
    nearest = lambda v: F.array_min(F.transform("levels", lambda x, i: F.struct(F.abs(v - x).alias("d"), i.alias("i"))))["i"]
    df = df.withColumn("dither_codes", F.transform("px", nearest))
    return df.withColumn("dither_sad", fn.sad(F.col("px"), F.transform("dither_codes", lambda i: F.get("levels", i))))


def residual(df: DataFrame, step: int) -> DataFrame:
    """Adds q, the quantised difference to prev, recon, nnz, residual_sad and sparse, the (place, value) pairs that aren't zero."""
    df = df.withColumn("q", F.zip_with("px", "prev", lambda a, b: fn.quantize(a - b, step)))
    df = df.withColumn("recon", F.zip_with("prev", "q", lambda p, q: fn.dequantize(p, q, step)))
    pairs = F.filter(F.transform("q", lambda q, i: F.struct(i.alias("i"), q.alias("q"))), lambda s: s["q"] != 0)
    df = df.withColumn("sparse", pairs).withColumn("nnz", F.size("sparse"))
    return df.withColumn("residual_sad", fn.sad(F.col("px"), F.col("recon"))).withColumn("residual_max", fn.largest_diff(F.col("px"), F.col("recon")))


def candidates(df: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Adds each mode's struct: raw, solid, exact, two, dithered, coded."""
    df = residual(dither(two_colours(palette(solid(stats(df))))), gates.step)
    n, rng = F.col("n"), F.col("rng")
    quarter = n / 4
    few = F.size("colours") <= 4
    tiny = (rng <= 2) & (F.col("solid_sad") <= n / 8)
    c = lambda ok, size, sad, mode: _candidate(ok, size, sad, mode, gates)
    dense = F.col("nnz") >= n / 2
    df = df.withColumn("raw", c(F.lit(True), n + 1, F.coalesce("sad", F.lit(0)), "raw"))
    one = F.struct(F.lit(1.5).alias("cost"), F.lit(1).alias("bytes"), F.lit("solid").alias("mode"))
    df = df.withColumn("solid", F.when(tiny, one).otherwise(c(rng < gates.solid_range, F.lit(2), F.col("solid_sad"), "solid")))
    df = df.withColumn("exact", c((rng > 2) & few, 1 + F.size("colours") + quarter, F.lit(0), "palette"))
    df = df.withColumn("two", c(~few & (rng > 15) & (F.col("two_max") < 8) & (F.col("two_ssd") < 16 * n), 3 + quarter, F.col("two_sad"), "palette"))
    df = df.withColumn("dithered", c(rng > 20, 5 + quarter, F.col("dither_sad"), "dither"))
    return df.withColumn("coded", c(F.col("prev").isNotNull(), F.when(dense, F.lit(gates.dense)).otherwise(1 + 2 * F.col("nnz")), F.col("residual_sad"), "residual"))


def cascade(df: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Adds best: the incumbent after each candidate in turn, which only a strictly cheaper one replaces while its gate is open."""
    cheaper = lambda new, gate: F.when((F.col("best")["cost"] > gate) & (F.col(new)["cost"] < F.col("best")["cost"]), F.col(new)).otherwise(F.col("best"))
    df = df.withColumn("best", F.col("raw")).withColumn("best", cheaper("solid", 0))
    df = df.withColumn("best", cheaper("exact", gates.palette)).withColumn("best", cheaper("two", gates.palette)).withColumn("best", cheaper("dithered", gates.dither))
    spoiled = (F.col("best")["mode"] == "palette") & (F.col("residual_max") >= 8)
    df = df.withColumn("best", F.when(spoiled, F.col("best")).otherwise(cheaper("coded", gates.residual)))
    skip = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("bytes"), F.lit("skip").alias("mode"))
    return df.withColumn("best", F.when(F.col("largest") < gates.skip_max, skip).otherwise(F.col("best")))


def skip_predicates(df: DataFrame, step: int = 27) -> DataFrame:
    """Adds may_skip, skip_by_sad and skip_by_mse to blocks in order: whether a block can be shown by the decoded block before.

    Decoded is the source before plus its quantised residual. may_skip: the largest difference to the decoded block is below 4, or the
    source hardly moved (largest below 3, all below half a level a pixel) and the decoded block is within 8. The older rules ask for a mean absolute
    or squared difference to the source before below 2. A block without one before can't be skipped.
    """
    w = Window.partitionBy("video", "by", "bx").orderBy("frame")
    df = residual(stats(df), step).withColumn("_decoded", F.lag(F.coalesce("recon", "px")).over(w))
    far = fn.largest_diff(F.col("px"), F.col("_decoded"))
    n = F.size("px")
    still = (F.col("largest") < 3) & (2 * F.col("sad") < n)
    has = lambda c: F.coalesce(c, F.lit(False))
    df = df.withColumn("may_skip", has((far < 4) | still & (far < 8))).withColumn("skip_by_sad", has(F.col("sad") < 2 * n))
    return df.withColumn("skip_by_mse", has(fn.ssd(F.col("px"), F.col("prev")) < 2 * n)).drop("_decoded")


def rd_optimal(df: DataFrame) -> DataFrame:
    """Adds best: the cheapest of all candidates, whatever the gates; the earlier of equals."""
    order = ["raw", "solid", "exact", "two", "dithered", "coded"]
    ranked = [F.when(F.col(c).isNotNull(), F.struct(F.col(c)["cost"].alias("cost"), F.lit(i).alias("rank"), F.col(c)["bytes"].alias("bytes"), F.col(c)["mode"].alias("mode"))) for i, c in enumerate(order)]
    return df.withColumn("best", F.array_min(F.array_compact(F.array(*ranked))))
