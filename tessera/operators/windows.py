"""Operators over an ordered signal: keys, an order column, a value column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: list[str], order: str | list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def lag_diff(df: DataFrame, keys: list[str], order: str, value: str, out: str = "diff") -> DataFrame:
    """Adds |value - the value observed before|; null at the first."""
    return df.withColumn(out, F.abs(F.col(value) - F.lag(value).over(ordered(keys, order))))


def runs_of(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """(keys, start, length) of each unbroken run of rows with the flag: islands by a difference of row numbers."""
    w = ordered(keys, order)
    held = df.select(*keys, order, F.row_number().over(w).alias("_n"), flag.alias("_flag")).filter("_flag")
    held = held.withColumn("_island", F.col("_n") - F.row_number().over(w))
    return held.groupBy(*keys, "_island").agg(F.min(order).alias("start"), F.count("*").alias("length")).drop("_island")


def group_number(df: DataFrame, keys: list[str], order: str, starts: Column, out: str) -> DataFrame:
    """Adds a running count of rows that start a group."""
    return df.withColumn(out, F.sum(starts.cast("long")).over(ordered(keys, order)))


def worst_mean(df: DataFrame, keys: list[str], order: str | list[str], value: str, size: int = 5, fallback: str = "max") -> DataFrame:
    """(keys, worst): the largest mean of size rows in a row. With fewer rows their max or their mean, as fallback says."""
    if fallback not in ("max", "mean"):
        raise ValueError("fallback is max or mean")
    w = ordered(keys, order).rowsBetween(1 - size, 0)
    held = df.select(*keys, F.col(value).alias("_v"), F.avg(value).over(w).alias("_m"), F.count(value).over(w).alias("_n"))
    few = F.max("_v") if fallback == "max" else F.avg("_v")
    return held.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_n") == size, F.col("_m"))), few).alias("worst"))


def spikes(df: DataFrame, keys: list[str], value: str, sigmas: float = 2.0, least: float = 3.0) -> DataFrame:
    """Rows above mean + sigmas * population deviation of their group, and above least."""
    w = Window.partitionBy(*keys)
    limit = F.avg(value).over(w) + sigmas * F.stddev_pop(value).over(w)
    return df.withColumn("_limit", limit).filter((F.col(value) > F.col("_limit")) & (F.col(value) > least)).drop("_limit")


def spikes_of_few(df: DataFrame, keys: list[str], value: str, sigmas: float = 2.0, least: float = 3.0) -> DataFrame:
    """spikes() for a few large groups: limits come from a partial aggregation, so that no task sorts or holds a group."""
    limits = df.groupBy(*keys).agg((F.avg(value) + sigmas * F.stddev_pop(value)).alias("_limit"))
    return df.join(limits, keys).filter((F.col(value) > F.col("_limit")) & (F.col(value) > least)).drop("_limit")


def active_in_ring(df: DataFrame, keys: list[str], order: str, active: Column, size: int = 10, more_than: int = 3) -> DataFrame:
    """Adds n_active of the last size rows, and whether that is more than more_than."""
    w = ordered(keys, order).rowsBetween(1 - size, 0)
    return df.withColumn("n_active", F.sum(active.cast("int")).over(w)).withColumn("hot", F.col("n_active") > more_than)


def sessions(df: DataFrame, keys: list[str], order: str, gap: int) -> DataFrame:
    """(keys, session, first, last, n): rows of a key until more than gap steps are missing."""
    w = ordered(keys, order)
    new = F.coalesce(F.col(order) - F.lag(order).over(w) > gap, F.lit(True))
    held = df.withColumn("_new", new).withColumn("session", F.sum(F.col("_new").cast("long")).over(w))
    return held.groupBy(*keys, "session").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def ema(df: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.05, still: float = 2, near: float = 4) -> DataFrame:
    """(keys, background): an exponential mean that a value moves only where it lies within still of the value before and within
    near of the background. A fold in the order of each key, inside one aggregation; state is one key's series."""
    series = F.sort_array(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v"))))
    first = lambda s: F.struct(F.get(s, F.lit(0))["v"].alias("bg"), F.get(s, F.lit(0))["v"].alias("last"))

    def step(a, x):
        moves = (F.abs(x["v"] - a["last"]) < still) & (F.abs(x["v"] - a["bg"]) < near)
        return F.struct(F.when(moves, (1 - alpha) * a["bg"] + alpha * x["v"]).otherwise(a["bg"]).alias("bg"), x["v"].alias("last"))

    held = df.groupBy(*keys).agg(series.alias("_s"))
    return held.select(*keys, F.aggregate(F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), first(F.col("_s")), step)["bg"].alias("background"))


def carried(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Adds the last value that isn't null up to each row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(ordered(keys, order)))


def drift(df: DataFrame, keys: list[str], order: str, value: str, size: int = 5) -> DataFrame:
    """Adds the population deviation of the last size rows, null before there are so many."""
    w = ordered(keys, order).rowsBetween(1 - size, 0)
    return df.withColumn("drift", F.when(F.count(value).over(w) == size, F.stddev_pop(value).over(w)))


def last_of_key(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
