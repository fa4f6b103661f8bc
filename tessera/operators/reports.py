"""Reports over an experiment log: reductions, contrasts, rankings, resumption, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn


def toggles_of(config: Column) -> Column:
    """A configuration string "+a -b" as map<string, boolean>."""
    tokens = F.filter(F.split(config, " "), lambda t: F.length(t) > 1)
    return F.map_from_entries(F.transform(tokens, lambda t: F.struct(F.substring(t, 2, 1000), t.startswith("+"))))


def config_of(toggles: Column) -> Column:
    """The string back from a map, in the map's order."""
    return F.array_join(F.transform(F.map_entries(toggles), lambda e: F.concat(F.when(e["value"], "+").otherwise("-"), e["key"])), " ")


def short_name(config: Column) -> Column:
    """The names that are on, joined by "+"; "none" if there is none."""
    on = F.transform(F.filter(F.split(config, " "), lambda t: t.startswith("+")), lambda t: F.substring(t, 2, 1000))
    return F.when(F.size(on) > 0, F.array_join(on, "+")).otherwise("none")


def matches(config: Column, tokens: list[str]) -> Column:
    """Whether all tokens stand in a configuration, as words."""
    out = F.lit(True)
    for t in tokens:
        out = out & F.concat(F.lit(" "), config, F.lit(" ")).contains(f" {t} ")
    return out


def per_config(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, orig, comp, unweighted, aggregate): mean reduction of runs, and reduction of all bytes. Failed runs count in neither."""
    ok = runs.filter("comp_bytes is not null and orig_bytes > 0")
    sums = ok.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("orig_bytes").alias("orig"), F.sum("comp_bytes").alias("comp"), F.avg(fn.reduction(F.col("comp_bytes"), F.col("orig_bytes"))).alias("unweighted"))
    return sums.withColumn("aggregate", fn.reduction(F.col("comp"), F.col("orig")))


def contrasts(runs: DataFrame, value: Column) -> DataFrame:
    """(toggle, mean_on, mean_off, diff): a value's means with each toggle on and off. One pass: tokens are counted per run."""
    long = runs.select(value.alias("_v"), F.explode(F.split("config", " ")).alias("_t"))
    long = long.select("_v", F.substring("_t", 2, 1000).alias("toggle"), F.col("_t").startswith("+").alias("_on"))
    df = long.groupBy("toggle").agg(F.avg(F.when(F.col("_on"), F.col("_v"))).alias("mean_on"), F.avg(F.when(~F.col("_on"), F.col("_v"))).alias("mean_off"))
    return df.withColumn("diff", F.col("mean_on") - F.col("mean_off"))


def top(df: DataFrame, order: Column, tie: str, n: int) -> DataFrame:
    """The first n rows with their rank. The limit comes first, so that the rank's single task sees n rows."""
    best = df.orderBy(order, tie).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(order, tie)))


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that no finished run covers."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def regression(now: DataFrame, before: DataFrame, keys: list[str], value: str, dead: float) -> DataFrame:
    """Adds before, delta and a symbol to each row of now: up, down, same or NEW."""
    old = before.select(*keys, F.col(value).alias("before"))
    df = now.join(old, keys, "left").withColumn("delta", F.col(value) - F.col("before"))
    return df.withColumn("symbol", fn.change_symbol(F.col("delta"), dead))


def trial_spread(runs: DataFrame, keys: list[str], rate: Column) -> DataFrame:
    """Runs, mean and population deviation of a rate per key, from whole hundredths in decimals, so that sums are exact; halves round up."""
    c = F.floor(rate * 100).cast("decimal(18,0)")
    df = runs.groupBy(*keys).agg(F.count(c).alias("n"), F.sum(c).cast("decimal(38,0)").alias("s"), F.sum((c * c).cast("decimal(28,0)")).cast("decimal(38,0)").alias("ss"))
    n = F.col("n").cast("decimal(38,0)")
    spread = ((n * F.col("ss")).cast("decimal(38,0)") - (F.col("s") * F.col("s")).cast("decimal(38,0)")).cast("double")
    deviation = F.floor(10 * F.sqrt(spread) / F.col("n") + 0.5) / 1000
    return df.select(*keys, "n", (F.expr("(20 * s + n) div (2 * n)") / 1000).alias("mean_fps"), deviation.alias("sd_fps"))


def markdown(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(line_no, line): rows of a small ranked table as Markdown."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    return df.select(F.col(order).alias("line_no"), line.alias("line"))


def pick(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Those of the named columns that df has, under their new names."""
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items() if c in df.columns])
