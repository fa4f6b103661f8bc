"""Histograms, thresholds, segments and neighbourhoods of a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 256


def histogram(df: DataFrame, keys: list[str], value: str, peak: float = 0.05) -> DataFrame:
    """(keys, value, n, share, is_peak): counts, each as a share of its key's largest, and whether that is peak or more."""
    h = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(*keys))
    return h.select(*keys, value, "n", F.round(F.col("n").cast("double") / most, 6).alias("share"), (F.col("n") >= peak * most).alias("is_peak"))


def histogram_cuts(df: DataFrame, cell: str, order: str, value: str, least: float = 0.4, most: float = 20.0) -> DataFrame:
    """(order, correlation, mean_change, is_cut) of each step: how its histogram of LEVELS bins correlates with that of the step before,
    and the mean absolute change of the cells that both hold; a cut where one is below least or the other above most.

    Only bins that are filled meet in the join; the empty ones add to the number of bins alone. Scaling a histogram
    between its least and largest count doesn't change its correlation, so none is done.
    """
    h = df.groupBy(order, value).agg(F.count("*").alias("n"))
    sums = h.groupBy(order).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"))
    before = lambda t: t.withColumn(order, F.col(order) + 1)
    cross = h.join(before(h).withColumnRenamed("n", "m"), [order, value]).groupBy(order).agg(F.sum(F.col("n") * F.col("m")).alias("nm"))
    w = Window.partitionBy(cell).orderBy(order)
    change = F.when(F.lag(order).over(w) == F.col(order) - 1, F.abs(F.col(value) - F.lag(value).over(w)))
    moved = df.select(order, change.alias("_d")).groupBy(order).agg(F.sum("_d").cast("double").alias("d"), F.count("_d").alias("nd"))
    df = sums.join(before(sums).toDF(order, "t", "tt"), order).join(cross, order, "left").fillna(0, ["nm"]).join(moved, order)
    c = lambda name: F.col(name).cast("double")
    r = (LEVELS * c("nm") - c("s") * c("t")) / F.sqrt((LEVELS * c("ss") - c("s") * c("s")) * (LEVELS * c("tt") - c("t") * c("t")))
    df = df.select(order, r.alias("r"), F.when(F.col("nd") > 0, F.col("d") / F.col("nd")).alias("m"))
    return df.select(order, F.round("r", 6).alias("correlation"), F.round("m", 6).alias("mean_change"), ((F.col("r") < least) | F.coalesce(F.col("m") > most, F.lit(False))).alias("is_cut"))


def otsu(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, threshold): the level that parts a histogram with the largest variance between both sides, the lowest of equals."""
    h = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    up, all_ = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    mass = F.col("n") * F.col(value)
    h = h.select(*keys, value, F.sum("n").over(up).alias("nb"), F.sum(mass).over(up).alias("sb"), F.sum("n").over(all_).alias("nt"), F.sum(mass).over(all_).alias("st"))
    gap = (F.col("sb") * F.col("nt") - F.col("st") * F.col("nb")).cast("double")
    score = F.when(F.col("nb") < F.col("nt"), gap * gap / (F.col("nb").cast("double") * (F.col("nt") - F.col("nb")).cast("double"))).otherwise(0.0)
    return h.groupBy(*keys).agg(F.min_by(value, F.struct(-score, F.col(value))).alias("threshold"))


def share_of(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds a value's share in percent of its key's total. Expects aggregated rows, as few as the groups."""
    return df.withColumn(out, F.round(100.0 * F.col(value) / F.sum(value).over(Window.partitionBy(*(keys or [F.lit(0)]))), 6))


#: Places of one range: segments and neighbourhoods are worked out range by range.
RANGE = 1024


def segments(df: DataFrame, keys: list[str], place: str, gap: int, least: int, wide: float) -> DataFrame:
    """(keys, start, width, wide): runs of places, joined over gaps, of least width at least; wide ones exceed the median so many times.

    Runs are found within ranges of RANGE places, so that a key's places are spread over tasks; of each range only the first and the last
    run can go on in the next one, so only these meet, key by key. The median comes from an aggregation.
    """
    own = [*keys, "_range"]
    w = Window.partitionBy(*own).orderBy(place)
    df = df.select(*keys, place, F.floor(F.col(place) / RANGE).cast("long").alias("_range"))
    df = df.withColumn("_new", F.coalesce(F.col(place) - F.lag(place).over(w) > gap + 1, F.lit(True))).withColumn("_run", F.sum(F.col("_new").cast("long")).over(w))
    runs = df.groupBy(*own, "_run").agg(F.min(place).alias("_a"), F.max(place).alias("_z"))
    last = F.max("_run").over(Window.partitionBy(*own))
    runs = runs.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == last))
    v = Window.partitionBy(*keys).orderBy("_a")
    edge = runs.filter("_edge").withColumn("_new", F.coalesce(F.col("_a") - F.lag("_z").over(v) > gap + 1, F.lit(True)) | (F.col("_run") > 1))
    edge = edge.withColumn("_joined", F.sum(F.col("_new").cast("long")).over(v)).groupBy(*keys, "_joined").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"))
    both = runs.filter("not _edge").select(*keys, "_a", "_z").unionByName(edge.select(*keys, "_a", "_z"))
    both = both.select(*keys, F.col("_a").alias("start"), (F.col("_z") + 1 - F.col("_a")).alias("width")).filter(F.col("width") >= least)
    middle = both.groupBy(*keys).agg(F.median("width").alias("_middle"))
    return both.join(middle, keys).select(*keys, "start", "width", (F.col("width") > wide * F.col("_middle")).alias("wide"))


def split_wide(found: DataFrame, keys: list[str], wide: float) -> DataFrame:
    """(keys, start, width, part): segments() with each wide one cut into as many even parts as it holds medians, the first parts longest."""
    middle = found.groupBy(*keys).agg(F.median("width").alias("_middle"))
    n = F.when(F.col("wide"), F.greatest(F.lit(2), F.least(F.col("width"), F.round(F.col("width") / F.col("_middle")).cast("long")))).otherwise(F.lit(1).cast("long"))
    df = found.join(middle, keys).withColumn("_n", n).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    even, over = F.floor(F.col("width") / F.col("_n")), F.col("width") % F.col("_n")
    start = F.col("start") + F.col("part") * even + F.least(F.col("part"), over)
    return df.select(*keys, start.alias("start"), (even + (F.col("part") < over).cast("long")).alias("width"), "part")


def open_close(df: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """Adds dil, opened and closed: grey morphology over three neighbours in the order of place, which shrink at the edges.

    It is worked out within ranges of RANGE places, each with the two places before and after it copied over.
    """
    reach = 2
    own = [*keys, "_range"]
    df = df.withColumn("_range", F.floor(F.col(place) / RANGE).cast("long"))
    cell = F.struct(F.col(place).alias("_p"), F.col(value).alias("_v"))
    held = F.sort_array(F.collect_list(cell))
    ends = df.groupBy(*own).agg(held.alias("_s")).select(*own, F.slice("_s", 1, reach).alias("_head"), F.reverse(F.slice(F.reverse("_s"), 1, reach)).alias("_tail"))
    w = Window.partitionBy(*keys).orderBy("_range")  # one row a range
    near = lambda side, step: [F.coalesce(step(side, k).over(w), F.array().cast(ends.schema["_head"].dataType)) for k in (2, 1)]
    before = F.reverse(F.slice(F.reverse(F.concat(*near("_tail", F.lag))), 1, reach))
    after = F.slice(F.concat(*reversed(near("_head", F.lead))), 1, reach)
    halo = ends.select(*own, F.concat(before, after).alias("_c")).select(*own, F.explode("_c").alias("_c")).select(*own, F.col("_c._p").alias(place), F.col("_c._v").alias(value), F.lit(True).alias("_halo"))
    columns = df.columns
    whole = df.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    n = Window.partitionBy(*own).orderBy(place).rowsBetween(-1, 1)
    whole = whole.withColumn("dil", F.max(value).over(n)).withColumn("_ero", F.min(value).over(n))
    whole = whole.withColumn("opened", F.max("_ero").over(n)).withColumn("closed", F.min("dil").over(n))
    return whole.filter("not _halo").select(*[c for c in columns if c != "_range"], "dil", "opened", "closed")
