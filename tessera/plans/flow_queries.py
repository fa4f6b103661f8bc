"""Queries that stream, or write and read files again, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..env import scratch, stored
from ..functions import scalars as fn
from ..operators import tracking
from ..sources import container
from ..sources.relations import FRAMES, PLANE, SIDE, frames, pixels, plane, read, runs
from ..streaming import processors, state

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Micro-batches that a stream's input is written for, so that state is carried from one to the next.
BATCHES = 4


def _events(spark, d, *columns: str) -> DataFrame:
    """Columns of the events, to be fed to a stream in the order of time."""
    return stored(read(spark, d, "events").select(*columns, F.unix_seconds(F.col("ts").cast("timestamp")).alias("second")))


@query("select cast(ts as date)::timestamp window_start, event_type, count(*)::bigint n, sum(floor(value * 100)::bigint)::bigint cents from events group by all")
def stream_windowed_counts(spark, d) -> DataFrame:
    got = processors.fed(_events(spark, d, "ts", "event_type", "value"), "second", BATCHES, state.windowed_counts)
    last = F.max_by(F.struct("n", "cents"), "batch")
    return got.groupBy("window_start", "event_type").agg(last.alias("l")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "l.n", "l.cents")


@query("select user_id, epoch_us(max(ts)) // 1000 last_ms from events group by user_id having epoch_us(max(ts)) // 1000 + 10800000 < (select epoch_us(max(ts)) // 1000 from events)")
def stream_inactive_users(spark, d) -> DataFrame:
    """Users without an event for three hours when the stream ends, by event-time timers: of each the last that was said."""
    held = _events(spark, d, "user_id", "ts")
    buckets = processors.buckets_for(held.count())
    got = processors.fed(held, "second", BATCHES, lambda src: processors.silent(src, "user_id", "ts", 3 * 3600 * 1000, buckets=buckets), "append")
    last = got.groupBy("key").agg(F.max(F.struct("last_ms", "silent")).alias("l"))
    return last.filter("l.silent").select(F.col("key").alias("user_id"), "l.last_ms")


@query(f"""with {PLANE}, s as (select cell, list({{'bg': v::double, 'l': v::double}} order by frame) s from plane group by cell)
  select cell, round(list_reduce(s, lambda a, x: {{'bg': case when abs(x.l - a.l) < 60 and abs(x.l - a.bg) < 90 then 0.95::double * a.bg + 0.05::double * x.l else a.bg end, 'l': x.l}}).bg, 6) background from s""")
def stream_ema_background(spark, d) -> DataFrame:
    # as in the SQL, what has no day comes last, and halves of 1e-6 are told on the product
    held = stored(plane(spark, d).withColumn("frame", F.coalesce("frame", F.lit(31))))
    buckets = processors.buckets_for(held.count())
    got = processors.fed(held, "frame", BATCHES, lambda src: processors.background(src, still=60, near=90, buckets=buckets))
    return got.groupBy("cell").agg((F.floor(F.max_by("background", "frame") * 1e6 + 0.5) / 1e6).alias("background"))


def _objects(found: DataFrame) -> DataFrame:
    return processors.fed(stored(found), "frame", BATCHES, lambda src: state.stream_objects(src, within=5.0, patience=2)).drop("batch")


def _regions(spark, d) -> DataFrame:
    row = F.array_sort(F.collect_list(F.struct("blob", "cx", "cy", "x", "y")))
    return tracking.blobs(pixels(spark, d).filter("v > 150"), SIDE).groupBy("video", "frame").agg(row.alias("regions"))


@query(None)
def stream_object_events(spark, d) -> DataFrame:
    return _objects(_regions(spark, d))


@query(None)
def stream_scene_objects(spark, d) -> DataFrame:
    """The same, where a frame whose mean change is above 18 is a scene cut: it ends all objects and starts none."""
    held = tracking.with_previous(frames(spark, d))
    cuts = held.filter(fn.sad(F.col("px"), F.col("prev")) > 18 * SIDE * SIDE).select("video", "frame", F.lit(True).alias("cut"))
    found = _regions(spark, d).join(cuts, ["video", "frame"], "full")
    return _objects(found.select("video", "frame", F.when(F.col("cut").isNull(), F.col("regions")).alias("regions")))


@query(f"with {FRAMES} select video, frame, list_sum(px)::bigint total, list_max(px) brightest, md5(array_to_string(px, ',')) pixels_md5 from frames")
def container_round_trip(spark, d) -> DataFrame:
    """Frames written as key frames and changes, read back and restored: every pixel counts in the digest."""
    path = scratch(spark)
    container.deltas(frames(spark, d)).write.parquet(path)
    back = container.restored(spark.read.parquet(path))
    return back.select("video", "frame", F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.array_max("px").alias("brightest"), F.md5(F.array_join("px", ",").cast("binary")).alias("pixels_md5"))


@query("select l_returnflag || l_linestatus video, count(*)::bigint n, sum(floor(l_extendedprice)::bigint)::bigint orig from lineitem group by all")
def csv_log_round_trip(spark, d) -> DataFrame:
    """The log as CSV with a header, appended in two parts and read back with its schema."""
    path = scratch(spark)
    log = runs(spark, d).select("run_id", "video", "orig_bytes", "comp_bytes", "frames")
    log.filter("run_id % 2 = 0").write.option("header", True).csv(path)
    log.filter("run_id % 2 = 1").write.mode("append").option("header", True).csv(path)
    back = spark.read.schema(log.schema).option("header", True).csv(path)
    return back.groupBy("video").agg(F.count("*").alias("n"), F.sum("orig_bytes").alias("orig"))
