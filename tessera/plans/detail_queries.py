"""More queries over frames, blocks and the experiment log, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import images, motion, reports, tracking, windows
from ..sources.relations import BLOCK, PIXELS, PLANE, RUNS, SIDE, frames, pixels, runs
from .block_queries import CASCADE, SEARCH, mode_families
from .plane_queries import MODES, STEP, _modes

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {sql}"
        return f

    return add


@query(f"""{PIXELS}, b as (select video, frame, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from pixels where v > 160 group by video, frame),
  c as (select video, frame, greatest(0, x0 - 2) x, greatest(0, y0 - 2) y, least({SIDE - 1}, x1 + 2) xe, least({SIDE - 1}, y1 + 2) ye from b)
  select video, frame, x, y, xe - x + 1 w, ye - y + 1 h from c""")
def roi_clamp(spark, d) -> DataFrame:
    """Boxes of bright pixels with a margin of two, kept within the frame."""
    box = tracking.boxes(pixels(spark, d).filter("v > 160"), ["video", "frame"])
    low, high = (lambda c: F.greatest(F.lit(0), F.col(c) - 2)), (lambda c: F.least(F.lit(SIDE - 1), F.col(c) + 2))
    df = box.select("video", "frame", low("x0").alias("x"), low("y0").alias("y"), high("x1").alias("xe"), high("y1").alias("ye"))
    return df.select("video", "frame", "x", "y", (F.col("xe") - F.col("x") + 1).alias("w"), (F.col("ye") - F.col("y") + 1).alias("h"))


@query(f"""{PIXELS}, basis as (select k, i, case when k = 0 then sqrt(1.0::double / {SIDE}) else sqrt(2.0::double / {SIDE}) end * cos(pi() * (2 * i + 1) * k / {2 * SIDE}) c from (select unnest(range(4)) k) a, (select unnest(range({SIDE})) i) b),
  co as (select p.video, p.frame, r.k ky, s.k kx, sum(r.c * s.c * p.v) c from pixels p join basis r on r.i = p.y join basis s on s.i = p.x group by all),
  re as (select p.video, p.frame, p.y, p.x, p.v, sum(co.c * r.c * s.c) got from pixels p join co using (video, frame) join basis r on r.k = co.ky and r.i = p.y join basis s on s.k = co.kx and s.i = p.x group by all)
  select video, frame, round(avg((v - got) * (v - got)), 3) mse from re group by video, frame""")
def dct_reconstruct(spark, d) -> DataFrame:
    """Error of each frame after its lowest 4 x 4 cosine coefficients alone are turned back into pixels."""
    return images.dct_error(frames(spark, d), SIDE, 4)


_VAR = "(count(*) over {0} * sum(v * v) over {0} - sum(v) over {0} * sum(v) over {0})::double / (count(*) over {0} * count(*) over {0})"


@query(f"""{PIXELS}, s as (select video, {_VAR.format("a")} v0, {_VAR.format("b")} v1, {_VAR.format("c")} v2, max(v) over a - min(v) over a r0, max(v) over b - min(v) over b r1, max(v) over c - min(v) over c r2 from pixels
    window a as (partition by video, frame), b as (partition by video, frame, y // 4, x // 4), c as (partition by video, frame, y // 2, x // 2)),
  l as (select video, case when v0 <= 40 then 8 when v1 <= 40 then 4 else 2 end side, case when v0 <= 40 then v0 when v1 <= 40 then v1 else v2 end var, case when v0 <= 40 then r0 when v1 <= 40 then r1 else r2 end rng from s),
  t as (select video, side, case when rng > 40 then 'EDGE' when var > 1.5 then 'CHAOS' else 'FLAT' end tag from l),
  g as (select case when grouping(video) = 1 then 'corpus' else video::varchar end video, side, tag, count(*)::bigint area, grouping(video) g from t group by grouping sets ((video, side, tag), (side, tag)))
  select video, side, tag, area, round(100.0::double * area / sum(area) over (partition by video), 6) share from g""")
def quadtree_area(spark, d) -> DataFrame:
    """Area in pixels of a quadtree's leaves by side and tag, per video and over all: a square whose variance is above 40 is split in four."""
    leaves = images.quadtree(frames(spark, d), SIDE, limit=40.0)
    df = leaves.groupingSets([["video", "side", "tag"], ["side", "tag"]], "video", "side", "tag").agg(F.sum("area").cast("long").alias("area"), F.grouping("video").alias("g"))
    df = df.select(F.when(F.col("g") == 1, "corpus").otherwise(F.col("video").cast("string")).alias("video"), "side", "tag", "area")
    return df.withColumn("share", F.round(100.0 * F.col("area") / F.sum("area").over(Window.partitionBy("video")), 6))


@query(None)
def sixteen_levels(spark, d) -> DataFrame:
    """Sixteen levels for all pixels by Lloyd's rounds over their histogram."""
    return images.level_centres(pixels(spark, d), "v", k=16, rounds=10)


@query(f"""{PIXELS}, m as (select video, frame, y, x from pixels where v <= 120),
  r as (select * from (with recursive r(video, frame, y, x) as (select video, frame, y, x from m where y in (0, {SIDE - 1}) or x in (0, {SIDE - 1})
    union select m.video, m.frame, m.y, m.x from r join m on m.video = r.video and m.frame = r.frame and abs(m.y - r.y) + abs(m.x - r.x) = 1) select * from r))
  select m.video, m.frame, count(*)::bigint n_filled from m anti join r on r.video = m.video and r.frame = m.frame and r.y = m.y and r.x = m.x group by m.video, m.frame""")
def filled_holes(spark, d) -> DataFrame:
    """How many pixels of each mask above 120 are holes: below it, and not joined to the border by such pixels side by side."""
    return images.holes(frames(spark, d), SIDE, 120)


@query(f"""{PLANE}{MODES}, q as (select mode, case when p is not null then (v - greatest(0, least(255, p + cast(round_even((v - p) / {STEP}, 0) as int) * {STEP}))) * (v - greatest(0, least(255, p + cast(round_even((v - p) / {STEP}, 0) as int) * {STEP}))) else 0 end e from m),
  a as (select mode, count(*)::bigint n, round(sum(e)::double / count(*), 6) avg_mse from q group by mode) select row_number() over (order by avg_mse, mode)::int rank, mode, n, avg_mse from a""")
def modes_by_error(spark, d) -> DataFrame:
    """Modes ranked by their mean squared error, least first; raw values have none."""
    df = _modes(spark, d)
    e = F.col("v") - fn.dequantize(F.col("p"), fn.quantize(F.col("v") - F.col("p"), STEP), STEP)
    df = df.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("p").isNotNull(), e * e).otherwise(0)).cast("double") / F.count("*"), 6).alias("avg_mse"))
    return reports.top(df, F.col("avg_mse").asc(), "mode", 4).select("rank", "mode", "n", "avg_mse")


@query(f"{RUNS} select perm, count(*)::bigint n, sum(orig_bytes)::bigint orig, sum(comp_bytes)::bigint comp, round(avg(comp_bytes::double / orig_bytes), 4) mean_ratio, round(40.0::double * count(*) / sum(time_s), 4) fps_at_40 from runs where comp_bytes is not null and orig_bytes > 0 and time_s > 0 group by perm")
def config_grand_totals(spark, d) -> DataFrame:
    """Totals per configuration, its mean ratio, and frames a second as if each run had forty."""
    ok = runs(spark, d).filter("comp_bytes is not null and orig_bytes > 0 and time_s > 0")
    return ok.groupBy("perm").agg(
        F.count("*").alias("n"), F.sum("orig_bytes").alias("orig"), F.sum("comp_bytes").alias("comp"),
        F.round(F.avg(F.col("comp_bytes").cast("double") / F.col("orig_bytes")), 4).alias("mean_ratio"), F.round(40.0 * F.count("*") / F.sum("time_s"), 4).alias("fps_at_40"),
    )


#: Names, colours and bits of the modes.
LEGEND = [("skip", "Skip", "gray", 0), ("solid", "Solid", "blue", 1), ("palette", "Palette", "green", 2), ("dither", "Dither", "violet", 4), ("residual", "Residual", "yellow", 8), ("raw", "Raw", "red", 16), ("background", "Background", "white", 32)]


@query(f"""{CASCADE}, m as (select mode, count(*)::bigint n, sum(bytes)::bigint bytes from best group by mode), legend as (select * from (values {", ".join(map(str, LEGEND))}) t(mode, name, colour, bits))
  select l.mode, name, colour, bits, coalesce(n, 0)::bigint n, coalesce(m.bytes, 0)::bigint bytes, round(100.0::double * coalesce(n, 0) / (select sum(n) from m), 6) share, coalesce(n, 0) = 0 unused from legend l left join m on m.mode = l.mode""")
def mode_legend(spark, d) -> DataFrame:
    """The modes with their names, colours and bits, their share of all blocks, and whether none takes them."""
    entry = F.struct("mode", F.struct("n", "bytes"))
    counts = mode_families(spark, d).agg(F.map_from_entries(F.collect_list(entry)).alias("counts"), F.sum("n").alias("total"))  # one row, of seven modes at most
    legend = spark.createDataFrame(LEGEND, "mode string, name string, colour string, bits int")
    got = lambda c: F.coalesce(F.try_element_at("counts", F.col("mode"))[c], F.lit(0).cast("long"))
    df = legend.crossJoin(F.broadcast(counts)).withColumn("n", got("n"))
    return df.select("mode", "name", "colour", "bits", "n", got("bytes").alias("bytes"), F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share"), (F.col("n") == 0).alias("unused"))


SNAP = "cast(floor(run_id / 60000) as bigint)"


@query(f"""{RUNS}, h as (select video, {SNAP} snapshot, sum(comp_bytes)::bigint / 1024.0::double kb from runs where comp_bytes is not null group by all),
  p as (select *, lag(kb) over (partition by video order by snapshot) before from h)
  select video, snapshot, round(kb, 4) kb, round(coalesce(kb - before, 0), 4) delta, case when before is null then 'NEW' when kb - before > 0.5 then 'up' when kb - before < -0.5 then 'down' else 'same' end symbol from p""")
def snapshot_delta(spark, d) -> DataFrame:
    """Each snapshot of the log, a range of run ids, against the last one before it that has the video."""
    ok = runs(spark, d).filter("comp_bytes is not null")
    kb = ok.groupBy("video", F.floor(F.col("run_id") / 60000).cast("long").alias("snapshot")).agg((F.sum("comp_bytes") / 1024.0).cast("double").alias("kb"))
    delta = F.col("kb") - F.lag("kb").over(windows.ordered(["video"], "snapshot"))
    return kb.withColumn("delta", delta).select("video", "snapshot", F.round("kb", 4).alias("kb"), F.coalesce(F.round("delta", 4), F.lit(0.0)).alias("delta"), fn.change_symbol(F.col("delta"), 0.5).alias("symbol"))


@query(f"""{SEARCH}, m as (select video, frame, "by", bx, case when b.ssd < 60 * {BLOCK * BLOCK} then b.dy * 100 + b.dx end vec from found), c as (select *, last_value(vec ignore nulls) over (partition by video, frame order by "by", bx rows between unbounded preceding and 1 preceding) held from m)
  select video, count(*)::bigint n_searched, count(held)::bigint n_cached, sum(coalesce(held = vec, false)::int)::bigint n_hits from c group by video""")
def cached_motion(spark, d) -> DataFrame:
    """Of the blocks searched, those that find a vector of an earlier block of their frame, and those whose own it is."""
    found = motion.search(frames(spark, d), BLOCK, 2, SIDE).withColumn("vec", F.when(F.col("ssd") < 60 * BLOCK * BLOCK, F.col("dy") * 100 + F.col("dx")))
    w = Window.partitionBy("video", "frame").orderBy("by", "bx").rowsBetween(Window.unboundedPreceding, -1)
    df = found.withColumn("held", F.last("vec", ignorenulls=True).over(w))
    hit = F.coalesce(F.col("held") == F.col("vec"), F.lit(False))
    return df.groupBy("video").agg(F.count("*").alias("n_searched"), F.count("held").alias("n_cached"), F.sum(hit.cast("long")).alias("n_hits"))


_ROW = "(partition by video, frame, y order by x rows between 1 preceding and 1 following)"
_COL = "(partition by video, frame, x order by y rows between 1 preceding and 1 following)"


@query(f"""{PIXELS}, a as (select *, min(v) over {_ROW} lo, max(v) over {_ROW} hi from pixels), b as (select video, frame, y, x, min(lo) over {_COL} lo, max(hi) over {_COL} hi from a),
  c as (select *, max(lo) over {_ROW} o, min(hi) over {_ROW} c from b), e as (select video, frame, y, x, max(o) over {_COL} o, min(c) over {_COL} c from c)
  select video, frame, array_to_string(list(o order by y, x), ',') opened, array_to_string(list(c order by y, x), ',') closed from e group by video, frame""")
def frame_morphology(spark, d) -> DataFrame:
    """Grey opening and closing of each frame over 3 x 3 pixels."""
    return images.opened_closed(frames(spark, d), SIDE).select("video", "frame", F.array_join("opened", ",").alias("opened"), F.array_join("closed", ",").alias("closed"))
