"""Queries over the signal plane, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import signal, windows
from ..sources.relations import PLANE, plane

QUERIES, ORACLES = {}, {}
C = ["cell"]
STEP = 27


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {PLANE} {sql}" if not sql.startswith(",") else f"with {PLANE}{sql}"
        return f

    return add


@query("select cell, frame, v from plane")
def plane_build(spark, d) -> DataFrame:
    return plane(spark, d)


LAG = "abs(v - lag(v) over (partition by cell order by frame))"


@query(f", l as (select cell, frame, {LAG} diff from plane) select * from l where diff is not null")
def lag_abs_diff(spark, d) -> DataFrame:
    return windows.lag_diff(plane(spark, d).select("cell", "frame", "v"), C, "frame", "v").select("cell", "frame", "diff").filter("diff is not null")


@query(f", l as (select *, {LAG} diff from plane) select frame, count(diff)::bigint n, coalesce(sum(diff), 0)::bigint total, coalesce(sum(diff) > 35 * count(diff), false) is_cut from l group by frame")
def scene_cut_flags(spark, d) -> DataFrame:
    df = windows.lag_diff(plane(spark, d), C, "frame", "v").groupBy("frame").agg(F.count("diff").alias("n"), F.coalesce(F.sum("diff"), F.lit(0)).cast("long").alias("total"))
    return df.withColumn("is_cut", F.col("total") > 35 * F.col("n"))


@query(", l as (select cell, frame, coalesce(abs(v - lag(v) over w) > 100, true) cut from plane window w as (partition by cell order by frame)) select cell, frame, sum(cut::int) over (partition by cell order by frame)::bigint gop from l")
def gop_id(spark, d) -> DataFrame:
    df = windows.lag_diff(plane(spark, d), C, "frame", "v")
    return windows.group_number(df, C, "frame", F.coalesce(F.col("diff") > 100, F.lit(True)), "gop").select("cell", "frame", "gop")


HIST = """, h as (select frame, v, count(*) n from plane group by all), g as (select f.frame, b.v, coalesce(h.n, 0) n
  from (select distinct frame from plane) f cross join (select unnest(range(256)) v) b left join h on h.frame = f.frame and h.v = b.v)"""


@query(f"""{HIST}, p as (select a.frame, count(*) k, sum(a.n) sa, sum(b.n) sb, sum(a.n * b.n) sab, sum(a.n * a.n) saa, sum(b.n * b.n) sbb from g a join g b on b.frame = a.frame - 1 and a.v = b.v group by a.frame),
  l as (select frame, case when frame - lag(frame) over w = 1 then abs(v - lag(v) over w) end d from plane window w as (partition by cell order by frame)), m as (select frame, avg(d) m from l group by frame)
  select p.frame, round((k * sab - sa * sb)::double / sqrt((k * saa - sa * sa)::double * (k * sbb - sb * sb)::double), 6) correlation, round(m, 6) mean_change,
  (k * sab - sa * sb)::double / sqrt((k * saa - sa * sa)::double * (k * sbb - sb * sb)::double) < 0.4 or coalesce(m > 90, false) is_cut from p join m on m.frame = p.frame""")
def scene_cut_hist_corr(spark, d) -> DataFrame:
    """Cells jump from day to day, by 85 on average, so that a mean change counts as a cut above 90."""
    return signal.histogram_cuts(plane(spark, d), "cell", "frame", "v", most=90.0)


@query(f""", l as (select cell, frame, row_number() over (partition by cell order by frame) n, coalesce({LAG} < 40, false) skip from plane),
  i as (select *, n - row_number() over (partition by cell order by frame) k from l where skip) select cell, min(frame) "start", count(*)::bigint "length" from i group by cell, k""")
def skip_runs(spark, d) -> DataFrame:
    df = windows.lag_diff(plane(spark, d), C, "frame", "v")
    return windows.runs_of(df, C, "frame", F.coalesce(F.col("diff") < 40, F.lit(False))).select("cell", "start", "length")


RESIDUAL = f", l as (select *, lag(v) over (partition by cell order by frame) p from plane), q as (select *, cast(round_even((v - p) / {STEP}, 0) as int) q from l where p is not null)"


@query(f"{RESIDUAL} select cell, frame, q, greatest(0, least(255, p + q * {STEP})) recon from q")
def quantize_residual(spark, d) -> DataFrame:
    df = plane(spark, d).withColumn("p", F.lag("v").over(windows.ordered(C, "frame"))).filter("p is not null")
    df = df.withColumn("q", fn.quantize(F.col("v") - F.col("p"), STEP))
    return df.select("cell", "frame", "q", fn.dequantize(F.col("p"), F.col("q"), STEP).alias("recon"))


@query(f"{RESIDUAL} select frame, sum((q <> 0)::int)::bigint n_coded, sum((abs(q) > 1)::int)::bigint n_after_deadzone from q group by frame")
def deadzone_quantize(spark, d) -> DataFrame:
    df = plane(spark, d).withColumn("p", F.lag("v").over(windows.ordered(C, "frame"))).filter("p is not null")
    q = fn.quantize(F.col("v") - F.col("p"), STEP)
    n = lambda x: F.sum((x != 0).cast("long"))
    return df.groupBy("frame").agg(n(q).alias("n_coded"), n(fn.deadzone(q)).alias("n_after_deadzone"))


@query(""", s as (select cell, list({'bg': v::double, 'l': v::double} order by frame) s from plane group by cell)
  select cell, round(list_reduce(s, lambda a, x: {'bg': case when abs(x.l - a.l) < 60 and abs(x.l - a.bg) < 90 then 0.95::double * a.bg + 0.05::double * x.l else a.bg end, 'l': x.l}).bg, 6) background from s""")
def ema_background(spark, d) -> DataFrame:
    return windows.ema(plane(spark, d), C, "frame", "v", still=60, near=90).select("cell", F.round("background", 6).alias("background"))


WORST = """, w as (select cell, v, sum(v) over (partition by cell order by frame rows between 4 preceding and current row) s, count(*) over (partition by cell order by frame rows between 4 preceding and current row) n from plane)
  select cell, round(coalesce(max(case when n = 5 then s / 5.0::double end), {}(v)::double), 6) worst from w group by cell"""


@query(WORST.format("max"))
def sliding5_worst_mean(spark, d) -> DataFrame:
    return windows.worst_mean(plane(spark, d), C, "frame", "v").select("cell", F.round(F.col("worst").cast("double"), 6).alias("worst"))


@query(WORST.format("avg"))
def sliding5_worst_mean_or_mean(spark, d) -> DataFrame:
    return windows.worst_mean(plane(spark, d), C, "frame", "v", fallback="mean").select("cell", F.round("worst", 6).alias("worst"))


@query(", s as (select *, avg(v) over (partition by cell) m, stddev_pop(v) over (partition by cell) sd from plane) select cell, frame, v from s where v > m + 2 * sd and v > 3")
def spike_detect(spark, d) -> DataFrame:
    return windows.spikes(plane(spark, d), C, "v").select("cell", "frame", "v")


@query("select cell, median(v)::double clean from plane group by cell")
def temporal_median(spark, d) -> DataFrame:
    return plane(spark, d).groupBy("cell").agg(F.median("v").cast("double").alias("clean"))


@query("select cell, frame, sum((v > 128)::int) over w::bigint n_active, sum((v > 128)::int) over w > 3 hot from plane window w as (partition by cell order by frame rows between 9 preceding and current row)")
def ring10_active(spark, d) -> DataFrame:
    return windows.active_in_ring(plane(spark, d), C, "frame", F.col("v") > 128).select("cell", "frame", "n_active", "hot")


@query(""", l as (select *, coalesce(frame - lag(frame) over (partition by cell order by frame) > 5, true) fresh from plane),
  s as (select *, sum(fresh::int) over (partition by cell order by frame)::bigint "session" from l),
  g as (select cell, "session", min(frame) "first", max(frame) "last", count(*)::bigint n from s group by all)
  select *, "last" + 6 <= (select max(frame) from plane) despawned from g""")
def inactivity_despawn(spark, d) -> DataFrame:
    p = plane(spark, d)
    end = p.agg(F.max("frame").alias("end"))
    return windows.sessions(p, C, "frame", 5).join(F.broadcast(end)).withColumn("despawned", F.col("last") + 6 <= F.col("end")).drop("end")


@query("select frame, v, count(*)::bigint n, round(count(*)::double / max(count(*)) over (partition by frame), 6) share, count(*) >= 0.05 * max(count(*)) over (partition by frame) is_peak from plane group by frame, v")
def histogram256(spark, d) -> DataFrame:
    return signal.histogram(plane(spark, d), ["frame"], "v")


@query(""", h as (select frame, v, count(*)::bigint n from plane group by all), c as (select *, sum(n) over w nb, sum(n * v) over w sb, sum(n) over (partition by frame) nt, sum(n * v) over (partition by frame) st from h window w as (partition by frame order by v)),
  s as (select frame, v, case when nb < nt then (sb * nt - st * nb)::double * (sb * nt - st * nb)::double / (nb::double * (nt - nb)::double) else 0 end score from c)
  select frame, arg_min(v, struct_pack(a := -score, b := v)) threshold from s group by frame""")
def otsu_threshold(spark, d) -> DataFrame:
    return signal.otsu(plane(spark, d), ["frame"], "v")


DECODED = f"{RESIDUAL}, r as (select *, v - greatest(0, least(255, p + q * {STEP})) e from q), m as (select frame, sum(e * e)::bigint se, count(*)::bigint n from r group by frame)"


def _frame_mse(spark, d) -> DataFrame:
    r = quantize_residual(spark, d).join(plane(spark, d), ["cell", "frame"])
    e = F.col("v") - F.col("recon")
    return r.groupBy("frame").agg(F.sum(e * e).cast("long").alias("se"), F.count("*").alias("n"))


@query(f"{DECODED} select frame, n, round(se::double / n, 6) mse, case when se > 0 then round(10 * log10(65025.0::double * n / se), 4) else 'inf'::double end psnr from m")
def frame_mse_psnr(spark, d) -> DataFrame:
    mse = F.col("se").cast("double") / F.col("n")
    return _frame_mse(spark, d).select("frame", "n", F.round(mse, 6).alias("mse"), F.when(F.col("se") > 0, F.round(fn.psnr(mse), 4)).otherwise(float("inf")).alias("psnr"))


@query(f"{DECODED}, x as (select frame, se::double / n mse from m) select quality, count(*)::bigint n, round(avg(mse), 6) avg_mse, round(max(mse), 6) worst_mse from (select *, case when mse <= 10 then 'Visually Lossless' when mse <= 50 then 'Good' when mse <= 150 then 'Acceptable' when mse <= 400 then 'Degraded' else 'Poor' end quality from x) group by quality")
def quality_bands(spark, d) -> DataFrame:
    df = _frame_mse(spark, d).withColumn("mse", F.col("se").cast("double") / F.col("n"))
    df = df.withColumn("quality", fn.band(F.col("mse"), fn.QUALITY_BANDS, "Poor"))
    return df.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("mse"), 6).alias("avg_mse"), F.round(F.max("mse"), 6).alias("worst_mse"))


@query(f"{DECODED} select round(avg(se::double / n), 6) mean_of_frames, round(sum(se)::double / sum(n), 6) pooled, sum((se > 0.001 * n)::int)::bigint n_mismatched, bool_and(se = 0) lossless from m")
def fidelity_summary(spark, d) -> DataFrame:
    df = _frame_mse(spark, d)
    return df.agg(
        F.round(F.avg(F.col("se").cast("double") / F.col("n")), 6).alias("mean_of_frames"),
        F.round(F.sum("se").cast("double") / F.sum("n"), 6).alias("pooled"),
        F.sum((F.col("se") > 0.001 * F.col("n")).cast("long")).alias("n_mismatched"),
        F.bool_and(F.col("se") == 0).alias("lossless"),
    )


MODES = f""", l as (select *, lag(v) over (partition by cell order by frame) p from plane), m as (select *, case when p is null then 'raw' when abs(v - p) < 4 then 'skip'
  when cast(round_even((v - p) / {STEP}, 0) as int) <> 0 then 'residual' else 'solid' end mode from l),
  b as (select frame, mode, case mode when 'skip' then 0 when 'solid' then 1 when 'residual' then 2 else 4 end bytes from m)"""


def _modes(spark, d) -> DataFrame:
    p = F.lag("v").over(windows.ordered(C, "frame"))
    q = fn.quantize(F.col("v") - F.col("p"), STEP)
    df = plane(spark, d).withColumn("p", p)
    mode = F.when(F.col("p").isNull(), "raw").when(F.abs(F.col("v") - F.col("p")) < 4, "skip").when(q != 0, "residual").otherwise("solid")
    df = df.withColumn("mode", mode)
    return df.withColumn("bytes", F.when(F.col("mode") == "skip", 0).when(F.col("mode") == "solid", 1).when(F.col("mode") == "residual", 2).otherwise(4))


@query(f"{MODES} select frame, mode, count(*)::bigint n, sum(bytes)::bigint bytes, round(100.0::double * count(*) / sum(count(*)) over (partition by frame), 6) share from b group by frame, mode")
def mode_histogram(spark, d) -> DataFrame:
    return signal.share_of(_modes(spark, d).groupBy("frame", "mode").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes")), ["frame"], "n", "share")


@query(f"{MODES}, s as (select mode, sum(bytes)::bigint bytes, count(*)::bigint n from b group by mode) select mode, bytes, n, round(100.0::double * bytes / sum(bytes) over (), 6) share from s")
def mode_bytes_share(spark, d) -> DataFrame:
    return signal.share_of(_modes(spark, d).groupBy("mode").agg(F.sum("bytes").cast("long").alias("bytes"), F.count("*").alias("n")), [], "bytes", "share")


@query("select cell, frame, v from plane where frame % greatest(1, 30 // 15) = 0")
def strided_sample(spark, d) -> DataFrame:
    return plane(spark, d).filter(F.col("frame") % max(1, 30 // 15) == 0)


@query("select cell, frame, v from plane where frame < 10 and cell < (select max(cell) + 1 from plane) - (select max(cell) + 1 from plane) % 16")
def bounded_scan_cropped(spark, d) -> DataFrame:
    p = plane(spark, d)
    edge = p.agg((F.max("cell") + 1 - (F.max("cell") + 1) % 16).alias("edge"))
    return p.filter("frame < 10").join(F.broadcast(edge), F.col("cell") < F.col("edge")).drop("edge")


@query("select frame, count(*)::bigint n, frame % 6 = 0 is_key from plane group by frame")
def periodic_keyframe(spark, d) -> DataFrame:
    return plane(spark, d).groupBy("frame").agg(F.count("*").alias("n")).withColumn("is_key", F.col("frame") % 6 == 0)


@query(", x as (select *, case when v % 3 = 0 then v end vec from plane) select cell, frame, coalesce(last_value(vec ignore nulls) over (partition by cell order by frame rows between unbounded preceding and current row), -1) carried from x")
def carried_vector(spark, d) -> DataFrame:
    df = plane(spark, d).withColumn("vec", F.when(F.col("v") % 3 == 0, F.col("v")))
    return windows.carried(df, C, "frame", "vec", "carried").select("cell", "frame", F.coalesce("carried", F.lit(-1)).alias("carried"))


@query(", x as (select cell, frame, case when count(*) over w = 5 then round(stddev_pop(v) over w, 5) end drift from plane window w as (partition by cell order by frame rows between 4 preceding and current row)) select cell, frame, drift, coalesce(drift <= 40, false) coherent from x")
def coherence(spark, d) -> DataFrame:
    df = windows.drift(plane(spark, d), C, "frame", "v").withColumn("drift", F.round("drift", 5))
    return df.select("cell", "frame", "drift", F.coalesce(F.col("drift") <= 40, F.lit(False)).alias("coherent"))


@query(", x as (select *, row_number() over (partition by cell order by frame desc) r from plane) select cell, list(v order by frame) last_values, count(*)::bigint n from x where r <= 8 group by cell")
def history_of_eight(spark, d) -> DataFrame:
    df = windows.last_of_key(plane(spark, d), C, "frame", 8).groupBy("cell")
    return df.agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", "v"))), lambda s: s["v"]).alias("last_values"), F.count("*").alias("n"))


SEGMENTS = """, c as (select cell, v > 128 busy, frame from plane), n as (select frame, cell, row_number() over (partition by frame order by cell) k from c where busy),
  i as (select frame, cell, coalesce(cell - lag(cell) over (partition by frame order by cell) > 2, true) fresh from n), s as (select *, sum(fresh::int) over (partition by frame order by cell) seg from i),
  g as (select frame, min(cell) "start", max(cell) + 1 - min(cell) width from s group by frame, seg having max(cell) + 1 - min(cell) >= 2),
  found as (select frame, "start", width, width > 1.6::double * median(width) over (partition by frame) wide, median(width) over (partition by frame) middle from g)"""


@query(f"{SEGMENTS} select frame, \"start\", width, wide from found")
def projection_segments(spark, d) -> DataFrame:
    return signal.segments(plane(spark, d).filter("v > 128"), ["frame"], "cell", gap=1, least=2, wide=1.6)


@query(f"""{SEGMENTS}, k as (select *, case when wide then greatest(2, least(width, round(width / middle)::bigint)) else 1 end n from found), p as (select *, unnest(range(n::bigint)) part from k)
  select frame, "start" + part * (width // n) + least(part, width % n) "start", width // n + (part < width % n)::int width, part from p""")
def split_segments(spark, d) -> DataFrame:
    """The segments, wide ones cut into even parts about as wide as the median."""
    return signal.split_wide(projection_segments(spark, d), ["frame"], 1.6)


@query(""", x as (select frame, cell, v from plane), o as (select frame, max(v) over w dil, min(v) over w ero, cell, v from x window w as (partition by frame order by cell rows between 1 preceding and 1 following)),
  y as (select frame, cell, v, dil, max(ero) over w opened, min(dil) over w closed from o window w as (partition by frame order by cell rows between 1 preceding and 1 following)) select * from y""")
def morph_open_close(spark, d) -> DataFrame:
    return signal.open_close(plane(spark, d), ["frame"], "cell", "v")


@query(f"""{RESIDUAL}, e as (select case when abs(v - p) < 4 then 'skip' when q <> 0 then 'residual' else 'solid' end mode, (v - greatest(0, least(255, p + q * {STEP}))) * (v - greatest(0, least(255, p + q * {STEP}))) e from q)
  select coalesce(mode, 'all') mode, count(*)::bigint n, round(sum(e)::double / count(*), 6) avg_mse, max(e) worst from e group by rollup (mode)""")
def mode_error_rollup(spark, d) -> DataFrame:
    """Count, mean and worst squared error per mode and over all."""
    df = _modes(spark, d).filter("p is not null").withColumn("q", fn.quantize(F.col("v") - F.col("p"), STEP))
    e = F.col("v") - fn.dequantize(F.col("p"), F.col("q"), STEP)
    df = df.select("mode", (e * e).alias("e")).rollup("mode").agg(F.count("*").alias("n"), F.round(F.sum("e").cast("double") / F.count("*"), 6).alias("avg_mse"), F.max("e").alias("worst"))
    return df.withColumn("mode", F.coalesce("mode", F.lit("all")))


@query(", h as (select frame, v, list(v) over (partition by cell order by frame rows between 255 preceding and 1 preceding) past from plane) select frame, count(*)::bigint n, sum(coalesce(list_contains(past, v), false)::int)::bigint hits, sum(coalesce(len(list_filter(past, lambda x: abs(x - v) < 5)) > 0, false)::int)::bigint near from h group by frame")
def recent_value_hits(spark, d) -> DataFrame:
    """How often a cell's value, or one within 5 of it, is among its last 255: a first-in first-out cache per cell."""
    w = windows.ordered(C, "frame").rowsBetween(-255, -1)
    df = plane(spark, d).withColumn("past", F.collect_list("v").over(w))
    near = F.exists("past", lambda x: F.abs(x - F.col("v")) < 5)
    return df.groupBy("frame").agg(F.count("*").alias("n"), F.sum(F.array_contains("past", F.col("v")).cast("long")).alias("hits"), F.sum(near.cast("long")).alias("near"))


@query("select 'early' part, cell, frame, v from plane where frame < 5 union all select 'late', cell, frame, v from plane where frame >= 25")
def union_of_scans(spark, d) -> DataFrame:
    p = plane(spark, d)
    early, late = p.filter("frame < 5").withColumn("part", F.lit("early")), p.filter("frame >= 25").withColumn("part", F.lit("late"))
    return early.unionByName(late).select("part", "cell", "frame", "v")


@query(f"{RESIDUAL}, m as (select cell, frame from q where v <> greatest(0, least(255, p + q * {STEP}))), ll as (select cell, list(frame order by frame) f, count(*)::bigint n from m group by cell) select cell, array_to_string(f[:5], ', ') || case when n > 5 then ' ...' else '' end first_frames, n from ll")
def first_mismatches(spark, d) -> DataFrame:
    df = quantize_residual(spark, d).join(plane(spark, d), ["cell", "frame"]).filter("v <> recon").groupBy("cell")
    df = df.agg(F.sort_array(F.collect_list("frame")).alias("f"), F.count("*").alias("n"))
    return df.select("cell", F.concat(F.array_join(F.slice("f", 1, 5), ", "), F.when(F.col("n") > 5, " ...").otherwise("")).alias("first_frames"), "n")


@query(""", d as (select a.cell, a.frame, a.v - b.v dv from plane a join plane b on a.cell = b.cell and a.frame = b.frame + 1), t as (select cell, v, count(*) n from plane group by all), s as (select cell, count(*)::bigint n_states, max(n)::bigint longest from t group by cell)
  select s.cell, n_states, longest, (select count(*) from d where d.cell = s.cell and dv <> 0)::bigint transitions from s""")
def state_lifetimes(spark, d) -> DataFrame:
    """Distinct states of a cell, how often the commonest was held, and changes between days that follow each other."""
    p = plane(spark, d)
    states = p.groupBy("cell", "v").agg(F.count("*").alias("n")).groupBy("cell").agg(F.count("*").alias("n_states"), F.max("n").alias("longest"))
    w = windows.ordered(C, "frame")
    moved = (F.col("v") != F.lag("v").over(w)) & (F.col("frame") == F.lag("frame").over(w) + 1)
    changes = p.withColumn("moved", moved).groupBy("cell").agg(F.sum(F.coalesce(F.col("moved").cast("long"), F.lit(0))).alias("transitions"))
    return states.join(changes, "cell").select("cell", "n_states", "longest", "transitions")
