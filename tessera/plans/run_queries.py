"""Queries over the experiment log, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import reports, windows
from ..sources.relations import RUNS, TOGGLES, runs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {RUNS}{'' if sql.startswith(',') else ' '}{sql}"
        return f

    return add


def r4(c):
    return F.round(c, 4)


RED = "(100 - comp_bytes * 100.0::double / orig_bytes)"
OK = "comp_bytes is not null and orig_bytes > 0"
PER = f", per as (select perm, config, count(*)::bigint n, sum(orig_bytes)::bigint orig, sum(comp_bytes)::bigint comp, avg({RED}) unweighted, 100 - sum(comp_bytes)::bigint * 100.0::double / sum(orig_bytes)::bigint aggregate from runs where {OK} group by perm, config)"


@query(f"{PER} select perm, n, orig, comp, round(unweighted, 4) unweighted, round(aggregate, 4) aggregate from per")
def reduction_unweighted_vs_weighted(spark, d) -> DataFrame:
    df = reports.per_config(runs(spark, d), ["perm", "config"])
    return df.select("perm", "n", "orig", "comp", r4("unweighted").alias("unweighted"), r4("aggregate").alias("aggregate"))


@query(f"{PER}, t as (select perm, round(unweighted, 4) unweighted from per) select row_number() over (order by unweighted desc, perm)::int rank, * from t order by rank limit 20")
def topn_configs(spark, d) -> DataFrame:
    df = reports.per_config(runs(spark, d), ["perm"]).select("perm", r4("unweighted").alias("unweighted"))
    return reports.top(df, F.col("unweighted").desc(), "perm", 20)


@query(f", t as (select orig_bytes, comp_bytes, unnest(string_split(config, ' ')) t from runs where {OK}) select t[2:] toggle, round(avg({RED}) filter (t[1] = '+'), 4) mean_on, round(avg({RED}) filter (t[1] = '-'), 4) mean_off, round(avg({RED}) filter (t[1] = '+') - avg({RED}) filter (t[1] = '-'), 4) diff from t group by t[2:]")
def toggle_on_off_contrast(spark, d) -> DataFrame:
    ok = runs(spark, d).filter(OK)
    df = reports.contrasts(ok, fn.reduction(F.col("comp_bytes"), F.col("orig_bytes")))
    return df.select("toggle", r4("mean_on").alias("mean_on"), r4("mean_off").alias("mean_off"), r4("diff").alias("diff"))


@query(f", v as (select video, avg(frames / greatest(time_s, 0.001::double)) mean_fps, stddev_pop(frames / greatest(time_s, 0.001::double)) sd_fps, avg({RED}) red from runs where {OK} group by video), b as (select avg({RED}) base from runs where {OK}) select video, round(mean_fps, 4) mean_fps, round(sd_fps, 4) sd_fps, round(red - base, 4) delta, case when red >= base then 'gain' else 'loss' end sign from v, b")
def loo_delta(spark, d) -> DataFrame:
    ok = runs(spark, d).filter(OK)
    speed, red = fn.fps(F.col("frames"), F.col("time_s")), fn.reduction(F.col("comp_bytes"), F.col("orig_bytes"))
    per = ok.groupBy("video").agg(F.avg(speed).alias("m"), F.stddev_pop(speed).alias("s"), F.avg(red).alias("red"))
    base = ok.agg(F.avg(red).alias("base"))  # one row
    delta = F.col("red") - F.col("base")
    return per.join(F.broadcast(base)).select("video", r4("m").alias("mean_fps"), r4("s").alias("sd_fps"), r4(delta).alias("delta"), F.when(delta >= 0, "gain").otherwise("loss").alias("sign"))


@query(", todo as (select p.perm, v.video from (select distinct perm from runs) p, (select distinct video from runs) v) select t.perm, t.video from todo t anti join (select perm, video from runs where comp_bytes is not null) r on r.perm = t.perm and r.video = t.video")
def resume_anti_join(spark, d) -> DataFrame:
    r = runs(spark, d)
    tasks = r.select("perm").distinct().crossJoin(F.broadcast(r.select("video").distinct()))  # videos: a handful
    return reports.pending(tasks, r.filter("comp_bytes is not null"), ["perm", "video"])


WORST = ", w as (select video, perm, comp_bytes, avg(comp_bytes) over o m, count(comp_bytes) over o n from runs window o as (partition by video, perm order by run_id rows between 4 preceding and current row)), x as (select video, perm, max(comp_bytes) largest, round(coalesce(max(case when n = 5 then m end), max(comp_bytes)), 4) worst from w group by video, perm), s as (select video, perm, count(*)::bigint n from runs group by video, perm)"


@query(f"{WORST} select s.video, s.perm, s.n, coalesce(x.largest, 0) largest, coalesce(x.worst, 0) worst from s left join x on s.video = x.video and s.perm = x.perm")
def summary_left_join_worst(spark, d) -> DataFrame:
    r = runs(spark, d, placed=True)
    worst = windows.worst_mean(r, ["video", "perm"], ["run_id", "place"], "comp_bytes")
    most = r.groupBy("video", "perm").agg(F.count("*").alias("n"), F.max("comp_bytes").alias("largest"))
    df = most.join(worst, ["video", "perm"], "left")
    return df.select("video", "perm", "n", F.coalesce("largest", F.lit(0)).alias("largest"), F.coalesce(F.round("worst", 4), F.lit(0.0)).alias("worst"))


@query(f", h as (select video, perm % 64 grp, run_id % 2 half, sum(comp_bytes)::bigint / 1024.0::double kb from runs where comp_bytes is not null group by all), a as (select * from h where half = 1), b as (select * from h where half = 0) select a.video, a.grp, round(a.kb, 4) kb, round(coalesce(a.kb - b.kb, 0), 4) delta, case when b.kb is null then 'NEW' when a.kb - b.kb > 0.5 then 'up' when a.kb - b.kb < -0.5 then 'down' else 'same' end symbol from a left join b on a.video = b.video and a.grp = b.grp")
def regression_delta(spark, d) -> DataFrame:
    ok = runs(spark, d).filter("comp_bytes is not null").withColumn("grp", F.col("perm") % 64)
    kb = ok.groupBy("video", "grp", (F.col("run_id") % 2).alias("half")).agg((F.sum("comp_bytes") / 1024.0).alias("kb"))
    df = reports.regression(kb.filter("half = 1"), kb.filter("half = 0"), ["video", "grp"], "kb", 0.5)
    return df.select("video", "grp", r4("kb").alias("kb"), F.coalesce(r4("delta"), F.lit(0.0)).alias("delta"), "symbol")


@query(f"select coalesce(video, 'corpus') video, count(*)::bigint n, sum(orig_bytes)::bigint orig, sum(comp_bytes)::bigint comp, round(avg({RED}), 4) mean_reduction, round(sum(frames)::double / sum(time_s), 4) fps from runs where {OK} group by rollup (video)")
def corpus_rollup(spark, d) -> DataFrame:
    ok = runs(spark, d).filter(OK)
    df = ok.rollup("video").agg(F.count("*").alias("n"), F.sum("orig_bytes").alias("orig"), F.sum("comp_bytes").alias("comp"), r4(F.avg(fn.reduction(F.col("comp_bytes"), F.col("orig_bytes")))).alias("mean_reduction"), r4(F.sum("frames").cast("double") / F.sum("time_s")).alias("fps"))
    return df.withColumn("video", F.coalesce("video", F.lit("corpus")))


@query(", x as (select distinct perm, perm & 1 p, config from runs) select case when contains(' ' || config || ' ', ' +palette ') then 'palette' else 'plain' end family, contains(' ' || config || ' ', ' +dct4 ') and contains(' ' || config || ' ', ' -dct8 ') low_only, count(*)::bigint n, sum(p)::bigint n_spatial from x group by all")
def config_predicates(spark, d) -> DataFrame:
    df = runs(spark, d).select("perm", "config").distinct()
    family = F.when(reports.matches(F.col("config"), ["+palette"]), "palette").otherwise("plain")
    return df.groupBy(family.alias("family"), reports.matches(F.col("config"), ["+dct4", "-dct8"]).alias("low_only")).agg(F.count("*").alias("n"), F.sum(F.col("perm").bitwiseAND(1)).cast("long").alias("n_spatial"))


@query(", x as (select distinct perm, config from runs) select perm, config, len(list_filter(string_split(config, ' '), lambda t: t[1] = '+'))::int n_on, coalesce(nullif(array_to_string(list_transform(list_filter(string_split(config, ' '), lambda t: t[1] = '+'), lambda t: t[2:]), '+'), ''), 'none') short from x")
def config_codec(spark, d) -> DataFrame:
    df = runs(spark, d).select("perm", "config").distinct().withColumn("toggles", reports.toggles_of(F.col("config")))
    n_on = F.size(F.map_filter("toggles", lambda _, v: v))
    return df.select("perm", reports.config_of(F.col("toggles")).alias("config"), n_on.alias("n_on"), reports.short_name(F.col("config")).alias("short"))


NESTED = " || ".join(f"case when {'false' if t == 'skip' else g} then '+' else '-' end" for t, g in [(t, f"(perm & {1 << k}) > 0" + {"dct8": " and (perm & 32) > 0 and (perm & 512) > 0", "dct4": " and (perm & 512) > 0", "dither": " and (perm & 512) > 0"}.get(t, "")) for k, t in enumerate(TOGGLES)])


@query(f", e as (select distinct perm, {NESTED} effect from runs) select effect, count(*)::bigint n, min(perm) first from e group by effect")
def effective_configs(spark, d) -> DataFrame:
    """Configurations that behave alike: skip is never read, dct8 needs dct4, and dct4 and dither need faded."""
    on = {t: F.col("perm").bitwiseAND(1 << k) > 0 for k, t in enumerate(TOGGLES)}
    on["skip"] = F.lit(False)
    on["dct8"] = on["dct8"] & on["dct4"] & on["faded"]
    on["dct4"], on["dither"] = on["dct4"] & on["faded"], on["dither"] & on["faded"]
    effect = F.concat(*[F.when(on[t], "+").otherwise("-") for t in TOGGLES])
    return runs(spark, d).select("perm", effect.alias("effect")).distinct().groupBy("effect").agg(F.count("*").alias("n"), F.min("perm").alias("first"))


TRIALS = ", t as (select perm, floor(frames / greatest(time_s, 0.001::double) * 100)::bigint c from runs), m as (select perm, count(c)::bigint n, sum(c) s, sum(c * c) ss from t group by perm) select perm, n, ((20 * s + n) // (2 * n))::double / 1000 mean_fps, floor(10 * sqrt((n * ss - s * s)::double) / n + 0.5::double) / 1000 sd_fps from m"


@query(TRIALS)
def trial_mean_std(spark, d) -> DataFrame:
    """Mean and population deviation of the rate over all runs of each perm, from whole hundredths, so that sums are exact."""
    return reports.trial_spread(runs(spark, d), ["perm"], fn.fps(F.col("frames"), F.col("time_s")))


@query(TRIALS)
def trial_mean_std_all(spark, d) -> DataFrame:
    """The name that trial_mean_std over all runs had while that one took three runs of each perm and video."""
    return trial_mean_std(spark, d)


@query("select count(*)::bigint n, count(comp_bytes)::bigint n_ok, round(avg(comp_bytes), 4) mean_ok, round(avg(coalesce(comp_bytes, 0)), 4) mean_if_zero from runs group by ()")
def failed_run_policy(spark, d) -> DataFrame:
    return runs(spark, d).agg(F.count("*").alias("n"), F.count("comp_bytes").alias("n_ok"), r4(F.avg("comp_bytes")).alias("mean_ok"), r4(F.avg(F.coalesce("comp_bytes", F.lit(0)))).alias("mean_if_zero"))


@query(f", b as (select comp_bytes::double / orig_bytes ratio, frames / greatest(time_s, 0.001::double) fps from runs where {OK}), c as (select case when ratio <= 0.5 then 'green' when ratio <= 0.7 then 'light green' when ratio <= 0.8 then 'yellow' when ratio <= 1.0 then 'orange' else 'red' end ratio_band, case when fps >= 10 then 'green' when fps >= 5 then 'yellow' when fps >= 2 then 'orange' else 'red' end speed_band, ratio < 0.8 ok from b) select ratio_band, speed_band, ok, count(*)::bigint n from c group by all")
def report_bands(spark, d) -> DataFrame:
    ratio, speed = F.col("comp_bytes").cast("double") / F.col("orig_bytes"), fn.fps(F.col("frames"), F.col("time_s"))
    df = runs(spark, d).filter(OK).select(fn.band(ratio, fn.RATIO_BANDS, "red").alias("ratio_band"), fn.band_down(speed, fn.SPEED_BANDS, "red").alias("speed_band"), (ratio < 0.8).alias("ok"))
    return df.groupBy("ratio_band", "speed_band", "ok").agg(F.count("*").alias("n"))


@query(f"{PER}, t as (select perm, round(unweighted, 2) u, row_number() over (order by round(unweighted, 4) desc, perm)::int line_no from per qualify line_no <= 10) select line_no, format('| {{}} | {{}} | {{:.2f}} |', line_no, perm, u) line from t")
def markdown_top10(spark, d) -> DataFrame:
    df = reports.per_config(runs(spark, d), ["perm"]).withColumn("key", r4("unweighted"))
    best = reports.top(df, F.col("key").desc(), "perm", 10).withColumn("shown", F.format_string("%.2f", F.round("unweighted", 2)))
    return reports.markdown(best, ["rank", "perm", "shown"], "rank")


@query(f", s as (select video, perm, comp_bytes, avg(comp_bytes) over w m, stddev_pop(comp_bytes) over w sd from runs where comp_bytes is not null window w as (partition by video)), h as (select video, perm, comp_bytes from s where comp_bytes > m + 2 * sd), l as (select video, list(comp_bytes order by comp_bytes desc, perm) all_, count(*)::int n from h group by video) select video, array_to_string(all_[:12], ', ') || case when n > 12 then ' (+' || (n - 12) || ' more)' else '' end shown, n from l")
def spike_report(spark, d) -> DataFrame:
    """The twelve largest spikes per video and how many more there are."""
    hit = windows.spikes_of_few(runs(spark, d).filter("comp_bytes is not null").select("video", "perm", "comp_bytes"), ["video"], "comp_bytes")
    w = Window.partitionBy("video").orderBy(F.col("comp_bytes").desc(), "perm")
    best = hit.withColumn("k", F.row_number().over(w)).filter("k <= 12")  # each task keeps its own twelve before they meet
    first = best.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "comp_bytes"))), lambda s: s["comp_bytes"].cast("string")).alias("first"))
    df = hit.groupBy("video").agg(F.count("*").cast("int").alias("n")).join(first, "video")
    more = F.when(F.col("n") > 12, F.concat(F.lit(" (+"), F.col("n") - 12, F.lit(" more)"))).otherwise("")
    return df.select("video", F.concat(F.array_join("first", ", "), more).alias("shown"), "n")


@query(f"{PER}, best as (select perm, orig, comp, unweighted from per) select perm::varchar \"Permutation\", printf('%.2f', round(unweighted, 2) + 0.0) \"Unweighted_Reduction_Percent\" from best")
def csv_columns(spark, d) -> DataFrame:
    df = reports.per_config(runs(spark, d), ["perm"])
    df = df.withColumn("perm", F.col("perm").cast("string")).withColumn("shown", F.format_string("%.2f", F.round("unweighted", 2) + F.lit(0.0)))
    return reports.pick(df, {"perm": "Permutation", "shown": "Unweighted_Reduction_Percent", "missing": "FPS"})


@query(", p as (select unnest(range(2048))::int perm), c as (select perm, count(*) n, count(comp_bytes) ok from runs group by perm) select p.perm, bit_count(p.perm)::int n_on, coalesce(n, 0)::bigint n_runs, coalesce(ok, 0)::bigint n_ok from p left join c on c.perm = p.perm")
def toggle_product(spark, d) -> DataFrame:
    """All combinations of the toggles, and how many runs the log has of each."""
    df = spark.range(1).select()
    for t in TOGGLES:
        df = df.withColumn(t, F.explode(F.array(F.lit(False), F.lit(True))))
    perm = sum((F.col(t).cast("int") * (1 << k) for k, t in enumerate(TOGGLES)), F.lit(0))
    counts = runs(spark, d).groupBy("perm").agg(F.count("*").alias("n"), F.count("comp_bytes").alias("ok"))
    df = df.select(perm.alias("perm"), sum((F.col(t).cast("int") for t in TOGGLES), F.lit(0)).alias("n_on")).join(counts, "perm", "left")
    return df.select("perm", "n_on", F.coalesce("n", F.lit(0)).alias("n_runs"), F.coalesce("ok", F.lit(0)).alias("n_ok"))
