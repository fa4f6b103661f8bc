"""Queries over blocks of frames, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import blocks as bl
from ..operators import folds, motion, tracking, windows
from ..sources.relations import BLOCK, BLOCKS, FRAMES, PIXELS, SIDE, blocks, frames, pixels

QUERIES, ORACLES = {}, {}
KEY = ["video", "frame", "by", "bx"]
K = 'video, frame, "by", bx'


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {sql}"
        return f

    return add


def _zip(a: str, b: str, e: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: {e.replace('A', 'z[1]').replace('B', 'z[2]')})"


def _sad(a: str, b: str) -> str:
    return f"list_sum({_zip(a, b, 'abs(A - B)')})::int"


STATS = f"""{BLOCKS}, stats as (select *, len(px) n, list_min(px) mn, list_max(px) mx, list_max(px) - list_min(px) rng,
  case when prev is not null then {_sad("px", "prev")} end sad, case when prev is not null then list_max({_zip("px", "prev", "abs(A - B)")})::int end largest from blocks)"""
SOLID = f"{STATS}, l as (select *, (list_sum(px) // n)::int level from stats), solid as (select *, list_sum(list_transform(px, lambda v: abs(v - level)))::int solid_sad from l)"
PALETTE = f"{SOLID}, c as (select *, list_sort(list_distinct(px)) colours from solid), pal as (select *, case when len(colours) <= 4 then list_transform(px, lambda v: list_position(colours, v) - 1) end indices from c)"
TWO = f"""{PALETTE}, t1 as (select *, (mn + mx) // 2 mid from pal),
  t2 as (select *, coalesce((list_sum(list_filter(px, lambda v: v <= mid)) // nullif(len(list_filter(px, lambda v: v <= mid)), 0))::int, 0) low,
    coalesce((list_sum(list_filter(px, lambda v: v > mid)) // nullif(len(list_filter(px, lambda v: v > mid)), 0))::int, 0) high from t1),
  t3 as (select *, list_transform(px, lambda v: abs(v - case when v > mid then high else low end)) te from t2),
  two as (select *, list_sum(te)::int two_sad, list_sum(list_transform(te, lambda e: e * e))::int two_ssd, list_max(te)::int two_max from t3)"""
DITHER = f"""{TWO}, d1 as (select *, list_transform(range(4), lambda i: (mn + i * rng // 3)::int) levels from two),
  d2 as (select *, list_transform(px, lambda v: list_position(list_transform(levels, lambda x: abs(v - x)), list_min(list_transform(levels, lambda x: abs(v - x)))) - 1) dither_codes from d1),
  dit as (select *, list_sum({_zip("px", "dither_codes", "abs(A - levels[B + 1])")})::int dither_sad from d2)"""
RES = f"""{DITHER}, r1 as (select *, case when prev is not null then {_zip("px", "prev", "round_even((A - B) / 27, 0)::int")} end q from dit),
  r2 as (select *, case when prev is not null then {_zip("prev", "q", "greatest(0, least(255, A + B * 27))")} end recon from r1),
  res as (select *, len(list_filter(q, lambda x: x <> 0)) nnz, case when prev is not null then {_sad("px", "recon")} end residual_sad,
    case when prev is not null then list_max({_zip("px", "recon", "abs(A - B)")})::int end residual_max from r2)"""
R = "0.012::double"
COSTS = f"""{RES}, costs as (select *, n + 1 + {R} * coalesce(sad, 0) c_raw,
  case when rng <= 2 and solid_sad <= n / 8 then 1.5::double when rng < 10 then 2 + {R} * solid_sad end c_solid, case when rng <= 2 and solid_sad <= n / 8 then 1 else 2 end b_solid,
  case when rng > 2 and len(colours) <= 4 then (1 + len(colours) + n / 4)::double end c_exact,
  case when len(colours) > 4 and rng > 15 and two_max < 8 and two_ssd < 16 * n then 3 + n / 4 + {R} * two_sad end c_two,
  case when rng > 20 then 5 + n / 4 + {R} * dither_sad end c_dither,
  case when prev is not null then case when nnz >= n / 2 then 12 else 1 + 2 * nnz end + {R} * residual_sad end c_res, case when nnz >= n / 2 then 12 else 1 + 2 * nnz end b_res from res)"""


def _step(n: int, gate: str, cost: str, size: str, mode: str, also: str = "true") -> str:
    won = f"b.cost > {gate} and {cost} < b.cost and {also}"
    return f"s{n} as (select *exclude (b), case when {won} then struct_pack(cost := {cost}, bytes := ({size})::int, mode := '{mode}') else b end b from s{n - 1})"


CASCADE = f"""{COSTS}, s0 as (select *, struct_pack(cost := c_raw, bytes := (n + 1)::int, mode := 'raw') b from costs),
  {_step(1, "0", "c_solid", "b_solid", "solid")}, {_step(2, "10", "c_exact", "1 + len(colours) + n / 4", "palette")}, {_step(3, "10", "c_two", "3 + n / 4", "palette")},
  {_step(4, "12", "c_dither", "5 + n / 4", "dither")}, {_step(5, "10", "c_res", "b_res", "residual", "not (b.mode = 'palette' and residual_max >= 8)")},
  best as (select {K}, case when largest < 4 then 'skip' else b.mode end mode, case when largest < 4 then 0 else b.bytes end bytes from s5)"""


@query(f'{STATS} select {K}, mn, mx, rng, coalesce(sad, -1) sad, coalesce(largest, -1) largest from stats')
def block_stats(spark, d) -> DataFrame:
    df = bl.stats(blocks(spark, d))
    return df.select(*KEY, "mn", "mx", "rng", F.coalesce("sad", F.lit(-1)).alias("sad"), F.coalesce("largest", F.lit(-1)).alias("largest"))


@query(f"{SOLID} select {K}, level, solid_sad from solid where rng < 10")
def solid_blocks(spark, d) -> DataFrame:
    return bl.solid(bl.stats(blocks(spark, d))).filter("rng < 10").select(*KEY, "level", "solid_sad")


@query(f"{PALETTE} select {K}, colours::varchar[] colours, indices::varchar[] indices from pal where len(colours) <= 4")
def exact_palette_blocks(spark, d) -> DataFrame:
    df = bl.palette(bl.stats(blocks(spark, d))).filter("indices is not null")
    return df.select(*KEY, F.col("colours").cast("array<string>").alias("colours"), F.col("indices").cast("array<string>").alias("indices"))


@query(f"{TWO} select {K}, low, high, two_sad, two_max from two where rng > 15")
def two_colour_blocks(spark, d) -> DataFrame:
    return bl.two_colours(bl.stats(blocks(spark, d))).filter("rng > 15").select(*KEY, "low", "high", "two_sad", "two_max")


@query(f"{DITHER} select {K}, array_to_string(dither_codes, ',') codes, dither_sad from dit where rng > 20")
def dither4_blocks(spark, d) -> DataFrame:
    return bl.dither(bl.stats(blocks(spark, d))).filter("rng > 20").select(*KEY, F.array_join("dither_codes", ",").alias("codes"), "dither_sad")


@query(f"{RES} select {K}, nnz, residual_sad, array_to_string(recon, ',') recon from res where prev is not null")
def residual_sparse(spark, d) -> DataFrame:
    df = bl.residual(bl.stats(blocks(spark, d)).filter("prev is not null"), 27)
    return df.select(*KEY, F.col("nnz").cast("long").alias("nnz"), "residual_sad", F.array_join("recon", ",").alias("recon"))


@query(f"{CASCADE} select video, frame, mode, count(*)::bigint n, sum(bytes)::bigint bytes from best group by video, frame, mode")
def block_mode_decision(spark, d) -> DataFrame:
    """Modes by the cascade over blocks of 16 pixels, predicted from the source: without background and motion candidates, and with
    gates for dithering and dense residuals that fit so small a block."""
    df = bl.cascade(bl.candidates(blocks(spark, d))).select("video", "frame", "best.mode", "best.bytes")
    return df.groupBy("video", "frame", "mode").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"))


@query(f"""{COSTS}, o as (select {K}, list_sort(list_filter([{{'c': c_raw, 'r': 0, 'm': 'raw'}}, {{'c': c_solid, 'r': 1, 'm': 'solid'}}, {{'c': c_exact, 'r': 2, 'm': 'palette'}}, {{'c': c_two, 'r': 3, 'm': 'palette'}},
  {{'c': c_dither, 'r': 4, 'm': 'dither'}}, {{'c': c_res, 'r': 5, 'm': 'residual'}}], lambda s: s.c is not null))[1].m mode from costs) select video, mode, count(*)::bigint n from o group by video, mode""")
def rd_optimal_modes(spark, d) -> DataFrame:
    return bl.rd_optimal(bl.candidates(blocks(spark, d))).groupBy("video", F.col("best.mode").alias("mode")).agg(F.count("*").alias("n"))


@query(f"{CASCADE}, m as (select mode, case when mode in ('residual', 'raw') then 'pixels' when mode = 'skip' then 'none' else 'levels' end family, count(*)::bigint n, sum(bytes)::bigint bytes from best group by mode) select family, mode, n, bytes, round(100.0::double * n / sum(n) over (), 6) share from m")
def mode_families(spark, d) -> DataFrame:
    df = bl.cascade(bl.candidates(blocks(spark, d))).groupBy(F.col("best.mode").alias("mode")).agg(F.count("*").alias("n"), F.sum("best.bytes").cast("long").alias("bytes"))
    family = F.when(F.col("mode").isin("residual", "raw"), "pixels").when(F.col("mode") == "skip", "none").otherwise("levels")
    total = df.agg(F.sum("n").alias("total"))
    return df.join(F.broadcast(total)).select(family.alias("family"), "mode", "n", "bytes", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share"))


SEARCH = f"""{PIXELS}, now as (select *, y // {BLOCK} "by", x // {BLOCK} bx, abs(v - lag(v) over (partition by video, y, x order by frame)) d from pixels),
  live as (select * from now where (video, frame, "by", bx) in (select (video, frame, "by", bx) from now group by all having sum(d) >= 1)),
  live2 as (select l.* from (select video, frame, "by", bx from now group by all having sum(d) >= 1) k join now l using (video, frame, "by", bx)),
  tried as (select l.*, dy, dx from live2 l, (select unnest(range(-2, 3)) dy) a, (select unnest(range(-2, 3)) dx) b where "by" * {BLOCK} - dy between 0 and {SIDE - BLOCK} and bx * {BLOCK} - dx between 0 and {SIDE - BLOCK}),
  scored as (select t.video, t.frame, t."by", t.bx, dy, dx, sum((t.v - p.v) * (t.v - p.v))::bigint ssd, sum(t.v)::bigint sn, sum(p.v)::bigint st from tried t join pixels p on p.video = t.video and p.frame = t.frame - 1 and p.y = t.y - dy and p.x = t.x - dx group by all),
  found as (select video, frame, "by", bx, min({{'ssd': ssd, 'dy': dy, 'dx': dx, 'sn': sn, 'st': st}}) b from scored group by all)"""
SEARCH = SEARCH.replace('  live as (select * from now where (video, frame, "by", bx) in (select (video, frame, "by", bx) from now group by all having sum(d) >= 1)),\n', "").replace("now group by all having", 'now group by video, frame, "by", bx having')


@query(f'{SEARCH} select {K.replace("frame", "frame")}, b.dy::int dy, b.dx::int dx, b.ssd ssd from found')
def motion_search_argmin(spark, d) -> DataFrame:
    return motion.search(frames(spark, d), BLOCK, 2, SIDE).select(*KEY, "dy", "dx", "ssd")


@query(f'{SEARCH}, f as (select {K}, b.dy::int dy, b.dx::int dx, trunc(b.sn / 16.0::double - b.st / 16.0::double)::int shift from found) select * from f where abs(shift) <= 24')
def faded_motion(spark, d) -> DataFrame:
    return motion.shifts(motion.search(frames(spark, d), BLOCK, 2, SIDE), BLOCK * BLOCK).select(*KEY, "dy", "dx", "shift")


@query(f"{PIXELS} select video, frame, min(x) x0, max(x) x1, min(y) y0, max(y) y1, count(*)::bigint area, round(sum(x)::double / count(*), 6) cx, round(sum(y)::double / count(*), 6) cy from pixels where v > 140 group by video, frame")
def mask_bbox_centroid(spark, d) -> DataFrame:
    return tracking.boxes(pixels(spark, d).filter("v > 140"), ["video", "frame"])


@query(f"{PIXELS} select video, frame, round(avg(v) filter (y in (0, {SIDE - 1}) and x in (0, {SIDE - 1})), 6) background, sum(greatest(0, v - 175))::bigint specular, sum(least(v, 175))::bigint base, bool_and(greatest(0, least(255, least(v, 175) + greatest(0, v - 175))) = v) exact from pixels group by video, frame")
def layer_decompose(spark, d) -> DataFrame:
    corner = F.col("y").isin(0, SIDE - 1) & F.col("x").isin(0, SIDE - 1)
    over, base = F.greatest(F.lit(0), F.col("v") - 175), F.least("v", F.lit(175))
    return pixels(spark, d).groupBy("video", "frame").agg(
        F.round(F.avg(F.when(corner, F.col("v"))), 6).alias("background"),
        F.sum(over).cast("long").alias("specular"),
        F.sum(base).cast("long").alias("base"),
        F.bool_and(fn.clamp(base + over, 0, 255) == F.col("v")).alias("exact"),
    )


def _slope(g: dict[int, int]) -> str:
    return "abs(" + (" + ".join(f"{w} * px[{at + 1}]" for at, w in g.items()) or "0") + ")"


TAGS = f"""{BLOCKS}, e as (select {K}, ({" + ".join(f"{_slope(gx)} + {_slope(gy)}" for gx, gy in tracking.sobel_terms(BLOCK))})::double / {BLOCK * BLOCK} edge,
    case when prev is null then [0] else {_zip("px", "prev", "abs(A - B)")} end moved from blocks),
  f as (select {K}, edge, list_avg(moved) motion, round(list_aggregate(moved, 'var_pop'), 6) spread from e),
  tags as (select *, case when edge > 40 then 'EDGE' when spread > 1.5 then 'CHAOS' when motion > 0.5 then 'MOTION' else 'FLAT' end tag from f)"""


@query(f"{TAGS} select * from tags")
def sobel_tag(spark, d) -> DataFrame:
    return tracking.block_tags(blocks(spark, d), BLOCK)


@query(f"{TAGS} select case when grouping(video) = 1 then 'corpus' else video::varchar end video, tag, count(*)::bigint n, sum({BLOCK * BLOCK})::bigint area from tags group by grouping sets ((video, tag), (tag))")
def tag_area_rollup(spark, d) -> DataFrame:
    tags = tracking.block_tags(blocks(spark, d), BLOCK)
    df = tags.groupingSets([["video", "tag"], ["tag"]], "video", "tag").agg(F.count("*").alias("n"), F.sum(F.lit(BLOCK * BLOCK)).cast("long").alias("area"), F.grouping("video").alias("g"))
    return df.select(F.when(F.col("g") == 1, "corpus").otherwise(F.col("video").cast("string")).alias("video"), "tag", "n", "area")


@query(f"""{PIXELS}, basis as (select k, i, case when k = 0 then sqrt(1.0::double / {SIDE}) else sqrt(2.0::double / {SIDE}) end * cos(pi() * (2 * i + 1) * k / {2 * SIDE}) c from (select unnest(range(4)) k) a, (select unnest(range({SIDE})) i) b)
  select p.video, p.frame, r.k ky, s.k kx, round(sum(r.c * s.c * p.v), 3) + 0.0 coefficient from pixels p join basis r on r.i = p.y join basis s on s.i = p.x group by all""")
def dct_lowpass(spark, d) -> DataFrame:
    return tracking.dct(frames(spark, d), SIDE, 4)


@query(f"""{PIXELS}, recursive_seed as (select video, frame, y * {SIDE} + x id, y, x from pixels where v > 150), reach as (select 1)
  select 1""".replace(", recursive_seed", ", m").replace(", reach as (select 1)\n  select 1", "") + f""" select * from (
  with recursive r(video, frame, id, root) as (select video, frame, id, id from m union select b.video, b.frame, b.id, r.root from r join m a on a.video = r.video and a.frame = r.frame and a.id = r.id
    join m b on b.video = a.video and b.frame = a.frame and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 where b.id > r.root)
  select video, frame, component, count(*)::bigint area from (select video, frame, id, min(root)::int component from r group by all) group by all) where area >= 4""")
def connected_components(spark, d) -> DataFrame:
    return tracking.components(pixels(spark, d).filter("v > 150"), SIDE, least=4)


HASHES = f"""{FRAMES}, pooled as (select video, frame, list_transform(range(16), lambda i: px[(i // 4) * 16 + i % 4 * 2 + 1] + px[(i // 4) * 16 + i % 4 * 2 + 2] + px[(i // 4) * 16 + i % 4 * 2 + 9] + px[(i // 4) * 16 + i % 4 * 2 + 10]) s from frames),
h as (select video, frame, list_sum(list_transform(range(12), lambda i: case when s[(i // 3) * 4 + i % 3 + 2] > s[(i // 3) * 4 + i % 3 + 1] then (1::bigint << i) else 0 end))::bigint hash from pooled)"""


@query(f"{HASHES}, r as (select a.video, a.frame, b.frame then_frame, row_number() over (partition by a.video, a.frame order by b.frame desc) k from h a join h b on a.video = b.video and a.hash = b.hash and b.frame < a.frame) select video, frame, then_frame, k::int k from r where k <= 8")
def dhash_join(spark, d) -> DataFrame:
    return tracking.hash_matches(frames(spark, d), SIDE, keep=8)


@query(f"{DITHER} select {K}, array_to_string(list_transform(range(4), lambda i: dither_codes[4 * i + 1] * 64 + dither_codes[4 * i + 2] * 16 + dither_codes[4 * i + 3] * 4 + dither_codes[4 * i + 4]), ',') packed, array_to_string(dither_codes, ',') unpacked from dit")
def bitpack_2bit(spark, d) -> DataFrame:
    df = bl.dither(bl.stats(blocks(spark, d))).withColumn("packed", fn.pack2(F.col("dither_codes")))
    return df.select(*KEY, F.array_join("packed", ",").alias("packed"), F.array_join(fn.unpack2(F.col("packed")), ",").alias("unpacked"))


@query(f"{FRAMES}, p as (select video, frame, lag(px) over (partition by video order by frame) prev, px from frames) select video, frame, (list_sum({_zip('px', 'prev', 'case when (A > 128) <> (B > 128) then 1 else 0 end')}))::bigint n_changed, (list_sum({_zip('px', 'prev', 'case when A > 128 or B > 128 then 1 else 0 end')}))::bigint n_either from p where prev is not null")
def mask_xor(spark, d) -> DataFrame:
    return tracking.mask_changes(frames(spark, d), 128)


@query(f"{FRAMES}, p as (select video, frame, lag(px) over (partition by video order by frame) prev, px from frames) select video, frame, round(list_sum({_zip('px', 'prev', '(A - B) * (A - B)')})::double / len(px), 6) mse from p where prev is not null")
def pairwise_mse(spark, d) -> DataFrame:
    return tracking.step_mse(frames(spark, d))


@query(f"{BLOCKS}, code as (select px book, row_number() over (order by video, \"by\", bx) - 1 i from blocks where frame = 0 and bx = 0 and \"by\" = 0 and video < 10), s as (select video, frame, \"by\", bx, min({{'d': list_sum({_zip('px', 'book', '(A - B) * (A - B)')})::bigint, 'i': i}}) m from blocks, code group by all) select {K}, m.d distance, m.i::int entry from s")
def codebook_argmin(spark, d) -> DataFrame:
    b = blocks(spark, d)
    return tracking.nearest_entry(b, b.filter("frame = 0 and by = 0 and bx = 0 and video < 10"))


@query(f"""{PIXELS}, b as (select video, frame, min(x) bx, min(y) "by", max(x) - min(x) + 1 w, max(y) - min(y) + 1 h from pixels where v > 140 group by video, frame)
  select n.video, n.frame, greatest(0, least(n.bx + n.w, p.bx + p.w) - greatest(n.bx, p.bx)) * greatest(0, least(n."by" + n.h, p."by" + p.h) - greatest(n."by", p."by")) inter,
  round((greatest(0, least(n.bx + n.w, p.bx + p.w) - greatest(n.bx, p.bx)) * greatest(0, least(n."by" + n.h, p."by" + p.h) - greatest(n."by", p."by")))::double
    / (n.w * n.h + p.w * p.h - greatest(0, least(n.bx + n.w, p.bx + p.w) - greatest(n.bx, p.bx)) * greatest(0, least(n."by" + n.h, p."by" + p.h) - greatest(n."by", p."by"))), 6) iou
  from b n join b p on n.video = p.video and n.frame = p.frame + 1""")
def iou_pairs(spark, d) -> DataFrame:
    return tracking.box_overlap(tracking.boxes(pixels(spark, d).filter("v > 140"), ["video", "frame"]))


@query(None)
def greedy_match(spark, d) -> DataFrame:
    return tracking.greedy_matches(tracking.blobs(pixels(spark, d).filter("v > 150"), SIDE), within=5.0)


@query(None)
def object_events(spark, d) -> DataFrame:
    return tracking.events(tracking.blobs(pixels(spark, d).filter("v > 150"), SIDE), within=5.0, patience=2)


@query(None)
def event_counts(spark, d) -> DataFrame:
    log = tracking.events(tracking.blobs(pixels(spark, d).filter("v > 150"), SIDE), within=5.0, patience=2)
    size = F.when(F.col("type") == "SPAWN", 15).when(F.col("type") == "DESPAWN", 1).otherwise(3)
    return log.groupBy("video", "type").agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("payload"))


@query(None)
def closed_loop_coding(spark, d) -> DataFrame:
    """Blocks, bytes and squared error per video and mode where each block is predicted from what the decoder has."""
    coded = folds.closed_loop(frames(spark, d), SIDE, BLOCK)
    return coded.groupBy("video", "mode").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"), F.sum("sse").cast("long").alias("sse"))


@query(f"{BLOCKS}, book as (select video, px book, row_number() over (partition by video order by \"by\", bx) - 1 i from blocks where frame = 0), s as (select b.video, frame, \"by\", bx, min(i) entry from blocks b join book k on b.video = k.video and frame > 0 and list_sum({_zip('px', 'book', '(A - B) * (A - B)')}) < 400 * len(px) group by all) select {K}, entry::int entry from s")
def first_match_in_cache(spark, d) -> DataFrame:
    return tracking.first_match(blocks(spark, d), 400)


@query(f"{FRAMES}, p as (select video, frame, px, lag(px) over (partition by video order by frame) prev from frames), z as (select video, frame, list_transform(range(64), lambda i: prev[((i // 8) * 4 // 5) * 8 + (i % 8) * 4 // 5 + 1]) scaled, px from p where prev is not null) select video, frame, round(list_sum({_zip('px', 'scaled', '(A - B) * (A - B)')})::double / 64, 6) mse from z")
def affine_scale(spark, d) -> DataFrame:
    return tracking.scaled_mse(frames(spark, d), SIDE, 4, 5)


@query(f"{BLOCKS}, c as (select {K}, list_transform(px, lambda v: greatest(0, least(15, (v - 8 + 8) // 17 + case when (v % 17) * 2 > 17 then 1 else 0 end))) codes, px from blocks) select {K}, array_to_string(list_transform(range(8), lambda i: codes[2 * i + 1] * 16 + codes[2 * i + 2]), ',') packed, list_sum({_zip('px', 'codes', 'abs(A - 17 * B)')})::int sad from c")
def palette16_blocks(spark, d) -> DataFrame:
    return tracking.levels16(blocks(spark, d))


@query(f"""{PIXELS}, frag as (select video, frame, y // {BLOCK} "by", x // {BLOCK} bx, (min(x) + max(x)) / 2.0::double cx, (min(y) + max(y)) / 2.0::double cy from pixels where v > 150 group by all),
  grp as (select video, frame, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from pixels where v > 170 group by video, frame)
  select f.video, f.frame, count(*)::bigint n_fragments, sum((cx between x0 and x1 and cy between y0 and y1)::int)::bigint n_inside from frag f join grp g on f.video = g.video and f.frame = g.frame group by f.video, f.frame""")
def containment_join(spark, d) -> DataFrame:
    px = pixels(spark, d)
    block = [F.floor(F.col(c) / BLOCK).alias(f"b{c}") for c in "yx"]
    frag = px.filter("v > 150").groupBy("video", "frame", *block).agg(((F.min("x") + F.max("x")) / 2).alias("px"), ((F.min("y") + F.max("y")) / 2).alias("py"))
    group = tracking.boxes(px.filter("v > 170"), ["video", "frame"])
    inside = F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1"))
    return frag.join(group, ["video", "frame"]).groupBy("video", "frame").agg(F.count("*").alias("n_fragments"), F.sum(inside.cast("long")).alias("n_inside"))


@query(f"""{STATS}, a as (select video, frame, "by", bx, sum((largest > 40)::int) over (partition by video, "by", bx order by frame rows between 9 preceding and current row) act from stats where prev is not null)
  select l.video, l.frame, count(*)::bigint n_edges, sum((l.act = r.act and l.act > 3)::int)::bigint n_joined from a l join a r on l.video = r.video and l.frame = r.frame and (l."by" = r."by" and r.bx = l.bx + 1 or l.bx = r.bx and r."by" = l."by" + 1) group by l.video, l.frame""")
def adjacent_activity(spark, d) -> DataFrame:
    df = bl.stats(blocks(spark, d)).filter("prev is not null")
    return tracking.grid_edges(windows.active_in_ring(df, ["video", "by", "bx"], "frame", F.col("largest") > 40))


@query(None)
def four_means_blocks(spark, d) -> DataFrame:
    return tracking.four_means(blocks(spark, d))


@query(f"""{SEARCH}, m as (select video, b.ssd::bigint ssd, b.ssd < 960 ok from found) select video, count(*)::bigint n_searched, sum(ok::int)::bigint n_accepted, (count(*) - sum(ok::int))::bigint n_rejected, round(coalesce(sum(ssd) filter (ok), 0) / 16.0::double, 4) sum_mse, sum(case when ok then {BLOCK * BLOCK} - 4 else 0 end)::bigint bytes_saved from m group by video""")
def motion_telemetry(spark, d) -> DataFrame:
    found = motion.search(frames(spark, d), BLOCK, 2, SIDE).withColumn("ok", F.col("ssd") < 60 * BLOCK * BLOCK)
    n = F.sum(F.col("ok").cast("long"))
    return found.groupBy("video").agg(
        F.count("*").alias("n_searched"), n.alias("n_accepted"), (F.count("*") - n).alias("n_rejected"),
        F.round(F.coalesce(F.sum(F.when(F.col("ok"), F.col("ssd"))), F.lit(0)) / 16.0, 4).alias("sum_mse"),
        F.sum(F.when(F.col("ok"), BLOCK * BLOCK - 4).otherwise(0)).cast("long").alias("bytes_saved"),
    )


#: Frames as triples of red, green and blue, row by row; what the last one lacks is 0.
TRIPLES = (SIDE * SIDE + 2) // 3
RGB = f"{FRAMES}, rgb as (select video, frame, list_transform(range({TRIPLES}), lambda i: {{'r': coalesce(px[3 * i + 1], 0), 'g': coalesce(px[3 * i + 2], 0), 'b': coalesce(px[3 * i + 3], 0)}}) c from frames), luma as (select video, frame, c, list_transform(c, lambda x: (299 * x.r + 587 * x.g + 114 * x.b + 500) // 1000) y from rgb)"


def _luma(spark, d) -> DataFrame:
    at = lambda i, k: F.coalesce(F.get("px", 3 * i + k), F.lit(0))
    c = F.transform(F.sequence(F.lit(0), F.lit(TRIPLES - 1)), lambda i: F.struct(at(i, 0).alias("r"), at(i, 1).alias("g"), at(i, 2).alias("b")))
    df = frames(spark, d).select("video", "frame", c.alias("c"))
    return df.withColumn("y", F.transform("c", lambda x: fn.gray(x["r"], x["g"], x["b"])))


@query(f"{RGB} select video, frame, list_sum(y)::bigint luma from luma")
def gray_levels(spark, d) -> DataFrame:
    """Sum of the luma of a frame whose pixels are read as triples of red, green and blue."""
    return _luma(spark, d).select("video", "frame", fn.array_sum(F.col("y")).cast("long").alias("luma"))


def _part(e: str, k: int) -> str:
    return f"floor(({e}) * {k} / 1000.0::double)::int"


@query(f"""{RGB}, p as (select *, lag(y) over (partition by video order by frame) w from luma), z as (select video, frame, list_zip(c, y, w) t from p where w is not null),
  k as (select video, frame, list_transform(t, lambda x: {{'y': x[3], 'cr': {_part("x[1].r - x[2]", 713)}, 'cb': {_part("x[1].b - x[2]", 564)}}}) t from z)
  select video, frame, list_sum(list_transform(t, lambda x: greatest(0, least(255, x.y + {_part("x.cr", 1403)}))))::bigint red,
  list_sum(list_transform(t, lambda x: greatest(0, least(255, x.y - floor((x.cr * 714 + x.cb * 344) / 1000.0::double)::int))))::bigint green,
  list_sum(list_transform(t, lambda x: greatest(0, least(255, x.y + {_part("x.cb", 1773)}))))::bigint blue from k""")
def luma_swap(spark, d) -> DataFrame:
    """A frame's red and blue differences under the luma of the frame before, back in colours; their sums."""
    part = lambda e, k: F.floor(e * k / 1000).cast("int")
    df = _luma(spark, d).withColumn("w", F.lag("y").over(windows.ordered(["video"], "frame"))).filter("w is not null")
    triples = F.arrays_zip(F.col("c").alias("c"), F.col("y").alias("y"), F.col("w").alias("w"))
    t = F.transform(triples, lambda x: F.struct(x["w"].alias("y"), part(x["c"]["r"] - x["y"], 713).alias("cr"), part(x["c"]["b"] - x["y"], 564).alias("cb")))
    df = df.withColumn("t", t)
    total = lambda f: fn.array_sum(F.transform("t", lambda x: fn.clamp(f(x), 0, 255))).cast("long")
    return df.select(
        "video", "frame", total(lambda x: x["y"] + part(x["cr"], 1403)).alias("red"),
        total(lambda x: x["y"] - F.floor((x["cr"] * 714 + x["cb"] * 344) / 1000).cast("int")).alias("green"), total(lambda x: x["y"] + part(x["cb"], 1773)).alias("blue"),
    )


@query(f"{BLOCKS}, e as (select {K}, list_count(list_filter({_zip('px', 'prev', 'A - B')}, lambda x: x > 0))::int n_up, case when list_distinct(px) = [] then 0 else len(list_distinct(px)) end::int n_colours, round(list_aggregate(px, 'var_pop'), 4) spread from blocks where prev is not null) select *, spread > 12 and n_colours > 4 textured from e")
def block_texture(spark, d) -> DataFrame:
    n = F.size("px")
    mean = fn.array_sum(F.col("px")) / n
    spread = F.aggregate(F.transform("px", lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v) / n
    df = blocks(spark, d).filter("prev is not null")
    up = F.size(F.filter(F.zip_with("px", "prev", lambda a, b: a - b), lambda x: x > 0))
    df = df.select(*KEY, up.alias("n_up"), F.size(F.array_distinct("px")).alias("n_colours"), F.round(spread, 4).alias("spread"))
    return df.withColumn("textured", (F.col("spread") > 12) & (F.col("n_colours") > 4))


@query(None)
def object_lifetimes(spark, d) -> DataFrame:
    """Per object: frames from its first event to its last, moves, and the share of a payload of 15 bytes a frame that its events save."""
    log = object_events(spark, d)
    size = F.when(F.col("type") == "SPAWN", 15).when(F.col("type") == "DESPAWN", 1).otherwise(3)
    df = log.groupBy("video", "obj_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.sum((F.col("type") == "MOVE").cast("long")).alias("moves"), F.sum(size).cast("long").alias("payload"))
    alive = F.col("last") - F.col("first") + 1
    return df.withColumn("frames_alive", alive).withColumn("saved_percent", F.round(100 - 100.0 * F.col("payload") / (15 * alive), 4))


@query(f"""{FRAMES}, p as (select video, frame, px, lag(px) over (partition by video order by frame) prev from frames), w as (select video, frame, k, unnest(px) a, unnest(prev) b, generate_subscripts(px, 1) - 1 i from p, range(4) t(k) where prev is not null),
  s as (select video, frame, k, avg(a) ma, avg(b) mb, (sum(a * a) - 49 * avg(a) * avg(a)) / 48 va, (sum(b * b) - 49 * avg(b) * avg(b)) / 48 vb, (sum(a * b) - 49 * avg(a) * avg(b)) / 48 vab from w where i // 8 between k // 2 and k // 2 + 6 and i % 8 between k % 2 and k % 2 + 6 group by all)
  select video, frame, round(avg((2 * ma * mb + 6.5025::double) * (2 * vab + 58.5225::double) / ((ma * ma + mb * mb + 6.5025::double) * (va + vb + 58.5225::double))), 5) ssim from s group by video, frame""")
def ssim_mean(spark, d) -> DataFrame:
    return tracking.ssim(frames(spark, d), SIDE)


SAME = f"""{CASCADE}, g as (select video, frame, max(case when "by" = 0 and bx = 0 then mode end) a, max(case when "by" = 0 and bx = 1 then mode end) b, max(case when "by" = 1 and bx = 0 then mode end) c, max(case when "by" = 1 and bx = 1 then mode end) d from best group by video, frame)"""


@query(f"{SAME} select video, frame, case when a = b and a = c and a = d then 1 when a = b then case when c = d then 2 else 3 end when a = c then case when b = d then 2 else 3 end when b = d then 3 else 3 + case when c = d then 0 else 1 end end::bigint n_boxes from g")
def dynamic_boxes(spark, d) -> DataFrame:
    """Boxes per frame of the two by two grid of modes."""
    modes = bl.cascade(bl.candidates(blocks(spark, d))).select(*KEY, F.col("best.mode").alias("mode"))
    n = SIDE // BLOCK
    return folds.dynamic_boxes(modes, n, n).groupBy("video", "frame").agg(F.count("*").alias("n_boxes"))


@query(f"""{PIXELS}, tried as (select p.video, p.frame, p.y // {BLOCK} "by", p.x // {BLOCK} bx, dy, dx, p.v a, q.v b from pixels p, (select unnest(range(-2, 3)) dy) s, (select unnest(range(-2, 3)) dx) t, pixels q
    where q.video = p.video and q.frame = p.frame - 1 and q.y = p.y - dy and q.x = p.x - dx and (p.y // {BLOCK}) * {BLOCK} - dy between 0 and {SIDE - BLOCK} and (p.x // {BLOCK}) * {BLOCK} - dx between 0 and {SIDE - BLOCK}),
  s as (select video, frame, "by", bx, dy, dx, sum(a) sa, sum(b) sb, sum(a * a) saa, sum(b * b) sbb, sum(a * b) sab, sum((a - b) * (a - b))::bigint ssd from tried group by all),
  live as (select video, frame, "by", bx from s where dy = 0 and dx = 0 and ssd > 0),
  r as (select *, case when {BLOCK * BLOCK} * saa > sa * sa and {BLOCK * BLOCK} * sbb > sb * sb then round(({BLOCK * BLOCK} * sab - sa * sb)::double / sqrt(({BLOCK * BLOCK} * saa - sa * sa)::double * ({BLOCK * BLOCK} * sbb - sb * sb)::double), 6) end r from s),
  best as (select video, frame, "by", bx, min({{'less': -r, 'dy': dy, 'dx': dx, 'ssd': ssd}}) m from r join live using (video, frame, "by", bx) where r is not null group by all)
  select {K}, m.dy::int dy, m.dx::int dx, 0.0 - m.less correlation, m.ssd ssd, 0.0 - m.less > 0.98 and m.ssd < 50 * {BLOCK * BLOCK} accepted from best""")
def motion_correlation(spark, d) -> DataFrame:
    """The offset of the largest normalised correlation, taken where that is above 0.98 and the mean squared error below 50."""
    found = motion.correlated(frames(spark, d), BLOCK, 2, SIDE)
    return found.withColumn("ssd", F.col("ssd").cast("long")).withColumn("accepted", (F.col("correlation") > 0.98) & (F.col("ssd") < 50 * BLOCK * BLOCK))


@query(f"""{SEARCH}, m as (select video, frame, sum(sqrt((b.dy * b.dy + b.dx * b.dx)::double)) / 4 mean_motion, sum(b.dy * b.dy + b.dx * b.dx) / 4.0::double squares from found group by video, frame)
  select video, frame, round(mean_motion, 6) mean_motion, round(squares - mean_motion * mean_motion, 6) motion_var, squares - mean_motion * mean_motion > 1 and mean_motion > 0.5 chaos from m""")
def chaos_frames(spark, d) -> DataFrame:
    """Frames whose motion vectors are long and unlike: mean and variance of their lengths over all blocks, still ones too."""
    n = (SIDE // BLOCK) ** 2
    square = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    df = motion.search(frames(spark, d), BLOCK, 2, SIDE).groupBy("video", "frame").agg((F.sum(F.sqrt(square.cast("double"))) / n).alias("m"), (F.sum(square) / n).alias("s"))
    var = F.col("s") - F.col("m") * F.col("m")
    return df.select("video", "frame", F.round("m", 6).alias("mean_motion"), F.round(var, 6).alias("motion_var"), ((var > 1) & (F.col("m") > 0.5)).alias("chaos"))


@query(f"""{RES}, d as (select *, lag(coalesce(recon, px)) over (partition by video, "by", bx order by frame) decoded from res),
  e as (select video, n, sad, largest, case when decoded is not null then list_max({_zip('px', 'decoded', 'abs(A - B)')})::int end far, case when prev is not null then list_sum({_zip('px', 'prev', '(A - B) * (A - B)')}) end se from d)
  select video, count(*)::bigint n, sum(coalesce(far < 4 or largest < 3 and 2 * sad < n and far < 8, false)::int)::bigint n_skip, sum(coalesce(sad < 2 * n, false)::int)::bigint n_by_sad, sum(coalesce(se < 2 * n, false)::int)::bigint n_by_mse from e group by video""")
def skip_predicates(spark, d) -> DataFrame:
    """Blocks that each of the skip rules lets pass, per video."""
    df = bl.skip_predicates(blocks(spark, d))
    n = lambda c: F.sum(F.col(c).cast("long"))
    return df.groupBy("video").agg(F.count("*").alias("n"), n("may_skip").alias("n_skip"), n("skip_by_sad").alias("n_by_sad"), n("skip_by_mse").alias("n_by_mse"))


@query(f"{FRAMES}, m as (select video, frame, array_to_string(list_transform(px, lambda v: (v > 128)::int), '') mask from frames), s as (select *, min(frame) over (partition by video, mask) first from m) select video, frame, (dense_rank() over (partition by video order by first) - 1)::int state, frame = first is_new from s")
def state_interning(spark, d) -> DataFrame:
    return tracking.interned_states(frames(spark, d), 128)


@query(f"""{PIXELS}, b as (select video, frame, min(x) x0, min(y) y0, max(x) - min(x) + 1 w, max(y) - min(y) + 1 h, round(sum(x)::double / count(*), 6) cx, round(sum(y)::double / count(*), 6) cy from pixels where v > 140 group by video, frame),
  p as (select *, list({{'x': x0, 'y': y0, 'w': w, 'h': h}}) over o past, round(max(cx) over o - min(cx) over o, 6) dx, round(max(cy) over o - min(cy) over o, 6) dy from b window o as (partition by video order by frame rows between 4 preceding and current row)),
  s as (select video, frame, dx, dy, round(list_sum(list_transform(past[:4], lambda q: (greatest(0, least(q.x + q.w, x0 + w) - greatest(q.x, x0)) * greatest(0, least(q.y + q.h, y0 + h) - greatest(q.y, y0)))::double
    / (q.w * q.h + w * h - greatest(0, least(q.x + q.w, x0 + w) - greatest(q.x, x0)) * greatest(0, least(q.y + q.h, y0 + h) - greatest(q.y, y0))))) / 4, 6) score from p where len(past) = 5)
  select video, frame, score, dx, dy, score > 0.85 or dx <= 2 and dy <= 2 locked from s""")
def box_coherence(spark, d) -> DataFrame:
    return tracking.coherence(tracking.boxes(pixels(spark, d).filter("v > 140"), ["video", "frame"]))


@query(f"""{PIXELS}, l as (select video, frame, y // 2 "by", x // 2 bx, abs(v - lag(v) over (partition by video, y, x order by frame)) d from pixels), m as (select video, frame, "by", bx, "by" * 4 + bx id from l group by video, frame, "by", bx having sum(d) >= 60),
  c as (select * from (with recursive r(video, frame, id, root) as (select video, frame, id, id from m union select b.video, b.frame, b.id, r.root from r join m a on a.video = r.video and a.frame = r.frame and a.id = r.id
    join m b on b.video = a.video and b.frame = a.frame and abs(a."by" - b."by") <= 1 and abs(a.bx - b.bx) <= 1 where b.id > r.root) select video, frame, id, min(root) root from r group by all)),
  n as (select video, frame, root, count(*) area from c group by all having count(*) >= 4)
  select video, frame, count(*)::bigint n_regions, max(area)::bigint largest from n group by video, frame""")
def block_regions(spark, d) -> DataFrame:
    """Regions of at least four blocks of 2 x 2 pixels that changed, per frame, and the largest."""
    n = SIDE // 2
    change = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda b: sum((F.abs(F.get("px", F.floor(b / n).cast("int") * 2 * SIDE + b % n * 2 + at) - F.get("prev", F.floor(b / n).cast("int") * 2 * SIDE + b % n * 2 + at)) for at in (0, 1, SIDE, SIDE + 1)), F.lit(0)))
    df = tracking.with_previous(frames(spark, d)).select("video", "frame", F.posexplode(change).alias("b", "sad")).filter("sad >= 60")
    found = tracking.components(df.select("video", "frame", F.floor(F.col("b") / n).cast("int").alias("y"), (F.col("b") % n).alias("x")), n, least=4)
    return found.groupBy("video", "frame").agg(F.count("*").alias("n_regions"), F.max("area").alias("largest"))


@query(f'{FRAMES} select video, count(*)::bigint n_frames, max(side) height, max(side) width, 30 fps, round(count(*) / 30.0::double, 4) "seconds" from (select video, sqrt(len(px))::int side from frames) group by video')
def video_metadata(spark, d) -> DataFrame:
    """Frames, size, rate and length of each video."""
    side = F.max(F.sqrt(F.size("px")).cast("int"))
    return frames(spark, d).groupBy("video").agg(F.count("*").alias("n_frames"), side.alias("height"), side.alias("width")).select("*", F.lit(30).alias("fps"), F.round(F.col("n_frames") / 30, 4).alias("seconds"))
