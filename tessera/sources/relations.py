"""The relations that the operators run on, derived from the given tables.

plane: one value per cell and day from events. blocks: small frames cut into square blocks of pixels from embeddings,
one video per label. runs: an experiment log from lineitem. Each has a twin in DuckDB SQL, used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..env import on_workers

#: Side of a frame and of a block in pixels.
SIDE, BLOCK = 8, 4
#: Ids that one group of videos spans.
SPAN = 512
TOGGLES = ("spatial", "skip", "search", "background", "solid", "dct4", "dct8", "cached", "palette", "faded", "dither")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, frame, v): v in 0..255. Sparse: a cell has no row for a day without events."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "value")
    cents = F.floor(F.col("value") * 100).cast("long")
    return e.groupBy(F.col("user_id").alias("cell"), (F.dayofmonth("ts") - 1).alias("frame")).agg((F.sum(cents) % 256).cast("int").alias("v"))


PLANE = """plane as (select user_id cell, cast(extract(day from ts) as int) - 1 frame,
  cast(sum(cast(floor(value * 100) as bigint)) % 256 as int) v from events group by all)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, frame, px): frames of SIDE x SIDE pixels in 0..255, row by row. Videos differ in contrast.

    A video is one label's vectors out of SPAN ids, so that videos grow in number with the table, not in length.
    """
    e = read(spark, sf_dir, "embeddings").withColumn("video", F.expr(f"cast(vec_id div {SPAN} as int)") * 10 + F.col("label"))
    e = e.withColumn("frame", F.row_number().over(Window.partitionBy("video").orderBy("vec_id")) - 1)
    gain = F.lit(8.0) * F.pow(F.lit(4.0), F.col("label") % 3)
    px = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.lit(128) + F.floor(x.cast("double") * gain).cast("int"))))
    return e.select("video", "frame", px.alias("px"))


FRAMES = f"""frames as (select cast(vec_id // {SPAN} as int) * 10 + label video, cast(row_number() over (partition by vec_id // {SPAN}, label order by vec_id) - 1 as int) frame,
  list_transform(embedding, lambda x: greatest(0, least(255, 128 + cast(floor(x::double * 8.0 * pow(4.0, label % 3)) as int)))) px from embeddings)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, frame, y, x, v), the frames in long form."""
    return frames(spark, sf_dir).select("video", "frame", F.posexplode("px").alias("i", "v")).select("video", "frame", F.expr(f"i div {SIDE}").alias("y"), (F.col("i") % SIDE).alias("x"), "v")


PIXELS = f"""{FRAMES}, flat as (select video, frame, unnest(px) v, generate_subscripts(px, 1) - 1 i from frames),
pixels as (select video, frame, cast(i // {SIDE} as int) y, cast(i % {SIDE} as int) x, v from flat)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, frame, by, bx, px, prev): blocks of BLOCK x BLOCK pixels and the same block one frame earlier.

    Blocks are cut before they are exploded, and pixels stay arrays, so that the only shuffle is the one that lag() needs.
    """
    n = SIDE // BLOCK
    grid = F.array(*[F.struct(F.lit(y).alias("by"), F.lit(x).alias("bx"), cut(F.col("px"), SIDE, F.lit(y * BLOCK), F.lit(x * BLOCK), BLOCK, BLOCK).alias("px")) for y in range(n) for x in range(n)])
    df = frames(spark, sf_dir).select("video", "frame", F.explode(grid).alias("g")).select("video", "frame", "g.*")
    return df.withColumn("prev", F.lag("px").over(Window.partitionBy("video", "by", "bx").orderBy("frame")))


BLOCKS = f"""{FRAMES}, cut as (select video, frame, cast(g.y as int) "by", cast(g.x as int) bx,
  list_transform(range({BLOCK * BLOCK}), lambda i: px[(g.y * {BLOCK} + i // {BLOCK}) * {SIDE} + g.x * {BLOCK} + i % {BLOCK} + 1]) px
  from frames, (select y, x from range({SIDE // BLOCK}) a(y), range({SIDE // BLOCK}) b(x)) g),
blocks as (select *, lag(px) over (partition by video, "by", bx order by frame) prev from cut)"""


#: Side of a scene's frames, by how many rows they scroll each frame, and columns at their left that stand still.
SCENE, SCROLL, STILL = 64, 4, 16


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, frame, px): frames of SCENE x SCENE pixels that scroll over a video's vectors, one vector a row of pixels.

    The first STILL columns show the first frame's for good, rows beyond the last vector are 0. A video has SPAN vectors, so that
    videos grow in number with the table.
    """
    e = read(spark, sf_dir, "embeddings").filter(F.size("embedding") == SCENE)
    gain = F.lit(8.0) * F.pow(F.lit(4.0), F.col("label") % 3)
    row = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.lit(128) + F.floor(x.cast("double") * gain).cast("int"))))
    held = e.groupBy(F.expr(f"cast(vec_id div {SPAN} as int)").alias("video")).agg(F.array_sort(F.collect_list(F.struct("vec_id", row.alias("row")))).alias("rows"))
    last = F.greatest(F.lit(0), F.ceil((F.size("rows") - SCENE) / SCROLL).cast("int"))
    line = lambda y: F.coalesce(F.get("rows", y)["row"], F.array_repeat(F.lit(0), SCENE))
    lines = lambda f: F.transform(F.sequence(F.lit(0), F.lit(SCENE - 1)), lambda y: F.concat(F.slice(line(y), 1, STILL), F.slice(line(y + SCROLL * f), STILL + 1, SCENE - STILL)))
    shown = F.transform(F.sequence(F.lit(0), last), lambda f: F.struct(f.alias("frame"), F.flatten(lines(f)).alias("px")))
    return held.select("video", F.explode(shown).alias("s")).select("video", "s.frame", "s.px")


_LINE = f"coalesce(r[{{}}], list_transform(range({SCENE}), lambda z: 0::int))"
SCENES = f"""lines as (select cast(vec_id // {SPAN} as int) video, list(list_transform(embedding, lambda x: greatest(0, least(255, 128 + cast(floor(x::double * 8.0 * pow(4.0, label % 3)) as int)))) order by vec_id) r, count(*) n
    from embeddings where len(embedding) = {SCENE} group by 1),
  shown as (select video, r, unnest(range(greatest(0, ceil((n - {SCENE}) / {SCROLL}.0)::int) + 1))::int frame from lines),
  scenes as (select video, frame, flatten(list_transform(range({SCENE}), lambda y: list_concat({_LINE.format("y + 1")}[:{STILL}], {_LINE.format(f"y + 1 + {SCROLL} * frame")}[{STILL + 1}:]))) px from shown),
  points as (select video, frame, cast(i // {SCENE} as int) y, cast(i % {SCENE} as int) x, v from (select video, frame, unnest(px) v, generate_subscripts(px, 1) - 1 i from scenes))"""


def cut(px: Column, side: int, top: Column, left: Column, height: int, width: int) -> Column:
    """The pixels of a box of a frame, row by row, as slices."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.slice(px, (top + r) * side + left + 1, width)))


def runs(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """(run_id, perm, config, video, orig_bytes, comp_bytes, time_s, frames): one row per run of a configuration on a video.

    config spells perm's bits as "+name" and "-name" tokens in the order of TOGGLES. comp_bytes is null for a failed run. Runs may
    share their run_id; placed adds place, where a run lies in the stored table, which is the order of such runs.
    """
    li = read(spark, sf_dir, "lineitem")
    perm = (F.col("l_partkey") % 2048).cast("int")
    tokens = [F.concat(F.when(perm.bitwiseAND(1 << k) > 0, "+").otherwise("-"), F.lit(t)) for k, t in enumerate(TOGGLES)]
    comp = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (F.col("l_quantity") / 25)).cast("long")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("run_id"),
        perm.alias("perm"),
        F.concat_ws(" ", *tokens).alias("config"),
        F.concat("l_returnflag", "l_linestatus").alias("video"),
        F.floor("l_extendedprice").cast("long").alias("orig_bytes"),
        F.when(F.col("l_suppkey") % 17 != 0, comp).alias("comp_bytes"),
        (F.round(F.col("l_tax") * 100).cast("int") / 4).cast("double").alias("time_s"),
        F.col("l_quantity").cast("int").alias("frames"),
        *([F.struct("_metadata.file_name", "_metadata.row_index").alias("place")] if placed else []),
    )


_TOKENS = " || ' ' || ".join(f"case when (l_partkey % 2048)::int & {1 << k} > 0 then '+' else '-' end || '{t}'" for k, t in enumerate(TOGGLES))
RUNS = f"""runs as (select l_orderkey * 8 + l_linenumber run_id, (l_partkey % 2048)::int perm, {_TOKENS} config, l_returnflag || l_linestatus video,
  floor(l_extendedprice)::bigint orig_bytes,
  case when l_suppkey % 17 <> 0 then floor(l_extendedprice * (1 - l_discount) * (l_quantity / 25))::bigint end comp_bytes,
  round(l_tax * 100)::int / 4 time_s, l_quantity::int frames from lineitem)"""
