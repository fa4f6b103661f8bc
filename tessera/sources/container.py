"""Frames as differences in Parquet, their reader, and folder scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames from one key frame to the next: the series that a reader folds.
GROUP = 64


def deltas(frames: DataFrame) -> DataFrame:
    """(video, part, frame, is_key, values) of frames (video, frame, px): a key frame's pixels each GROUP frames, else the change since the frame before."""
    w = Window.partitionBy("video").orderBy("frame")
    key = F.col("frame") % GROUP == 0
    change = F.zip_with("px", F.lag("px").over(w), lambda a, b: a - b)
    return frames.select("video", F.floor(F.col("frame") / GROUP).cast("int").alias("part"), "frame", key.alias("is_key"), F.when(key, F.col("px")).otherwise(change).alias("values"))


def restored(coded: DataFrame) -> DataFrame:
    """(video, frame, px) of deltas(): each part is folded on its own, from its key frame on."""
    series = coded.groupBy("video", "part").agg(F.array_sort(F.collect_list(F.struct("frame", "values"))).alias("series"))

    def step(a: Column, x: Column) -> Column:
        px = F.when(F.size(a["px"]) == 0, x["values"]).otherwise(F.zip_with(a["px"], x["values"], lambda p, v: p + v))
        now = F.array(F.struct(x["frame"].alias("frame"), px.alias("px")))
        return F.struct(px.alias("px"), F.concat(a["out"], now).alias("out"))

    kind = series.schema["series"].dataType.elementType
    frame, px = kind["frame"].dataType.simpleString(), kind["values"].dataType.simpleString()
    start = F.struct(F.array().cast(px).alias("px"), F.array().cast(f"array<struct<frame:{frame},px:{px}>>").alias("out"))
    return series.select("video", F.explode(F.aggregate("series", start, step)["out"]).alias("f")).select("video", "f.frame", "f.px")


def scan_folder(spark, path: str, suffix: str, without: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, length, content) of the files of a folder with a suffix, by path, but for those whose name matches a pattern.

    With recursive the folders in it count too, and the pattern is looked for in the path below the folder. Content that isn't asked for isn't read.
    """
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", recursive).load(path)
    if without:
        name = F.element_at(F.split("path", F.concat(F.lit("\\Q"), F.lit(path.rstrip("/").rsplit("/", 1)[-1]), F.lit("\\E/"))), -1) if recursive else F.element_at(F.split("path", "/"), -1)
        df = df.filter(~name.rlike(without))
    return df.select("path", "length", "content").orderBy("path")
