"""Helpers shared by the operators: the shared scratch folder, Arrow row access, unclashing names."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..env import on_workers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new path under the shared folder in spark.checkpoint.dir; a temporary folder where that is unset and all runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, which cuts its lineage: a lost executor costs a re-read."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly where it comes in fewer partitions than there are cores: a small table in one file.

    Meant for scans, whose partitions are known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> None:
    """Spark drops the files of finished shuffles when the driver collects the objects that stand for them: ask for that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that df doesn't use, for helper columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        n = name
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once: an expression inside a lambda is otherwise worked out for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def texts(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> Iterator[str]:
    """The texts of a column one by one; null is empty, and what isn't UTF-8 becomes U+FFFD."""
    for x in column.cast(pa.binary()):
        yield (x.as_py() or b"").decode("utf-8", "replace")


def per_row(df: DataFrame, keep: list[str], text: str, schema: str, make: Callable[[list[bytes]], dict[str, pa.Array]]) -> DataFrame:
    """The kept columns and those that make() gives for each batch of texts. Row by row: no shuffle, memory of one Arrow batch."""
    names = [x.split(" ")[0] for x in schema.split(", ")]
    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(texts(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(made[n] for n in names)], names=[*keep, *names])

    rows = spread(df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text}`"].cast("string").alias(fresh(df, "text_in")[0])))
    return rows.mapInArrow(run, ", ".join(x for x in (head, schema) if x))
