"""Whitening of embeddings with Spark MLlib's BlockMatrix.

Centred rows are indexed and cut into blocks; the scatter is the transpose times the blocks, its eigenvectors are found
locally, and the blocks times the whitening matrix are the projected rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, stored

#: What makes whole numbers of entries: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components returned at most.
COMPONENTS = 32
#: Entries beyond this have no exact whole number and count as not finite.
LARGEST = 2.0**46
#: Rows and columns of a block, some 8 MB.
ROWS, COLUMNS = 8192, 128
#: Groups of blocks that are multiplied apart, before their products are summed, grow with the blocks up to this and then with their root.
GROUPS = 1024
#: An eigenvalue below this share of the largest, for each dimension, is rounding.
NOTHING = 1e-15

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_entries(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, x, uid) of the rows whose vector is all finite, written once; x are whole numbers, uid tells the rows apart."""
    c = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda v: v)
    good = F.coalesce(F.size(c) > 0, F.lit(False)) & F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)), F.lit(False))
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + SHIFT)
    return stored(spread(rows.select(key, vector)).filter(good).select(F.col(f"`{key}`").cast("long").alias("vec_id"), x.alias("x"), F.monotonically_increasing_id().alias("uid")))


def indexed(rows: DataFrame) -> DataFrame:
    """Replaces uid by index, which has no gaps: how many rows each partition has (one row each) gives its first index."""
    counts = rows.groupBy(F.shiftright("uid", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, first = 0, []
    for r in counts:
        first.append((r["part"], before - (r["part"] << 33)))
        before += r["n"]
    table = F.broadcast(rows.sparkSession.createDataFrame(first, "part long, move long"))
    return rows.withColumn("part", F.shiftright("uid", 33)).join(table, "part").withColumn("index", F.col("uid") + F.col("move")).drop("part", "move", "uid")


def block_matrix(rows: DataFrame, index: str, values: str, n: int, width: int) -> BlockMatrix:
    """A column of arrays as a matrix of blocks; everything stays in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col(index).alias("index"), array_to_vector(values).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(ROWS, min(width, COLUMNS))


def multiplied(left: BlockMatrix, right: BlockMatrix, groups: int = 1) -> BlockMatrix:
    """left times right, with the blocks that meet in one block of the product dealt to so many tasks, whose products are summed."""
    product = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, groups)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def scatter(m: BlockMatrix, n: int) -> np.ndarray:
    """The transpose of m times m. Without groups all blocks of m would meet in the one task of the product's block."""
    blocks = -(-n // ROWS)
    groups = blocks if blocks <= GROUPS else math.isqrt(blocks * GROUPS)
    return multiplied(m.transpose(), m, groups).toLocalMatrix().toArray()


def components_of(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (columns) by falling eigenvalue, the eigenvalues, and the trace. Those without variance are left out."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > NOTHING * len(values) * max(values[0], 0)).sum()))
    return vectors[:, :k], values[:k], float(np.trace(covariance))


def projected(m: BlockMatrix, weights: np.ndarray, spark: SparkSession) -> DataFrame:
    """(index, y) of the rows of m times the weights, which are cut into blocks as tall as those of m are wide."""
    width, k = weights.shape
    cut = [((i, 0), Matrices.dense(len(w), k, w.ravel(order="F"))) for i, w in ((at // m.colsPerBlock, weights[at : at + m.colsPerBlock]) for at in range(0, width, m.colsPerBlock))]
    w = BlockMatrix(spark.sparkContext.parallelize(cut, 1), m.colsPerBlock, k, width, k)
    rows = callMLlibFunc("getIndexedRows", multiplied(m, w).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("y"))


def _sums(rows: DataFrame, values: str, width: int, kind: str) -> list:
    """Sums by place of a column of arrays: one row."""
    return list(rows.agg(*[F.sum(F.get(values, F.lit(i)).cast(kind)).alias(f"s{i}") for i in range(width)]).first())


def whitened_rows(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Per row whose vector is all finite: vec_id, n, deviation, y (the whitened row, an array), explained (an array), identity_error.

    Vectors that are null or empty, or hold a null, NaN, infinite or larger entry than LARGEST, are dropped, and so are those whose length isn't
    the most frequent one (the longer of two as frequent). Covariances are over all that remain, divisor n, of rows that are centred before they are multiplied:
    each entry less the whole part of its mean is exact, and the fraction is taken off in double precision. Components
    without variance aren't returned, so one row, or equal rows, give none. deviation is exact, null where a long can't hold it.
    Null and repeated keys are rows of their own. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    spark = rows.sparkSession
    x = whole_entries(rows, key, vector)
    # lengths that vectors come in: one row each, and just the leading one is taken
    lead = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lead is None:
        return spark.createDataFrame([], "vec_id long, n long, deviation long, y array<double>, explained array<double>, identity_error double")
    d, n = lead["d"], lead["n"]
    if x.count() > n:  # of vectors of several lengths those that stay are numbered again
        x = stored(x.filter(F.size("x") == d).withColumn("uid", F.monotonically_increasing_id()))
    x = indexed(x)
    total = [int(s) for s in _sums(x, "x", d, "decimal(38,0)")]
    whole = [s // n for s in total]
    left = [s - w * n for s, w in zip(total, whole, strict=True)]  # 0 <= left < n

    means = F.array(*[F.struct(F.lit(w).cast("long").alias("w"), F.lit(r).cast("long").alias("r")) for w, r in zip(whole, left, strict=True)])
    off = F.zip_with("x", means, lambda v, m: v - m["w"])
    centred = F.zip_with("off", means, lambda v, m: v.cast("double") - m["r"].cast("double") / n)
    exact = F.zip_with("off", means, lambda v, m: F.try_subtract(F.try_multiply(v, F.lit(n).cast("long")), m["r"]))
    deviation = F.aggregate(exact, F.lit(0).cast("long"), lambda a, v: F.try_add(a, F.try_multiply(v, v)))
    held = x.withColumn("off", off).select("index", "vec_id", deviation.alias("deviation"), centred.alias("c"))

    m = block_matrix(held, "index", "c", n, d)
    vectors, values, trace = components_of(scatter(m, n) / n, most)
    k = len(values)
    if not k:
        return spark.createDataFrame([], "vec_id long, n long, deviation long, y array<double>, explained array<double>, identity_error double")
    out = stored(held.select("index", "vec_id", "deviation").join(projected(m, vectors / np.sqrt(values), spark), "index"))

    middle = F.array(*[F.lit(s / n) for s in _sums(out, "y", k, "double")])
    again = block_matrix(out.select("index", F.zip_with("y", middle, lambda v, c: v - c).alias("c")), "index", "c", n, k)
    error = float(np.abs(scatter(again, n) / n - np.eye(k)).max())
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "y", F.array(*[F.lit(float(v / trace)) for v in values]).alias("explained"), F.lit(error).alias("identity_error"))


def whitening_report(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """The RESULT columns: whitened_rows() with a row for each component, numbered from 1."""
    out = whitened_rows(rows, key, vector, most).withColumn("z", F.arrays_zip("y", "explained"))
    long = out.select("vec_id", "n", "deviation", "identity_error", F.posexplode("z").alias("i", "z"))
    return long.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.col("z.y").alias("whitened"), F.col("z.explained").alias("explained"), "identity_error")
