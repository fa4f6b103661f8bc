"""Components of many small or large graphs at once, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..env import stored


def roots(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, root) of the edges (keys, a, b): root is the least item of item's component, for items that aren't roots themselves.

    Each round every item takes the least root among its neighbours', and a root that has found a lesser one hands it to all
    that point to it, so that a chain's rounds grow with the logarithm of its length. Rounds are written to the shared folder; they end when nothing moves.
    Joins are merges at every size: of millions of rows that lie in a few MB of Parquet, Spark would broadcast one side through the driver.
    """
    both = edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = stored(both)
    at = stored(both.groupBy(*keys, F.col("a").alias("item")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        # an item's own root, and what its neighbours point to
        near = both.join(at.withColumnRenamed("item", "b").hint("merge"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("item")).agg(F.min("root").alias("near"))
        met = at.join(near.hint("merge"), [*keys, "item"]).select(*keys, "item", "root", F.least("root", "near").alias("next"))
        # a root hears of the least that any of its own has met, and so do they
        told = met.groupBy(*keys, "root").agg(F.min("next").alias("least"))
        new = stored(met.join(told.hint("merge"), [*keys, "root"]).select(*keys, "item", F.least("next", "least").alias("root"), (F.least("next", "least") < F.col("root")).alias("moved")))
        jump = new.select(*keys, F.col("item").alias("root"), F.col("root").alias("further"))
        at = new.join(jump.hint("merge"), [*keys, "root"], "left").select(*keys, "item", F.least("root", F.coalesce("further", "root")).alias("root"))
        if not new.filter("moved").limit(1).count():
            return at.filter("item <> root")
        at = stored(at)
