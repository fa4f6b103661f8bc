"""Rows that an order leaves open are taken as the table has them."""

import math

from tessera import catalog

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


def test_runs_of_one_id_are_taken_in_the_order_of_the_table(spark, tmp_path):
    """The first file has the dear run of the id that two runs share. It is the smaller file, which Spark reads last."""
    line = lambda order, price: (order, 7, 1, 1, 25.0, price, 0.0, 0.05, "A", "F")
    first = [line(4, 500.0)]
    second = [line(i, 100.0) for i in range(4)] + [line(4, 10.0)] + [line(i, 0.0) for i in range(5, 400)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, LINE).toPandas().to_parquet(tmp_path / f"{i}.parquet")
    folder = tmp_path / "t" / "lineitem.parquet"
    folder.mkdir(parents=True)
    for i in (0, 1):
        (tmp_path / f"{i}.parquet").rename(folder / f"part-{i}.parquet")
    got = catalog.QUERIES["summary_left_join_worst"](spark, str(tmp_path / "t")).collect()
    assert [(r["n"], r["largest"]) for r in got] == [(401, 500)]
    assert math.isclose(got[0]["worst"], (4 * 100 + 500) / 5)
