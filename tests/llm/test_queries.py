"""The registered queries against DuckDB, and the pipeline stage by stage."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline
from tessera.llm import neardup, oracles, quality, queries
from tests.test_oracles import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), c.sql(oracles.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality.quality_report(docs).filter("kept").select("doc_id").collect()}
    at = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        before, at = at, spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert at.columns == docs.columns
        if i == 0:
            assert {r["doc_id"] for r in at.select("doc_id").collect()} == kept
        if i == 1:
            assert at.count() == before.count()
        if i == 2:
            classes = neardup.near_duplicates(before).select("class_id").distinct().count()
            assert at.count() == classes and neardup.near_duplicates(at).filter("n_links > 0").count() == 0
        if i == 3:
            assert at.filter("text rlike '[0-9a-f]{32,}'").count() == 0
    assert at.select("doc_id").distinct().count() == before.count()
