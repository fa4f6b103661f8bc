"""A corpus pipeline of five stages, each one operator of tessera.llm on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes as Parquet and reads again; all but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import lines, neardup, packing, quality, secrets
from tessera.llm.common import fresh, stored, table

VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, each row by its own text.

    A null or empty text, like any of fewer than 50 words, is rejected. Repeated rows go or stay together. Other columns and keys, null
    keys too, stay as they are. An empty table gives an empty one.
    """
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts, in the order of doc_id; n_chars follows.

    A text that loses all its lines stays, empty; a null text stays null, with a null n_chars. Rows of one doc_id keep their windows alike if
    their texts are equal. Null keys come first. Other columns stay as they are. An empty table gives an empty one.
    """
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of the smallest doc_id.

    It is decided per row: of rows with one doc_id and equal shingle sets one stays, of those with differing sets each
    is judged for itself. Texts without words, null or empty, and rows with a null doc_id all stay. Other columns stay as
    they are. An empty table gives an empty one.
    """
    return neardup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret in a text becomes its kind in angle brackets; n_chars follows.

    A null text stays null, a text without secrets stays as it is, and every row stays, repeated ones and those with null keys too.
    Other columns stay as they are, whatever their names. An empty table gives an empty one.
    """
    spans = fresh(docs, "found")[0]
    found = secrets.find_secrets(docs, out=spans)
    text = F.when(F.size(spans) > 0, secrets.masked(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, one row each.

    A null or empty text is its end mark alone. Repeated rows, and rows whose doc_ids are null or come twice, are documents of their own.
    Other columns are left out. An empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("packing", packing_order),
]
#: Packing needs a tokenizer, which SQL doesn't have; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
