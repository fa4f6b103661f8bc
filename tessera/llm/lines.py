"""Line dedup by overlapping three-line windows, in column expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

WINDOW = 3


def _windows(df: DataFrame, doc: str, fp: str, text: str) -> DataFrame:
    """(doc, fp, from, to, h1, h2): each run of WINDOW lines that aren't blank, with the places of its first and last line."""
    lines = F.filter(
        F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("i"), F.xxhash64(F.lit(1), F.trim(x)).alias("a"), F.xxhash64(F.lit(2), F.trim(x)).alias("b"), (F.trim(x) != "").alias("full"))),
        lambda s: s["full"],
    )
    held = df.select(doc, fp, lines.alias("l")).filter(F.size("l") >= WINDOW)
    at = lambda i, k: F.element_at(F.col("l"), i + k)
    spans = F.transform(
        F.sequence(F.lit(1), F.size("l") - WINDOW + 1),
        lambda i: F.struct(
            at(i, 0)["i"].alias("from"),
            at(i, WINDOW - 1)["i"].alias("to"),
            F.xxhash64(*[at(i, k)["a"] for k in range(WINDOW)]).alias("h1"),
            F.xxhash64(*[at(i, k)["b"] for k in range(WINDOW)]).alias("h2"),
        ),
    )
    return held.select(doc, fp, F.explode(spans).alias("w")).select(doc, fp, "w.*")


def _covers(docs: DataFrame, doc: str, fp: str, text: str) -> DataFrame:
    """(doc, fp, cut): for texts that lose lines, the array of (from, to) of windows that occurred earlier in the corpus."""
    windows = _windows(docs, doc, fp, text)
    place = F.struct(F.col(doc), F.col(fp), F.col("from"))
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).filter(place > F.col("first"))
    return later.groupBy(doc, fp).agg(F.collect_set(F.struct("from", "to")).alias("cut"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """docs without the lines of windows of three lines that occur earlier in the corpus; removed: a column for their number.

    Lines are split at \\n; windows run over the lines that aren't blank, compared without outer spaces by two
    64-bit hashes. Order is by key (nulls first), then text hash, then place. The first occurrence of a window stays;
    the lines from the first to the last of every later one go, blank ones between too, and overlapping
    windows merge. Rows of equal key and text count as one document: they lose the same lines. Texts of fewer than
    three full lines, empty and null ones stay as they are, so do other columns whatever their names.

    Windows are counted by hash with partial aggregation, and the join that finds later occurrences is one that
    Spark splits where a window is very common. A document's cuts are bounded by its own lines.
    """
    doc, fp, whole, cut, gone, n, r_doc, r_fp = fresh(docs, "own_doc", "own_fp", "own_text", "cut", "gone", "n_gone", "r_doc", "r_fp")
    held = docs.withColumn(doc, F.col(f"`{key}`")).withColumn(whole, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    held = held.withColumn(fp, F.xxhash64(F.col(whole)))
    covers = _covers(held.select(doc, fp, whole), doc, fp, whole).select(F.col(doc).alias(r_doc), F.col(fp).alias(r_fp), F.col("cut").alias(cut))
    joined = held.join(covers, held[doc].eqNullSafe(covers[r_doc]) & (held[fp] == covers[r_fp]), "left").drop(r_doc, r_fp)
    spans = F.array_sort(F.col(cut))
    drop = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["from"], s["to"]))))
    joined = joined.withColumn(gone, F.when(F.col(cut).isNotNull(), drop))
    # array_except hashes, so that this takes time in proportion to the lines
    stay = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    kept = let(F.split(F.col(whole), "\n", -1), stay)
    new = F.when(F.col(gone).isNull(), F.col(f"`{text}`").cast("string")).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn(n, F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long")).withColumn(text, new)
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(n))
    return out.withColumnRenamed(n, removed) if removed else out.drop(n)
