"""Pairs within buckets, block by block: what similarity joins share.

A bucket of more rows than a block is cut into blocks by hash, and each pair of blocks is a unit of work of its own.
Rows are copied once per unit, never once per pair, and pairs exist only as numpy arrays inside a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
#: Pairs that a task looks at in one go.
PAIRS = 1 << 18
UNIT = ["bucket", "part_a", "part_b"]


def units(members: DataFrame, item: str, block: int = BLOCK) -> DataFrame:
    """members (bucket, item, more columns) to one row per unit that it takes part in: UNIT and side are added.

    Buckets of one row go. In a unit of one block all pairs are meant, in one of two blocks those across the sides 0 and 1.
    """
    counts = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    held = members.join(counts, "bucket").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    held = held.withColumn("own", F.pmod(F.xxhash64(F.lit(7), F.col(item)), F.col("blocks")).cast("int"))
    out = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.select(*members.columns, F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def by_unit(df: DataFrame, run: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run(rows, starts) over tables of whole units, sorted by unit; starts has where each begins, and the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            edges = _edges(batch)
            last = pa.Table.from_batches(held)
            if len(edges) < 2:  # the unit may go on; one unit is at most two blocks
                continue
            cut = last.num_rows - batch.num_rows + int(edges[-1])
            head = last.slice(0, cut).combine_chunks()
            held = last.slice(cut).combine_chunks().to_batches()
            yield from run(head, np.append(_edges(head), head.num_rows))
        if held:
            head = pa.Table.from_batches(held).combine_chunks()
            yield from run(head, np.append(_edges(head), head.num_rows))

    return df.repartition(*UNIT).sortWithinPartitions(*UNIT, "side").mapInArrow(whole, schema)


def column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _edges(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    change[:1] = True
    for name in UNIT:
        x = rows.column(name).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(name).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def pairs(starts: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of all pairs meant by the units, PAIRS at a time or what one row has."""
    ends = np.repeat(starts[1:], np.diff(starts))
    n = len(ends)
    across = np.add.reduceat(sides, starts[:-1]) > 0 if n else np.zeros(0, bool)
    across = np.repeat(across, np.diff(starts))
    first_b = np.repeat(starts[:-1] + np.add.reduceat(1 - sides, starts[:-1]), np.diff(starts)) if n else ends
    begin = np.where(across, np.where(sides == 0, first_b, ends), np.arange(n) + 1)
    many = np.maximum(ends - begin, 0)
    total = np.concatenate(([0], np.cumsum(many)))
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(total, total[row] + PAIRS, "right")) - 1)
        k = many[row:stop]
        if k.sum():
            i = np.repeat(np.arange(row, stop), k)
            j = np.arange(k.sum()) - np.repeat(total[row:stop] - total[row], k) + begin[i]
            yield i, j
        row = stop


def labels(n: int, i: np.ndarray, j: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each of n rows the row of the smallest name that the pairs connect it to."""
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    a, b = rank[i], rank[j]
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return order[label[rank]]


LINKS = "item long, root long, links long"


def links_batch(items: np.ndarray, weights: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """LINKS of the rows in the pairs: how many rows, by weight, each is linked to, and the smallest item it is connected to."""
    at = np.unique(np.concatenate((i, j)))
    a, b = np.searchsorted(at, i), np.searchsorted(at, j)
    links = np.zeros(len(at), np.int64)
    np.add.at(links, a, weights[j])
    np.add.at(links, b, weights[i])
    root = labels(len(at), a, b, items[at])
    return pa.RecordBatch.from_arrays([pa.array(items[at]), pa.array(items[at][root]), pa.array(links)], names=["item", "root", "links"])
