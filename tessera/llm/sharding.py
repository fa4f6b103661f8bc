"""Sharding by fixed virtual slots: records are hashed into slots for good, and a versioned map says which shard holds a slot.

Rebalancing or growing edits the map, slot by slot, and writes a new version of it beside the old ones; records never change their slot. A
slot that holds far more than its share (one key with very many rows, or none) has parts, which are mapped one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, scratch_dir, spread, stored

#: Virtual slots and shards.
SLOTS, SHARDS = 8192, 24
#: A slot is split where it holds so many times the mean slot's bytes or rows.
SPLIT = 4
#: What a record costs besides its text's bytes.
OVERHEAD = 8
#: Rebalancing stops once the largest and the smallest shard are so near, as a share of the mean.
NEAR = 1e-4


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: the shard of each part of each slot. There are at most 3 * SLOTS parts, however many records."""

    version: int
    n_shards: int
    slot: np.ndarray
    part: np.ndarray
    shard: np.ndarray

    def edited(self, shard: np.ndarray, n_shards: int | None = None) -> SlotMap:
        return replace(self, version=self.version + 1, n_shards=n_shards or self.n_shards, shard=shard)

    def edits(self, before: SlotMap) -> list[tuple[int, int, int, int]]:
        """(slot, part, from, to) of what this version moves."""
        return [(int(self.slot[i]), int(self.part[i]), int(before.shard[i]), int(self.shard[i])) for i in np.flatnonzero(self.shard != before.shard)]


def first_map(parts: dict[int, int], n_shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    """Version 1, as many slots for each shard, whatever they hold. parts: of the slots that are split, how many they have."""
    each = np.array([parts.get(s, 1) for s in range(slots)])
    slot = np.repeat(np.arange(slots), each)
    part = np.concatenate([np.arange(n) for n in each])
    return SlotMap(1, n_shards, slot, part, (slot + part) % n_shards)


def save_map(spark: SparkSession, at: SlotMap, path: str) -> None:
    """Writes a version; one that exists is never written over, so that of two editors one fails."""
    rows = [(int(s), int(p), int(h), at.n_shards) for s, p, h in zip(at.slot, at.part, at.shard, strict=True)]
    spark.createDataFrame(rows, "slot int, part int, shard int, n_shards int").coalesce(1).write.parquet(f"{path.rstrip('/')}/version={at.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the map, the latest if none is named."""
    found = spark.read.parquet(path)
    version = found.agg(F.max("version")).first()[0] if version is None else version
    rows = found.filter(F.col("version") == version).orderBy("slot", "part").select("slot", "part", "shard", "n_shards").collect()  # at most 3 * SLOTS
    slot, part, shard, n = (np.array(c) for c in zip(*rows, strict=True))
    return SlotMap(int(version), int(n[0]), slot, part, shard)


def _swap(high: np.ndarray, low: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Which load of high to give for which of low (-1: for none), so that the two shards come nearest; None if nothing brings them nearer."""
    order = np.argsort(low, kind="stable")
    back = np.concatenate(([0], low[order]))
    want = high - gap / 2
    at = np.searchsorted(back, want)
    best = None
    for near in (np.clip(at - 1, 0, len(back) - 1), np.clip(at, 0, len(back) - 1)):
        moved = high - back[near]
        off = np.where((moved > 0) & (moved < gap), np.abs(moved - gap / 2), np.inf)
        if len(off) and np.isfinite(off.min()) and (best is None or off.min() < best[0]):
            i = int(off.argmin())
            best = (off[i], i, int(near[i]))
    return best and (best[1], int(order[best[2] - 1]) if best[2] else -1)


def rebalance(at: SlotMap, load: np.ndarray) -> SlotMap:
    """The next version, with the loads of its shards as near as moves and swaps of parts between a large and a small shard make them.

    Each edit brings two shards nearer, so it ends; it stops at NEAR of the mean. A part is never cut, so that a record
    larger than a shard's share stays alone above it.
    """
    shard = at.shard.copy()
    total = np.bincount(shard, load, at.n_shards).astype(np.int64)
    full = load > 0
    while total.max() - total.min() > NEAR * total.mean():
        order = np.argsort(total, kind="stable")
        for i, j in ((i, j) for i in order[::-1] for j in order if total[i] > total[j]):
            high, low = np.flatnonzero(full & (shard == i)), np.flatnonzero(full & (shard == j))
            if found := _swap(load[high], load[low], int(total[i] - total[j])):
                give, take = high[found[0]], found[1] if found[1] < 0 else low[found[1]]
                moved = load[give] - (load[take] if take >= 0 else 0)
                shard[give] = j
                if take >= 0:
                    shard[take] = i
                total[i] -= moved
                total[j] += moved
                break
        else:
            break
    return at.edited(shard)


def grow(at: SlotMap, load: np.ndarray) -> SlotMap:
    """The next version, with one more shard, into which each of the others gives what it has above the new share; nothing else moves."""
    shard, total = at.shard.copy(), np.bincount(at.shard, load, at.n_shards).astype(np.int64)
    share = total.sum() / (at.n_shards + 1)
    for i in range(at.n_shards):
        own = np.flatnonzero((at.shard == i) & (load > 0))
        for u in own[np.argsort(-load[own], kind="stable")]:
            if total[i] - load[u] >= share:
                shard[u], total[i] = at.n_shards, total[i] - load[u]
    return at.edited(shard, at.n_shards + 1)


def placed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, uid) of each row, written once. The text is read here and no longer carried."""
    body = F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b""))
    doc = F.col(f"`{key}`").cast("long")
    columns = [doc.alias("doc_id"), (F.length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.pmod(F.xxhash64(doc), F.lit(slots)).cast("int").alias("virtual_slot")]
    return stored(spread(docs.select(key, text)).select(*columns, F.monotonically_increasing_id().alias("uid")))


def _part(parts: F.Column) -> F.Column:
    return F.pmod(F.xxhash64("uid"), parts).cast("int")


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[dict[tuple[int, int], tuple[int, int]], dict[int, int]]:
    """Bytes and rows of each part of each slot, and how many parts the split slots have.

    Sums by slot, combined within tasks first; only what lies in split slots is summed once more, by part.
    """
    sums = [F.sum("size").alias("bytes"), F.count("*").alias("n")]
    held = {r["virtual_slot"]: (r["bytes"], r["n"]) for r in rows.groupBy("virtual_slot").agg(*sums).collect()}  # one row a slot
    mean = [sum(v[k] for v in held.values()) / slots for k in (0, 1)]
    parts = {}
    for s, v in held.items():
        times = max(v[0] / mean[0], v[1] / mean[1])
        if times > SPLIT and v[1] > 1:
            parts[s] = min(-int(-times // 1), v[1])
    loads = {(s, 0): v for s, v in held.items() if s not in parts}
    if parts:
        split = F.broadcast(rows.sparkSession.createDataFrame(list(parts.items()), "virtual_slot int, parts int"))  # at most 2 * SLOTS / SPLIT rows
        again = rows.join(split, "virtual_slot").groupBy("virtual_slot", _part(F.col("parts")).alias("part")).agg(*sums)
        loads |= {(r["virtual_slot"], r["part"]): (r["bytes"], r["n"]) for r in again.collect()}  # at most 3 * SLOTS
    return loads, parts


def map_of(rows: DataFrame, path: str, n_shards: int = SHARDS, slots: int = SLOTS) -> tuple[SlotMap, np.ndarray, np.ndarray]:
    """Writes the first map under path and the one rebalanced by bytes; reads the latest back. With it, bytes and rows of its parts."""
    spark = rows.sparkSession
    loads, parts = slot_loads(rows, slots)
    at = first_map(parts, n_shards, slots)
    size, n = (np.array([loads.get((int(s), int(p)), (0, 0))[k] for s, p in zip(at.slot, at.part, strict=True)], np.int64) for k in (0, 1))
    save_map(spark, at, path)
    save_map(spark, rebalance(at, size), path)
    return load_map(spark, path), size, n


def with_shards(rows: DataFrame, at: SlotMap, n: np.ndarray | None = None) -> DataFrame:
    """rows of (virtual_slot, uid, ...) with part, shard and, if the rows of each part are given, before: those of its shard's parts ahead of it."""
    n = np.zeros(len(at.slot), np.int64) if n is None else n
    before = np.zeros(len(at.slot), np.int64)
    for i in range(at.n_shards):
        own = at.shard == i
        before[own] = np.cumsum(n[own]) - n[own]
    table: dict[int, list] = {}
    for s, h, b in zip(at.slot.tolist(), at.shard.tolist(), before.tolist(), strict=True):
        table.setdefault(s, []).append((h, b))
    homes = rows.sparkSession.createDataFrame(list(table.items()), "virtual_slot int, homes array<struct<shard: int, before: bigint>>")
    joined = rows.join(F.broadcast(homes), "virtual_slot").withColumn("part", _part(F.size("homes")))  # one row a slot, at most 3 * SLOTS places
    return joined.withColumn("home", F.get("homes", F.col("part"))).select(*rows.columns, "part", "home.shard", "home.before")


def shard_report(docs: DataFrame, path: str | None = None, n_shards: int = SHARDS, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, part and map_version.

    The law is `bytes`: sizes, UTF-8 bytes of the text and 8, are spread evenly by a map that was rebalanced by them, so that doc_id alone
    doesn't decide and grown_shard is null. slot numbers the rows of a shard from 0: parts in order, rows within a part by a
    window over that part alone. A null text has size 8 and crc32 0. Null keys share a virtual slot, rows of one key too; such a slot is
    split into parts when it grows out of its share. Repeated rows are rows of their own. Other columns are ignored, whatever
    their names. An empty table gives no rows. Maps are kept under path, or in the shared folder.
    """
    rows = placed_rows(docs, key, text, slots)
    at, _, n = map_of(rows, path or scratch_dir(docs.sparkSession), n_shards, slots)
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("uid")) - 1
    out = with_shards(rows, at, n).withColumn("slot", F.col("before") + rank)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "part", F.lit(at.version).alias("map_version"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> SlotMap:
    """Writes docs with all their columns under path/data, a folder for each shard, and the versions of the map under path/map.

    The rows are written to the shared folder once with their numbers, which also tell the parts of split slots apart; then each
    part goes to its shard's folder from a task of its own share, so that no shard is one task. The folders are named by a column that docs
    doesn't have: shard, or _shard.
    """
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    doc, body = (F.col(own[names.index(c)]) for c in (key, text))
    size = F.coalesce(F.length(body.cast("string").cast("binary")), F.lit(0)) + OVERHEAD
    held = stored(spread(docs.toDF(*own)).withColumns({"virtual_slot": F.pmod(F.xxhash64(doc.cast("long")), F.lit(slots)).cast("int"), "size": size.cast("long"), "uid": F.monotonically_increasing_id()}))
    at, _, _ = map_of(held.select("virtual_slot", "size", "uid"), f"{path}/map", n_shards, slots)
    folder = fresh(docs, "shard")[0]
    dealt = with_shards(held, at).repartition("virtual_slot", "part").select(*[F.col(o).alias(c) for o, c in zip(own, names, strict=True)], F.col("shard").alias(folder))
    dealt.write.partitionBy(folder).parquet(f"{path}/data")
    return at
