"""Shards against plain Python, and what edits of the map may do."""

import zlib

import numpy as np
import pytest

from tessera.llm import sharding

SCHEMA = "doc_id long, text string, shard string, uid string, slot string, virtual_slot string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA)


def check(report, rows, n_shards):
    got = report.collect()
    want = sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    assert set(shards) <= set(range(n_shards))
    for rs in shards.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    assert {r["law"] for r in got} <= {"bytes"} and all(r["grown_shard"] is None for r in got)
    sizes = [sum(r["size"] for r in shards.get(i, [])) for i in range(n_shards)]
    return got, sizes


def test_shards_are_gapless_and_even(spark):
    r = np.random.default_rng(1)
    rows = [(i, "é" * int(r.integers(0, 400))) for i in range(3000)]
    got, sizes = check(sharding.shard_report(docs_of(spark, rows), n_shards=7, slots=256), rows, 7)
    assert max(sizes) - min(sizes) <= 0.002 * np.mean(sizes)
    by_key = {}
    for x in got:
        by_key.setdefault(x["doc_id"], x["virtual_slot"])
    again, _ = check(sharding.shard_report(docs_of(spark, rows[:500]), n_shards=3, slots=256), rows[:500], 3)
    assert all(by_key[x["doc_id"]] == x["virtual_slot"] for x in again)  # slots are for good


def test_hot_keys_and_copies_are_split(spark):
    """A third of the rows without a key, a third copies of one row: no virtual slot keeps them together."""
    rows = [(None, f"text {i}") for i in range(900)] + [(7, "same text")] * 900 + [(1000 + i, f"other {i}") for i in range(900)]
    got, sizes = check(sharding.shard_report(docs_of(spark, rows), n_shards=6, slots=64), rows, 6)
    assert max(sizes) - min(sizes) <= 0.02 * np.mean(sizes)
    parts = {}
    for x in got:
        parts[x["virtual_slot"], x["part"]] = parts.get((x["virtual_slot"], x["part"]), 0) + 1
    assert max(parts.values()) < 4 * 2700 / 64 * 1.5


def test_odd_rows(spark):
    assert sharding.shard_report(docs_of(spark, [])).collect() == []
    rows = [(None, None), (None, None), (-5, ""), (-5, ""), (3, "x" * 100_000), (4, "\n"), (5, "a b")]
    _, sizes = check(sharding.shard_report(docs_of(spark, rows), n_shards=3), rows, 3)
    assert sorted(sizes)[-1] == 100_008  # the long record stands alone


def test_map_versions(spark, tmp_path):
    r = np.random.default_rng(2)
    load = r.lognormal(8, 1.2, 512).astype(np.int64)
    first = sharding.first_map({5: 3}, 8, 512)
    load = np.concatenate((load, [10, 20]))
    second = sharding.rebalance(first, load)
    third = sharding.grow(second, load)
    for at in (first, second, third):
        sharding.save_map(spark, at, str(tmp_path / "map"))
    last = sharding.load_map(spark, str(tmp_path / "map"))
    assert (last.version, last.n_shards) == (3, 9) and (last.shard == third.shard).all()
    assert (sharding.load_map(spark, str(tmp_path / "map"), 2).shard == second.shard).all()
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sharding.save_map(spark, second, str(tmp_path / "map"))
    before, after = (np.bincount(m.shard, load, 8) for m in (first, second))
    assert after.max() - after.min() <= 1e-3 * after.mean() < before.max() - before.min()
    assert 0 < len(second.edits(first)) < 200  # most slots stay
    assert {e[3] for e in third.edits(second)} == {8}  # a new shard takes slots only into itself
    grown = np.bincount(third.shard, load, 9)
    assert grown.max() - grown.min() <= 0.05 * grown.mean()


def test_a_slot_larger_than_a_shard_stays_alone():
    load = np.ones(64, np.int64)
    load[3] = 1000
    out = sharding.rebalance(sharding.first_map({}, 4, 64), load)
    assert (out.shard == out.shard[3]).sum() == 1 and sorted(np.bincount(out.shard, load, 4)) == [21, 21, 21, 1000]


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(i % 40 or None, f"text {i}" * (i % 7)) for i in range(400)]
    docs = docs_of(spark, rows)
    at = sharding.write_shards(docs, str(tmp_path), n_shards=5, slots=64)
    back = spark.read.parquet(str(tmp_path / "data"))
    assert set(back.columns) == {*docs.columns, "_shard"} and at.version == 2
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    sizes = [r["s"] for r in back.groupBy("_shard").agg({"text": "count"}).withColumnRenamed("count(text)", "s").collect()]
    assert len(sizes) == 5
