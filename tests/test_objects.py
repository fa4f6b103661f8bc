"""Matches, tracks and micro-states against plain Python, and streams of several micro-batches against their batch twins."""

import datetime
import math
import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.env import stored
from tessera.operators import graph, objects
from tessera.plans import scene_queries
from tessera.streaming import processors, state


def greedy(a, b, within):
    """The pairs of two lists of points (id, x, y), nearest first."""
    near = sorted((math.dist(p[1:], q[1:]), p[0], q[0]) for p in a for q in b if math.dist(p[1:], q[1:]) < within)
    used_a, used_b, out = set(), set(), []
    for _, i, j in near:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            out.append((i, j))
    return sorted(out)


def test_greedy_pairs_by_cells(spark):
    r = np.random.default_rng(1)
    now, then, want = [], [], []
    for f in range(5):
        a = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.integers(0, 40, (60, 2)))]  # whole numbers: many ties
        b = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.integers(0, 40, (50, 2)))]
        now += [(f, *p) for p in a]
        then += [(f, *p) for p in b]
        want += [(f, *p) for p in greedy(a, b, 7.0)]
    schema = "frame int, id int, cx double, cy double"
    pairs = objects.near_pairs(spark.createDataFrame(now, schema), spark.createDataFrame(then, schema), ["frame"], 7.0)
    got = sorted(map(tuple, objects.greedy_pairs(pairs, ["frame"]).collect()))
    assert got == sorted(want)
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_many_points_of_one_frame_meet_by_cells(spark):
    """100,000 points in one frame: each meets only those of the cells around it."""
    points = spark.range(100_000).select(F.lit(0).alias("frame"), "id", (F.col("id") % 400 * 10.0).alias("cx"), (F.floor(F.col("id") / 400) * 10.0).alias("cy"))
    moved = points.withColumn("cx", F.col("cx") + 1.0)
    pairs = objects.near_pairs(points, moved, ["frame"], 5.0)
    assert pairs.count() == 100_000 and pairs.filter("a <> b").count() == 0


def test_tracks_follow_points(spark):
    rows = [(0, f, 10 + f, float(f), 5.0) for f in range(6)] + [(0, f, 50 - f, 30.0 - f, 20.0) for f in range(2, 5)] + [(0, 5, 99, 90.0, 90.0), (1, 3, 1, 0.0, 0.0)]
    got = objects.tracks(spark.createDataFrame(rows, "video int, frame int, id int, cx double, cy double"), 3.0).collect()
    named = {}
    for r in got:
        named.setdefault((r["video"], r["obj"]), []).append((r["frame"], r["id"]))
    assert sorted(sorted(v) for v in named.values()) == sorted([[(f, 10 + f) for f in range(6)], [(2, 48), (3, 47), (4, 46)], [(5, 99)], [(3, 1)]])
    assert (0, 10) in named


def test_parts_of_a_patch():
    ring = np.zeros((8, 14), int) + 10
    ring[1:7, 1:6] = 200
    ring[3:5, 3] = 10  # a hole
    ring[0, 13] = 200  # a speck that opening takes away
    ring[2:6, 8:11] = 180
    parts = objects.parts_of(ring)
    assert [p[:5] for p in parts] == [(0, 1, 1, 5, 6), (1, 8, 2, 3, 4)]
    assert all(v == 1 for p in parts for v in p[6])
    assert objects.parts_of(np.full((3, 3), 7)) == [] or objects.parts_of(np.full((3, 3), 7))[0][3:5] == (3, 3)
    small = objects.parts_of(np.array([[9, 9, 0, 9, 9]]))
    assert [p[1] for p in small] == [0, 3] and small[0][5] == small[1][5]


def test_otsu_is_the_best_split():
    r = np.random.default_rng(2)
    for _ in range(20):
        v = np.concatenate((r.integers(0, 60, 30), r.integers(100, 256, 20)))
        def apart(t):
            lo, hi = v[v <= t], v[v > t]
            return len(lo) * len(hi) * (lo.mean() - hi.mean()) ** 2 if len(lo) and len(hi) else 0.0  # noqa: E306, B023
        assert math.isclose(apart(objects.otsu(v)), max(apart(t) for t in range(256)))


def history(seed=3):
    """Rows of objects whose boxes stand still, move and change, and whose parts come from a few shapes."""
    r = np.random.default_rng(seed)
    shapes = [(2, 2, [1, 1, 1, 0]), (2, 3, [1, 0, 1, 1, 1, 1]), (3, 2, [1, 1, 1, 1, 0, 1]), (1, 1, [1])]
    rows = []
    for obj in range(6):
        x, y = 10, 10
        for f in range(24):
            if obj == 5 and f > 3:
                break  # too short to lock
            x, y = (x + int(r.integers(0, 6)), y) if f % 12 > 6 else (x, y)
            parts = []
            for p in range(1 + obj % 3):
                k = int(r.integers(0, len(shapes))) if r.random() < 0.4 else f // 6 % len(shapes)
                w, h, m = shapes[k]
                parts.append((p, 0, 0, w, h, f"k{k}", m))
            rows.append((obj % 2, f, obj, y, x, y + 5, x + 8, x + 4.0, y + 2.5, parts))
    return rows


ROWS = f"video int, frame int, obj long, top int, left int, bottom int, right int, cx double, cy double, parts array<{objects.PART}>"


def plain_events(rows):
    out = []
    for obj in {r[2] for r in rows}:
        past, was, ever, states, masks, current = [], False, False, {}, {}, {}
        for video, f, _, top, left, bottom, right, cx, cy, parts in sorted((r for r in rows if r[2] == obj), key=lambda r: r[1]):
            past = [*past, (left, top, right, bottom, cx, cy)][-5:]
            now = False
            if len(past) == 5:
                a = past[-1]
                size = lambda q: (q[2] - q[0] + 1) * (q[3] - q[1] + 1)
                inter = [max(0, min(a[2], b[2]) - max(a[0], b[0]) + 1) * max(0, min(a[3], b[3]) - max(a[1], b[1]) + 1) for b in past[:-1]]
                mean = sum(i / (size(a) + size(b) - i) for i, b in zip(inter, past[:-1], strict=True)) / 4
                now = mean > 0.85 or all(max(b[i] for b in past) - min(b[i] for b in past) <= 2 for i in (4, 5))
            if now and not was:
                out.append((video, obj, f, "LOCK", None, None, None, None))
            was, ever = now, ever or now
            for p, _, _, w, h, key, m in parts if ever else []:
                own = states.setdefault(p, {})
                fresh, old, area = key not in own, current.get(p), None
                if fresh:
                    own[key] = len(own)
                    masks[p, own[key]] = {(i // w, i % w) for i, v in enumerate(m) if v}
                    if old is not None:
                        area = len(masks[p, old] ^ masks[p, own[key]])
                if own[key] != old:
                    out.append((video, obj, f, "INIT_MICRO_STATE" if old is None else "MICRO_STATE_CHANGE", p, old, own[key], area))
                current[p] = own[key]
    return sorted(out, key=str)


def test_micro_states_in_batch_and_stream(spark, tmp_path):
    rows = history()
    df = spark.createDataFrame(rows, ROWS)
    want = plain_events(rows)
    assert {e[3] for e in want} == {"LOCK", "INIT_MICRO_STATE", "MICRO_STATE_CHANGE"} and sum(e[7] is not None for e in want) > 3 and sum(e[3] == "LOCK" for e in want) > 6
    assert sorted(map(tuple, objects.micro_events(df).collect()), key=str) == want
    src = processors.stream_of(spark, processors.slices(spark, df, "frame", 4), df.schema)
    state.run_in_batches(processors.micro_states(src), str(tmp_path / "out"), str(tmp_path / "state"), "append")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert len([x for x in os.listdir(tmp_path / "out") if x.startswith("batch=")]) >= 4
    assert sorted((tuple(r) for r in got.drop("batch").collect()), key=str) == want


def ema(series, bg=None, last=None):
    for v in series:
        bg, last = (float(v), v) if bg is None else ((0.95 * bg + 0.05 * v) if abs(v - last) < 60 and abs(v - bg) < 90 else bg, v)
    return bg


def test_background_goes_on_after_a_restart(spark, tmp_path):
    r = np.random.default_rng(4)
    data = {c: r.integers(0, 256, 12).tolist() for c in range(7)}
    folder = str(tmp_path / "in")

    def put(frames):
        spark.createDataFrame([(c, f, data[c][f]) for c in data for f in frames], "cell long, frame int, v int").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)

    def drain(initial=None, at="state"):
        src = processors.stream_of(spark, folder, "cell long, frame int, v int")
        state.run_in_batches(processors.background(src, still=60, near=90, initial=initial), str(tmp_path / f"out-{at}"), str(tmp_path / at))
        rows = spark.read.parquet(str(tmp_path / f"out-{at}")).collect()
        return {(x["cell"], x["frame"]): x["background"] for x in rows}, len({x["batch"] for x in rows})

    for frames in ((0, 1), (2, 3), (4, 5)):
        put(frames)
    got, n = drain()
    assert n == 3 and all(got[c, 5] == pytest.approx(ema(data[c][:6])) for c in data)
    for frames in ((6, 7), (8, 9), (3,), (10, 11)):  # frame 3 again: too old
        put(frames)
    got, n = drain()  # a new query with the same checkpoint goes on where the old one stopped
    assert n >= 6 and all(got[c, 11] == pytest.approx(ema(data[c])) for c in data)
    start = spark.createDataFrame([(c, ema(data[c][:3]), float(data[c][2]), 2) for c in data], "cell long, bg double, last double, frame int")
    again, _ = drain(start, "seeded")  # what the batch job worked out stands for the first three frames
    assert all(again[c, 11] == pytest.approx(ema(data[c])) for c in data) and not any(f < 3 for _, f in again)


def test_keys_fall_silent_and_come_back(spark, tmp_path):
    folder = str(tmp_path / "in")
    # the second batch's watermark reaches key 1's timer before the key is heard again
    for rows in ([(1, 0), (2, 10)], [(2, 100)], [(2, 120)], [(1, 130), (3, 140)], [(3, 300)]):
        spark.createDataFrame(rows, "k long, s long").select("k", F.timestamp_seconds(F.col("s") + 1000).alias("at")).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    src = processors.stream_of(spark, folder, "k long, at timestamp")
    state.run_in_batches(processors.silent(src, "k", "at", 60_000), str(tmp_path / "out"), str(tmp_path / "state"), "append")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["key"], r["last_ms"] // 1000 - 1000) for r in rows if r["silent"]) == [(1, 0), (1, 130), (2, 120)]
    last = {}
    for r in rows:
        last[r["key"]] = max(last.get(r["key"], (0, False)), (r["last_ms"], r["silent"]))
    assert last == {1: (1_130_000, True), 2: (1_120_000, True), 3: (1_300_000, False)}


def state_rows(spark, checkpoint):
    return spark.read.format("statestore").option("path", str(checkpoint)).option("stateVarName", "bucket").load().count()


def test_silence_is_kept_by_buckets_of_keys(spark, tmp_path):
    r, gap = np.random.default_rng(5), 5_000
    rows = [(None if k == 700 else int(k) * 2**40, int(t)) for k, t in zip(r.integers(0, 701, 2_000), r.integers(0, 40_000, 2_000), strict=True)]
    df = spark.createDataFrame(rows, "k long, ms long").select("k", F.timestamp_millis("ms").alias("at"), F.expr("ms div 1000").alias("s")).repartition(5)
    seen = []

    def plan(src):
        seen.append(src)
        return processors.silent(src, "k", "at", gap, buckets=3)

    got = processors.fed(stored(df), "s", 4, plan, "append").groupBy("key").agg(F.max(F.struct("last_ms", "silent")).alias("l")).select("key", "l.*").collect()
    last = {}
    for k, t in rows:
        last[k] = max(last.get(k, 0), t)
    assert {x["key"]: (x["last_ms"], x["silent"]) for x in got} == {k: (t, t + gap < max(last.values())) for k, t in last.items()}
    assert len(seen) == 4 and None in last and {x["silent"] for x in got} == {True, False}
    # one state for all keys of a bucket, not one a key
    src = processors.stream_of(spark, processors.slices(spark, df, "s", 1), df.schema)
    state.run_in_batches(processors.silent(src, "k", "at", 10**9, buckets=3), str(tmp_path / "out"), str(tmp_path / "state"), "append")
    assert state_rows(spark, tmp_path / "state") == 4


def test_a_range_of_many_files_is_one_micro_batch(spark):
    df = stored(spark.range(0, 400).selectExpr("id % 7 cell", "cast(id as int) frame", "cast(id * 37 % 256 as int) v").repartition(6))
    got = processors.fed(df, "frame", 4, state.stream_ema)
    assert got.count() == 400 and [tuple(r) for r in got.groupBy("batch").count().orderBy("batch").collect()] == [(b, 100) for b in range(4)]


def test_backgrounds_are_kept_by_buckets_of_cells(spark, tmp_path):
    r = np.random.default_rng(6)
    data = {None if c == 300 else c * 2**40: sorted(r.choice(40, r.integers(1, 30), replace=False).tolist()) for c in range(301)}
    rows = [(c, f, int(r.integers(60, 200))) for c in data for f in data[c]]
    df = spark.createDataFrame(rows, "cell long, frame int, v int").repartition(5)
    got = processors.fed(stored(df), "frame", 4, lambda src: processors.background(src, still=60, near=90, buckets=3)).collect()
    want = {}
    for c, f, v in rows:
        bg, last = want.get((c, "now"), (None, None))
        want[c, "now"] = ema([v], bg, last), v
        want[c, f] = want[c, "now"][0]
    assert {(x["cell"], x["frame"]): x["background"] for x in got} == {k: v for k, v in want.items() if k[1] != "now"} and len(got) == len(rows)
    src = processors.stream_of(spark, processors.slices(spark, df, "frame", 1), df.schema)
    state.run_in_batches(processors.background(src, buckets=3), str(tmp_path / "out"), str(tmp_path / "state"))
    assert state_rows(spark, tmp_path / "state") == 4


def test_streams_of_odd_events_equal_their_sql(spark, tmp_path):
    at = lambda day, s: datetime.datetime(2024, 1, day, 0, 0, s)
    rows = [(u, at(day, s), v) for u in (1, 2, None, 2**60) for day, s, v in ((1, 0, 1.5), (2, 1, 1.7), (2, 2, None), (9, 3, 1.2))]
    rows += [(3, None, 2.0), (4, None, 0.1), (4, at(3, 0), 0.2), (5, at(1, 0), None), (5, at(2, 0), 1.0), (6, at(1, 0), 1.0), (6, at(2, 0), None), (6, at(3, 0), 1.1), (7, at(30, 9), 1.0)]
    rows += [(8, at(day, 0), (140 + day * day % 7) / 100) for day in range(1, 29)]
    for n, part in ("some", rows), ("none", []):
        d = str(tmp_path / n)
        spark.createDataFrame([(i, t, u, "a", v, None) for i, (u, t, v) in enumerate(part)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
        con = duckdb.connect()
        con.execute(f"create view events as select * from '{d}/events.parquet/*.parquet'")
        for q in ("stream_inactive_users", "stream_ema_background"):
            got = [tuple(r) for r in catalog.QUERIES[q](spark, d).collect()]
            assert sorted(got, key=str) == sorted(con.execute(catalog.ORACLES[q]).fetchall(), key=str), q


def test_short_lived_objects_have_no_events(spark):
    df = spark.createDataFrame(history(), ROWS)
    some = objects.lasting(df)
    assert some.count() == df.count() - 4  # object 5 is seen four times
    assert sorted(map(tuple, objects.micro_events(some).collect()), key=str) == sorted(map(tuple, objects.micro_events(df).collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that objects, components and queries over scenes store on their way."""
    out = []
    for module in objects, graph, scene_queries:
        monkeypatch.setattr(module, "stored", lambda df: (out.append(plan_of(df)), stored(df))[1])
    return out


def test_tracks_send_no_table_through_the_driver(spark, plans):
    """Regions lie in so few bytes of Parquet that Spark takes millions of them for a table to broadcast."""
    rows = [(v, f, 9 * k + f, 10.0 * k + f, 5.0) for v in range(2) for f in range(6) for k in range(8)]
    found = stored(spark.createDataFrame(rows, "video int, frame int, id int, cx double, cy double"))
    got = objects.tracks(found, 3.0)
    assert {tuple(r) for r in got.groupBy("video", "obj").count().collect()} == {(v, 9 * k, 6) for v in range(2) for k in range(8)}
    joins = [p for p in (*plans, plan_of(got)) if "Join" in p]
    assert len(joins) >= 5 and not any("Broadcast" in p for p in joins)


def test_parts_and_states_send_no_table_through_the_driver(spark, plans):
    """Neither frames, which are small before they are made, nor masks of states, which compress well, are broadcast."""
    side, rows = 8, history()
    frames = stored(spark.createDataFrame([(v, f, [(y * x + f) % 256 for y in range(side) for x in range(side)]) for v in range(2) for f in range(24)], "video int, frame int, px array<int>"))
    boxes = stored(spark.createDataFrame([(r[0], r[1], r[2], 1, 2, 6, 7, r[7], r[8]) for r in rows], ROWS.split(", parts")[0]))
    cut = objects.patch_parts(boxes, frames, side)
    assert cut.count() == len(rows) and cut.filter("size(parts) > 0").count() > 0
    got = objects.micro_events(stored(spark.createDataFrame(rows, ROWS)))
    assert sorted(map(tuple, got.collect()), key=str) == plain_events(rows)
    joins = [p for p in (*plans, plan_of(cut), plan_of(got)) if "Join" in p]
    assert len(joins) >= 2 and not any("Broadcast" in p for p in joins)


def test_stream_of_micro_states_sends_no_table_through_the_driver(spark, tmp_path, plans):
    """From the table on, and with the rows of its batch twin."""
    r, rows = np.random.default_rng(7), []
    for video in range(2):
        lit = r.random((100, 64)) < 0.1
        lit[:, :20] = False
        lit[5:10, 3:9] = lit[30:40, 12:16] = lit[::5, 16] = True  # both stand still, the second meets what scrolls by
        rows += [(512 * video + i, [1.0 if x else -1.0 for x in line], 1) for i, line in enumerate(lit.tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = catalog.QUERIES["micro_state_events"](spark, str(tmp_path)).collect()
    plans.clear()
    got = catalog.QUERIES["stream_micro_states"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    assert {e["type"] for e in got} == {"LOCK", "INIT_MICRO_STATE", "MICRO_STATE_CHANGE"}
    joins = [p for p in plans if "Join" in p]
    assert len(joins) >= 6 and not any("Broadcast" in p for p in joins)


def test_a_cache_of_entities_sends_no_frames_through_the_driver(spark, tmp_path):
    rows = [(i, [1.0 if i * x % 7 < 3 else -1.0 for x in range(64)], 1) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    text = plan_of(catalog.QUERIES["entity_cache"](spark, str(tmp_path)))
    assert "Join" in text and "Broadcast" not in text
