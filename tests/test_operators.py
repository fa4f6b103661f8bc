"""Operators on small hand-made rows: ties, gaps, folds, round trips."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import scalars as fn
from tessera.operators import blocks as bl
from tessera.operators import motion, reports, signal, tracking, windows
from tessera.sources import clips, container, relations
from tessera.streaming import state

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rounding_and_division(spark):
    assert [one(spark, fn.quantize(F.lit(d), 2)) for d in (1, 3, 5, -1, -3)] == [0, 2, 2, 0, -2]
    assert [one(spark, fn.floor_div(F.lit(a), 4)) for a in (-7, 7)] == [-2, 1]
    assert one(spark, fn.psnr(F.lit(0.0))) == float("inf") and abs(one(spark, fn.psnr(F.lit(65025.0)))) < 1e-12
    assert one(spark, fn.reduction(F.lit(5), F.lit(0))) is None


def test_pack_two_bits(spark):
    codes = F.array(*map(F.lit, [1, 2, 3, 0, 3, 3, 0, 1]))
    assert one(spark, fn.pack2(codes)) == [108, 241]
    assert one(spark, fn.unpack2(fn.pack2(codes))) == [1, 2, 3, 0, 3, 3, 0, 1]


def test_runs_and_sessions(spark):
    df = spark.createDataFrame([("a", i, i not in (2, 5)) for i in range(8)], "k string, t int, ok boolean")
    got = sorted(tuple(r) for r in windows.runs_of(df, ["k"], "t", F.col("ok")).select("start", "length").collect())
    assert got == [(0, 2), (3, 2), (6, 2)]
    held = df.filter("t in (0, 1, 7)")
    assert sorted((r["first"], r["last"], r["n"]) for r in windows.sessions(held, ["k"], "t", 5).collect()) == [(0, 1, 2), (7, 7, 1)]


def test_worst_mean_fallbacks(spark):
    df = spark.createDataFrame([("few", 0, 2.0), ("few", 1, 4.0)] + [("many", i, float(i)) for i in range(7)], "k string, t int, v double")
    assert {r["k"]: r["worst"] for r in windows.worst_mean(df, ["k"], "t", "v").collect()} == {"few": 4.0, "many": 4.0}
    assert {r["k"]: r["worst"] for r in windows.worst_mean(df, ["k"], "t", "v", fallback="mean").collect()} == {"few": 3.0, "many": 4.0}
    with pytest.raises(ValueError):
        windows.worst_mean(df, ["k"], "t", "v", fallback="none")


def test_masked_mean(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([10.0, 11.0, 90.0, 12.0])], "k int, t int, v double")
    assert windows.ema(df, ["k"], "t", "v", alpha=0.5).first()["background"] == 10.5


def test_residual_stays_within_half_a_step(spark):
    df = spark.createDataFrame([([i * 16 % 256 for i in range(16)], [200 - i for i in range(16)])], "px array<int>, prev array<int>")
    r = bl.residual(bl.stats(df), 27).first()
    assert all(abs(a - b) <= 13.5 for a, b in zip(r["px"], r["recon"], strict=True))


def test_cascade_keeps_earlier_of_equals_and_skips(spark):
    same = [5] * 16
    df = spark.createDataFrame([(same, same), ([7] * 8 + [200] * 8, [0] * 16), (same, None)], "px array<int>, prev array<int>")
    assert [r["m"] for r in bl.cascade(bl.candidates(df)).select(F.col("best.mode").alias("m")).collect()] == ["skip", "palette", "solid"]


def test_motion_finds_a_shifted_square(spark):
    rows = [(0, f, [200 if 2 + f <= x < 4 + f and 2 <= y < 4 else 10 for y in range(8) for x in range(8)]) for f in range(2)]
    frames = spark.createDataFrame(rows, "video int, frame int, px array<int>")
    found = motion.search(frames, 4, 2, 8).collect()
    assert {(r["by"], r["bx"]): (r["dy"], r["dx"], r["ssd"]) for r in found}[0, 1] == (0, 1, 0)
    assert {(r["by"], r["bx"]): (r["dy"], r["dx"], r["correlation"]) for r in motion.correlated(frames, 4, 2, 8).collect()}[0, 1] == (0, 1, 1.0)


def test_reports(spark):
    cfg = spark.createDataFrame([("+a -b +c",)], "config string")
    r = cfg.select(reports.toggles_of(F.col("config")).alias("m"), reports.short_name(F.col("config")).alias("s"), reports.matches(F.col("config"), ["-b"]).alias("hit")).first()
    assert r["m"] == {"a": True, "b": False, "c": True} and r["s"] == "a+c" and r["hit"]
    tasks = spark.createDataFrame([(1,), (2,)], "k int")
    assert [x["k"] for x in reports.pending(tasks, tasks.filter("k = 1"), ["k"]).collect()] == [2]


def test_spread_covers_every_trial(spark):
    rates = {1: [1.0, 2.0, 4.0, 8.0, 16.0, 32.0], 2: [5.5]}
    df = spark.createDataFrame([(k, v) for k, vs in rates.items() for v in vs], "perm long, rate double")
    got = {r["perm"]: (r["n"], r["mean_fps"], r["sd_fps"]) for r in reports.trial_spread(df, ["perm"], F.col("rate")).collect()}
    assert got == {k: (len(v), round(float(np.mean(v)), 3), round(float(np.std(v)), 3)) for k, v in rates.items()}


def test_all_trials_of_the_log_are_averaged(spark):
    log = relations.runs(spark, SF).selectExpr("perm", "frames", "time_s").toPandas()
    log["c"] = np.floor(log.frames / np.maximum(log.time_s, 0.001) * 100) / 100
    want = {k: (len(c), c.mean(), c.std(ddof=0)) for k, c in log.groupby("perm").c}
    got = {r["perm"]: (r["n"], r["mean_fps"], r["sd_fps"]) for r in catalog.QUERIES["trial_mean_std_all"](spark, SF).collect()}
    assert sum(n for n, _, _ in got.values()) == len(log) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)


def test_objects_spawn_move_despawn():
    t = tracking.Tracker(within=5.0, patience=1)
    assert t.step(0, [(1.0, 1.0, 0, 0)]) == [(0, "SPAWN", 0, 0)]
    assert t.step(1, [(2.0, 1.0, 1, 0)]) == [(0, "MOVE", 1, 0)]
    assert t.step(2, []) == []
    assert t.step(3, []) == [(0, "DESPAWN", 1, 0)]


def test_components_of_eight_neighbours(spark):
    px = [(0, 0, 0), (0, 1, 1), (0, 5, 5), (0, 5, 6)]
    df = spark.createDataFrame([(0, f, y, x) for f, y, x in px], "video int, frame int, y int, x int")
    assert sorted((r["component"], r["area"]) for r in tracking.components(df, 8).collect()) == [(0, 2), (45, 2)]


def test_coded_frames_come_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(v, f, rng.integers(0, 256, 64).tolist()) for v in range(3) for f in range(0, 70 + v)]
    container.deltas(spark.createDataFrame(rows, "video int, frame int, px array<int>").repartition(5)).write.parquet(str(tmp_path / "c"))
    back = container.restored(spark.read.parquet(str(tmp_path / "c")))
    assert sorted((r["video"], r["frame"], r["px"]) for r in back.collect()) == rows
    assert container.restored(spark.read.parquet(str(tmp_path / "c")).filter("false")).count() == 0


def test_folder_scan(spark, tmp_path):
    for n in ("a.vid", "b_5f.vid", "c.txt"):
        (tmp_path / n).write_bytes(b"xx")
    assert [r["length"] for r in container.scan_folder(spark, str(tmp_path), ".vid", "_5f").collect()] == [2]


@pytest.mark.parametrize("name", clips.NAMES)
def test_clips_are_levels(spark, name):
    r = clips.clip(spark, name, 2, 480, 640).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    assert r["n"] == 2 * 480 * 640 and r["lo"] >= 0 and r["hi"] <= 255


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = lambda a, z: spark.createDataFrame([(0, i, 10 + i % 3) for i in range(a, z)], "cell long, frame int, v int")
    src, out, keep = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows(0, 5).write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema("cell long, frame int, v int").parquet(src)
        state.run_in_batches(state.stream_ema(stream), out, keep)
        rows(5, 9).write.mode("append").parquet(src)
    got = spark.read.parquet(out).agg(F.max_by("background", "frame").alias("b"), F.count("*").alias("n")).first()
    assert got["n"] == 9
    assert abs(got["b"] - windows.ema(rows(0, 9), ["cell"], "frame", "v").first()["background"]) < 1e-9


def closed_loop(px_of_frames):
    """(mode, bytes, sse) of one block's series, in plain Python."""
    decoded = background = None
    for now in px_of_frames:
        n = len(now)
        sad = lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True))
        ssd = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        far = lambda a, b: max(abs(x - y) for x, y in zip(a, b, strict=True))
        if decoded is None or sad(now, decoded) > 35 * n:
            yield "key", n, 0
            decoded, background = now, [float(v) for v in now]
            continue
        if far(now, decoded) < 4:
            mode, size, got = "skip", 0, decoded
        else:
            back = [int(v) for v in background]
            q = [round((a - b) / 27) for a, b in zip(now, decoded, strict=True)]
            coded = [max(0, min(255, b + 27 * x)) for b, x in zip(decoded, q, strict=True)]
            level = [sum(now) // n] * n
            nnz = sum(x != 0 for x in q)
            size = 1 + 2 * nnz if 2 * nnz < n else 1 + n
            options = [(n + 1 + 0.012 * sad(now, decoded), 0, "raw", n + 1, now)]
            if sad(now, back) < 6 * n and ssd(now, back) < 40 * n and far(now, back) < 14:
                options.append((1 + 0.012 * sad(now, back), 1, "background", 1, back))
            if max(now) - min(now) < 10:
                options.append((2 + 0.012 * sad(now, level), 2, "solid", 2, level))
            options.append((size + 0.012 * sad(now, coded), 3, "residual", size, coded))
            _, _, mode, size, got = min(options)
        yield mode, size, ssd(now, got)
        background = [0.95 * b + 0.05 * g if abs(g - d) < 2 and abs(g - b) < 4 else b for g, d, b in zip(got, decoded, background, strict=True)]
        decoded = got


def test_closed_loop_equals_plain_python(spark):
    from tessera.operators import folds

    rng = np.random.default_rng(1)
    rows, frame = [], rng.integers(60, 200, 64)
    for k in range(60):
        step = (0, 3, 6, 12, 30)[k % 5]
        frame = np.clip(frame + rng.integers(-step, step + 1, 64), 0, 255)
        if k % 13 == 0:
            frame = rng.integers(0, 256, 64)
        if k % 7 == 0:
            frame = np.full(64, 90 + k % 3)
        if k % 7 == 1:
            frame = np.full(64, 110)
        rows.append((0, k, frame.tolist()))
    got = {}
    for r in folds.closed_loop(spark.createDataFrame(rows, "video int, frame int, px array<int>"), 8, 4).orderBy("frame").collect():
        got.setdefault((r["by"], r["bx"]), []).append((r["mode"], r["bytes"], r["sse"]))
    for (by, bx), log in got.items():
        series = [[px[(by * 4 + i // 4) * 8 + bx * 4 + i % 4] for i in range(16)] for _, _, px in rows]
        assert log == list(closed_loop(series))
    assert {m for log in got.values() for m, _, _ in log} >= {"key", "skip", "solid", "residual"}


def test_closed_loop_query_equals_plain_python(spark):
    want = {}
    videos = {}
    for r in relations.frames(spark, SF).collect():
        videos.setdefault(r["video"], []).append((r["frame"], list(r["px"])))
    for v, held in videos.items():
        for by in range(2):
            for bx in range(2):
                for mode, size, sse in closed_loop([[px[(by * 4 + i // 4) * 8 + bx * 4 + i % 4] for i in range(16)] for _, px in sorted(held)]):
                    n = want.setdefault((v, mode), [0, 0, 0])
                    n[0], n[1], n[2] = n[0] + 1, n[1] + size, n[2] + sse
    got = {(r["video"], r["mode"]): [r["n"], r["bytes"], r["sse"]] for r in catalog.QUERIES["closed_loop_coding"](spark, SF).collect()}
    assert got == want


def regions_of(spark):
    """Frames to lists of (place, x, y, w, h, cx, cy) of the 8-connected regions of two pixels or more above 150, by flood fill."""
    out = {}
    for r in relations.frames(spark, SF).collect():
        left, found = {i for i, v in enumerate(r["px"]) if v > 150}, []
        while left:
            todo, region = [min(left)], []
            left.discard(todo[0])
            while todo:
                at = todo.pop()
                region.append(at)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        y, x = at // 8 + dy, at % 8 + dx
                        if 0 <= y < 8 and 0 <= x < 8 and y * 8 + x in left:
                            left.discard(y * 8 + x)
                            todo.append(y * 8 + x)
            if len(region) >= 2:
                ys, xs = [i // 8 for i in region], [i % 8 for i in region]
                found.append((min(region), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, round(sum(xs) / len(xs), 6), round(sum(ys) / len(ys), 6)))
        if found:
            out[r["video"], r["frame"]] = sorted(found)
    return out


def nearest_pairs(a, b):
    """One-to-one pairs of points within 5, nearest first: each round takes the nearest pair of those left."""
    a, b, out = dict(enumerate(a)), dict(enumerate(b)), []
    while True:
        left = [(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5, i, j) for i, p in a.items() for j, q in b.items()]
        left = [x for x in left if x[0] < 5]
        if not left:
            return out
        _, i, j = min(left)
        out.append((i, j))
        del a[i], b[j]


def test_greedy_match_equals_plain_python(spark):
    regions = regions_of(spark)
    want = []
    for (v, f), now in regions.items():
        then = regions.get((v, f - 1), [])
        want += [(v, f, now[i][0], then[j][0]) for i, j in nearest_pairs([r[5:] for r in now], [r[5:] for r in then])]
    got = [tuple(r) for r in catalog.QUERIES["greedy_match"](spark, SF).select("video", "frame", "blob", "then_blob").collect()]
    assert sorted(got) == sorted(want) and got


def expected_events(spark, cuts=()):
    regions, out = regions_of(spark), []
    for v in sorted({v for v, _ in regions} | {v for v, _ in cuts}):
        objects, n = {}, 0
        for f in sorted({f for w, f in regions if w == v} | {f for w, f in cuts if w == v}):
            if (v, f) in cuts:
                out += [(v, f, i, "DESPAWN", o[2], o[3]) for i, o in objects.items()]
                objects = {}
                continue
            now = regions[v, f]
            ids = sorted(objects)
            pairs = nearest_pairs([r[5:] for r in now], [objects[i][:2] for i in ids])
            matched = {i: ids[j] for i, j in pairs}
            for i, r in enumerate(now):
                if i in matched:
                    o = objects[matched[i]]
                    if (r[1], r[2]) != (o[2], o[3]):
                        out.append((v, f, matched[i], "MOVE", r[1] - o[2], r[2] - o[3]))
                    objects[matched[i]] = (r[5], r[6], r[1], r[2], f)
            for i, r in enumerate(now):
                if i not in matched:
                    objects[n] = (r[5], r[6], r[1], r[2], f)
                    out.append((v, f, n, "SPAWN", r[1], r[2]))
                    n += 1
            for i in [i for i, o in objects.items() if f - o[4] > 2]:
                o = objects.pop(i)
                out.append((v, f, i, "DESPAWN", o[2], o[3]))
    return sorted(out)


def test_object_queries_equal_plain_python(spark):
    want = expected_events(spark)
    got = sorted(tuple(r) for r in catalog.QUERIES["object_events"](spark, SF).select("video", "frame", "obj_id", "type", "x", "y").collect())
    assert got == want
    size = {"SPAWN": 15, "DESPAWN": 1, "MOVE": 3}
    counts, lives = {}, {}
    for v, f, i, kind, _, _ in want:
        n = counts.setdefault((v, kind), [0, 0])
        n[0], n[1] = n[0] + 1, n[1] + size[kind]
        life = lives.setdefault((v, i), [f, f, 0, 0])
        life[:] = [min(life[0], f), max(life[1], f), life[2] + (kind == "MOVE"), life[3] + size[kind]]
    assert {(r["video"], r["type"]): [r["n"], r["payload"]] for r in catalog.QUERIES["event_counts"](spark, SF).collect()} == counts
    for r in catalog.QUERIES["object_lifetimes"](spark, SF).collect():
        first, last, moves, payload = lives[r["video"], r["obj_id"]]
        assert (r["first"], r["last"], r["moves"], r["payload"], r["frames_alive"]) == (first, last, moves, payload, last - first + 1)
        assert r["saved_percent"] == pytest.approx(100 - 100 * payload / (15 * (last - first + 1)), abs=1e-3)
    streamed = sorted((r["video"], r["frame"], r["obj_id"], r["type"], r["x"], r["y"]) for r in catalog.QUERIES["stream_object_events"](spark, SF).collect())
    assert streamed == want


def test_scene_cuts_end_all_objects(spark):
    before, cuts = {}, set()
    for r in sorted(relations.frames(spark, SF).collect(), key=lambda r: (r["video"], r["frame"])):
        then = before.get(r["video"])
        if then is not None and sum(abs(a - b) for a, b in zip(r["px"], then, strict=True)) > 18 * 64:
            cuts.add((r["video"], r["frame"]))
        before[r["video"]] = r["px"]
    got = sorted((r["video"], r["frame"], r["obj_id"], r["type"], r["x"], r["y"]) for r in catalog.QUERIES["stream_scene_objects"](spark, SF).collect())
    assert cuts and got == expected_events(spark, cuts)


def test_sixteen_levels_equal_plain_python(spark):
    count = {}
    for r in relations.frames(spark, SF).collect():
        for v in r["px"]:
            count[v] = count.get(v, 0) + 1
    centres = [255.0 * i / 15 for i in range(16)]
    own = lambda v: min(range(16), key=lambda k: (abs(v - centres[k]), k))
    for _ in range(10):
        groups = [[(v, n) for v, n in count.items() if own(v) == k] for k in range(16)]
        centres = [sum(v * n for v, n in g) / sum(n for _, n in g) if g else c for g, c in zip(groups, centres, strict=True)]
    got = {r["k"]: (r["centre"], r["n"]) for r in catalog.QUERIES["sixteen_levels"](spark, SF).collect()}
    assert got == {k: (round(centres[k], 6), sum(n for v, n in count.items() if own(v) == k)) for k in range(16)}


def test_four_means_equal_plain_python(spark):
    blocks = {(r["video"], r["frame"], r["by"], r["bx"]): r["px"] for r in relations.blocks(spark, SF).collect()}
    got = {(r["video"], r["frame"], r["by"], r["bx"]): (r["centres"], r["sse"]) for r in catalog.QUERIES["four_means_blocks"](spark, SF).collect()}
    assert got.keys() == blocks.keys()
    for key, px in blocks.items():
        s = sorted(px)
        c = []
        for share in (0.125, 0.375, 0.625, 0.875):  # linear between the two places that a quantile lies between
            at = share * (len(s) - 1)
            c.append(s[int(at)] + (at - int(at)) * (s[min(int(at) + 1, len(s) - 1)] - s[int(at)]))
        for _ in range(8):
            groups = [[] for _ in c]
            for v in px:
                groups[min(range(4), key=lambda k: (abs(v - c[k]), k))].append(v)  # noqa: B023
            c = [sum(g) / len(g) if g else old for g, old in zip(groups, c, strict=True)]
        c = sorted(int(x) for x in c)
        assert got[key] == (",".join(map(str, c)), sum(min(abs(v - k) for k in c) ** 2 for v in px))


def test_ranges_do_not_show(spark, monkeypatch):
    """Segments and morphology give the same whatever the ranges they are cut into, hot keys and gaps over ranges included."""
    rng = np.random.default_rng(3)
    rows = [(k, int(p), int(rng.integers(0, 256))) for k in range(3) for p in sorted(rng.choice(400, 60 + 90 * k, replace=False))]
    df = spark.createDataFrame(rows, "k int, place long, v int")
    want = {}
    for size in (1 << 20, 7, 1):
        monkeypatch.setattr(signal, "RANGE", size)
        got = (sorted(map(tuple, signal.segments(df, ["k"], "place", 1, 2, 1.6).collect())), sorted(map(tuple, signal.open_close(df, ["k"], "place", "v").select("k", "place", "v", "dil", "opened", "closed").collect())))
        assert want.setdefault("all", got) == got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=6, max_size=6), min_size=1, max_size=6))
def test_boxes_cover_each_cell_once(grid):
    from tessera.operators import folds

    grid = np.array(grid)
    seen = np.zeros(grid.shape, int)
    for y, x, h, w in folds.boxes_of_equal_modes(grid):
        assert (grid[y : y + h, x : x + w] == grid[y, x]).all()
        seen[y : y + h, x : x + w] += 1
    assert (seen == 1).all()
