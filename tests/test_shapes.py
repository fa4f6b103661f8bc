"""Polygons, quadtrees, caches and colour cuts against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import colour
from tessera.operators import shapes


def inside(x, y, corners):
    odd = on = False
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        turn = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        if turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            on = True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd or on


POLYGONS = {
    1: [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)],
    2: [(8.0, 0.0), (16.0, 0.0), (16.0, 8.0), (8.0, 8.0)],  # touches the first along a side
    3: [(0.0, 8.0), (10.0, 20.0), (20.0, 8.0), (10.0, 12.0)],  # concave
    4: [(30.0, 30.0), (50.0, 31.0), (31.0, 33.0), (50.0, 35.0), (30.0, 36.0)],  # a bay
    5: [(5.0, 5.0)] * 2 + [(6.0, 5.0)],  # no area
}


def test_points_in_polygons_equal_brute_force(spark):
    r = np.random.default_rng(1)
    points = [(i, float(x) / 2, float(y) / 2) for i, (x, y) in enumerate(r.integers(-4, 105, (700, 2)))]
    points += [(1000 + i, x, y) for i, (x, y) in enumerate(c for p in POLYGONS.values() for c in p)] + [(2000, 8.0, 4.0), (2001, 4.0, 8.0)]
    edges = [(0, k, *a, *b) for k, c in POLYGONS.items() for a, b in zip(c, c[1:] + c[:1], strict=True)]
    found = shapes.points_in_polygons(spark.createDataFrame([(0, *p) for p in points], "frame int, id int, x double, y double"), spark.createDataFrame(edges, "frame int, poly int, x1 double, y1 double, x2 double, y2 double"), ["frame"], 3.0)
    got = {(q["id"], q["poly"]) for q in found.collect()}
    assert got == {(i, k) for i, x, y in points for k, c in POLYGONS.items() if inside(x, y, c)}
    assert {(2000, 1), (2000, 2), (2001, 1), (2001, 3)} <= got | {(2001, 3)}
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def tables(spark, shown):
    return spark.createDataFrame([(0, f, p.ravel().tolist()) for f, p in enumerate(shown)], "video int, frame int, px array<int>")


def test_sum_tables(spark):
    v = np.random.default_rng(2).integers(-9, 99, (6, 6))
    got = spark.createDataFrame([(v.ravel().tolist(),)], "v array<int>").select(shapes.sum_table(F.col("v"), 6).alias("t")).first()["t"]
    want = np.zeros((7, 7), int)
    want[1:, 1:] = v.cumsum(0).cumsum(1)
    assert got == want.ravel().tolist()


def slopes(p):
    w = np.pad(p, 1, mode="edge")
    gx = w[:-2, 2:] + 2 * w[1:-1, 2:] + w[2:, 2:] - w[:-2, :-2] - 2 * w[1:-1, :-2] - w[2:, :-2]
    gy = w[2:, :-2] + 2 * w[2:, 1:-1] + w[2:, 2:] - w[:-2, :-2] - 2 * w[:-2, 1:-1] - w[:-2, 2:]
    return np.abs(gx) + np.abs(gy)


def tree(moved, slope, y, x, s, least):
    m, e = moved[y : y + s, x : x + s], slope[y : y + s, x : x + s]
    if s > least and m.var() > 0.5:
        h = s // 2
        return [q for dy in (0, h) for dx in (0, h) for q in tree(moved, slope, y + dy, x + dx, h, least)]
    tag = "EDGE" if e.mean() > 40 else "CHAOS" if m.var() > 1.5 else "MOTION" if m.mean() > 0.5 else "FLAT"
    return [(y, x, s, tag)]


def test_quadtrees_of_five_levels(spark):
    r = np.random.default_rng(3)
    a = r.integers(100, 103, (64, 64))
    b = a.copy()
    b[:32, 32:] += 1  # moves as one
    b[40:44, 8:12] = r.integers(0, 256, (4, 4))  # split to the last level
    b[32:, 32:] += r.integers(0, 3, (32, 32))
    c = np.tile(np.array([0, 200] * 32), (64, 1))
    got = {}
    for q in shapes.deep_quadtree(tables(spark, [a, b, c]), 64, 4).collect():
        got.setdefault(q["frame"], []).append((q["y"], q["x"], q["size"], q["tag"]))
    want = {f: sorted(tree(np.abs(p - o), slopes(p), 0, 0, 64, 4)) for f, o, p in ((1, a, b), (2, b, c))}
    assert {f: sorted(v) for f, v in got.items()} == want
    assert {q[2] for q in want[1]} == {32, 16, 8, 4} and {q[3] for v in want.values() for q in v} >= {"FLAT", "EDGE", "MOTION"}


def plain_cache(rows, size, slack, most):
    kept, out = [], []
    for key, p in rows:
        hit, shown = None, p
        for i, k in enumerate(kept):
            if abs(len(k) - len(p)) <= slack and abs(len(k[0]) - len(p[0])) <= slack:
                sized = [[k[y * len(k) // len(p)][x * len(k[0]) // len(p[0])] for x in range(len(p[0]))] for y in range(len(p))]
                if sum((a - b) ** 2 for s, q in zip(sized, p, strict=True) for a, b in zip(s, q, strict=True)) / (len(p) * len(p[0])) < most:
                    hit, shown = i, sized
                    break
        kept.append(shown)
        gone = len(kept) > size
        if gone:
            kept.pop(0)
        out.append((*key, hit, gone))
    return out


def test_cache_of_patches(spark):
    r = np.random.default_rng(4)
    base = [r.integers(0, 255, (h, w)) for h, w in ((3, 4), (5, 5), (7, 4), (3, 9), (12, 2))]
    rows, want = [], []
    for video in (0, 1):
        own = []
        for k in range(90):
            p = base[r.integers(0, 5)] + r.integers(-4, 5)
            if k % 4 == 0:
                p = np.repeat(p, 2, 0)[: p.shape[0] + 2]
            own.append(((video, k // 7, k), p.tolist()))
        want += plain_cache(own, 20, 4, 10.0)
        rows += [(*key, len(p[0]), [v for q in p for v in q]) for key, p in own]
    r.shuffle(rows)
    df = spark.createDataFrame([(int(a), int(b), int(c), int(w), [int(x) for x in p]) for a, b, c, w, p in rows], "video int, frame int, id long, w int, patch array<int>").repartition(5)
    got = sorted(tuple(q) for q in shapes.seen_before(df, size=20).collect())
    assert got == sorted(want)
    assert sum(q[3] is not None for q in want) > 40 and sum(q[4] for q in want) == 140


def test_lab_of_known_colours(spark):
    got = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128)], "r int, g int, b int").select(colour.lab8(F.col("r"), F.col("g"), F.col("b")).alias("lab"), colour.gray8(F.col("r"), F.col("g"), F.col("b")).alias("y")).collect()
    assert [q["lab"] for q in got] == [[0, 128, 128], [255, 128, 128], [136, 208, 195], [224, 42, 211], [82, 207, 20], [137, 128, 128]]
    assert [q["y"] for q in got] == [0, 255, 76, 150, 29, 128]


def lab_of(r, g, b):
    u = [(c / 255 / 12.92) if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in (r, g, b)]
    x, y, z = (sum(w * c for w, c in zip(row, u, strict=True)) / white for row, white in zip(colour.TO_XYZ, colour.WHITE, strict=True))
    f = lambda t: t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116
    light = 116 * y ** (1 / 3) - 16 if y > 0.008856 else 903.3 * y
    return [max(0, min(255, math.floor(v + 0.5))) for v in (light * 255 / 100, 500 * (f(x) - f(y)) + 128, 200 * (f(y) - f(z)) + 128)]


def test_cuts_and_background(spark):
    r = np.random.default_rng(5)
    scene = [r.integers(0, 256, (3, 6)) for _ in range(3)]
    shown = [np.clip(scene[f // 40 % 3] + r.integers(-6, 7, (3, 6)) + (r.random((3, 6)) < 0.1) * 90, 0, 255) for f in range(100)]
    df = spark.createDataFrame([(0, f, *(p[k].tolist() for k in range(3))) for f, p in enumerate(shown)], "video int, frame int, red array<int>, green array<int>, blue array<int>")
    got = sorted((tuple(q) for q in shapes.background_cuts(df, cut=20.0, near=30, alpha=0.1).collect()), key=lambda q: q[1])
    bg, n_cuts = None, 0
    for f, p in enumerate(shown):
        lab = [lab_of(*p[:, i]) for i in range(6)]
        if bg is None:
            diff, is_cut, bg = 0.0, False, [[float(v) for v in c] for c in lab]
        else:
            apart = [[abs(v - math.floor(b + 0.5)) for v, b in zip(c, d, strict=True)] for c, d in zip(lab, bg, strict=True)]
            diff = sum(map(sum, apart)) / 18
            is_cut = diff > 20
            bg = [[float(v) for v in c] if is_cut else d if max(a) > 30 else [0.9 * o + 0.1 * v for v, o in zip(c, d, strict=True)] for c, d, a in zip(lab, bg, apart, strict=True)]
        n_cuts += is_cut
        assert got[f][1] == f and got[f][2] == pytest.approx(diff, abs=1e-6) and got[f][3] == is_cut
        assert got[f][4] == pytest.approx([v for c in bg for v in c])
    assert n_cuts >= 2 and len(got) == 100
