"""Similarity joins against brute force, and what they share."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import blocks, components, neardup, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pairs_of_units():
    starts, sides = np.array([0, 3, 7, 8]), np.array([0, 0, 0, 0, 0, 1, 1, 0])
    got = [p for i, j in blocks.pairs(starts, sides) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(got) == [(0, 1), (0, 2), (1, 2), (3, 5), (3, 6), (4, 5), (4, 6)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["item"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_posterior_limits_grow_and_keep_the_threshold():
    need = neardup.least_matches()
    assert need == sorted(need) and need[-1] < neardup.THRESHOLD * neardup.VALUES


def test_bands_follow_from_the_threshold():
    assert neardup.banding(0.8) == (32, 5) and neardup.banding(0.5)[1] == 2
    for t in (0.1, 0.3, 0.5, 0.6, 0.9, 0.97, 1.0):
        bands, rows = neardup.banding(t)
        assert bands * rows <= neardup.VALUES and (1 - t**rows) ** bands <= neardup.MISS
    with pytest.raises(ValueError):
        neardup.banding(0.01)


def test_near_duplicates_at_a_lower_threshold(spark):
    rng = random.Random(4)
    rows, sets = [], []
    for k in range(60):
        body = [f"w{k}_{i}" for i in range(100)]
        rows += [(2 * k, " ".join(body)), (2 * k + 1, " ".join(body[: rng.randrange(45, 75)] + [f"v{k}_{i}" for i in range(8)]))]
    for _, t in rows:
        w = t.split(" ")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    want = {k: int(any(j != k and len(a & b) >= 0.5 * len(a | b) for j, b in enumerate(sets))) for k, a in enumerate(sets)}
    got = {r["doc_id"]: r["n_links"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.5).collect()}
    assert got == want and 40 < sum(want.values()) < 120


def near_texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows, key = [], 0
    for _ in range(12):
        body = [word() for _ in range(rng.randrange(20, 90))]
        for _ in range(rng.randrange(1, 7)):
            own = list(body)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = word()
            rows.append((key, " ".join(own)))
            key += 1
    hot = [word() for _ in range(60)]
    for k in range(150):
        own = list(hot)
        own[k % 60] = word()
        rows.append((1000 + k, " ".join(own)))
    return rows + [(2000 + k, t) for k, t in enumerate([None, "", " \n", "one two", "one two", "one\ttwo", "a b c d e", "w " * 4000])] + [(None, "one two"), (3000, rows[0][1]), (3000, rows[0][1])]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks.units, "__defaults__", (64,))  # several blocks in the hot bucket
    rows = near_texts()
    sets = []
    for key, t in rows:
        w = WORD.findall(t or "")
        sets.append((key, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w and key is not None else set()))
    links, root = collections.Counter(), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(sets):
        r = find(i)
        least[r] = min(least.get(r, 1 << 60), key if key is not None else 1 << 60)
    want = sorted((str(k), links[i], str(least[find(i)] if k is not None else None)) for i, (k, _) in enumerate(sets))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit("x"))
    got = sorted((str(r["doc_id"]), r["n_links"], str(r["class_id"])) for r in neardup.near_duplicates(df).collect())
    assert got == want
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and kept.filter("doc_id between 1000 and 1999").count() == 1
    assert neardup.near_duplicates(df.filter("false")).count() == 0


def test_keep_one_decides_per_row(spark):
    a, y, z = ("".join(f" {c}{i}" for i in range(40)) for c in "ayz")
    rows = [(1, a), (1, a), (2, a + " more"), (5, a), (5, y), (5, y), (6, z), (7, ""), (7, ""), (8, y), (None, a), (None, a)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, set_d1 int")
    out = neardup.keep_one(df)
    assert out.columns == df.columns
    got = sorted(str((r["doc_id"], r["text"])) for r in out.collect())
    assert got == sorted(map(str, [(1, a), (5, y), (6, z), (7, ""), (7, ""), (None, a), (None, a)]))
    assert sorted(r["doc_id"] for r in neardup.keep_one(df.filter("doc_id in (2, 6, 8)")).collect()) == [2, 6, 8]


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks.units, "__defaults__", (64,))
    rng = np.random.default_rng(3)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(64)
        for _ in range(8 if c else 150):
            rows.append((centre + rng.standard_normal(64) * rng.choice([0.05, 0.2, 0.35])).astype(np.float32).tolist())
    rows = [(i, v) for i, v in enumerate(rows)]
    rows += [(5000, rows[0][1]), (5001, rows[0][1]), (5002, None), (5003, []), (5004, [0.0] * 64), (5005, [float("nan")] * 64), (5006, [None] + [1.0] * 63), (5007, [1.0] * 8), (5008, [1.0] * 8), (5009, [float("inf")] * 64), (None, rows[0][1])]
    good = [(k, np.array(v, np.float32).astype(float)) for k, v in rows if k is not None and v and None not in v and np.isfinite(np.array(v)).all() and any(v)]
    links, lab = collections.Counter(), {k: k for k, _ in good}
    changed = [(a, b) for i, (a, x) in enumerate(good) for b, y in good[:i] if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95]
    for a, b in changed:
        links[a] += 1
        links[b] += 1
    while any(lab[a] != lab[b] for a, b in changed):
        for a, b in changed:
            lab[a] = lab[b] = min(lab[a], lab[b])
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got)
    true = sum(links.values())
    assert 0.99 * true <= found <= true
    assert sum(r["n_links"] != links[r["vec_id"]] or r["component_id"] != lab.get(r["vec_id"], r["vec_id"]) for r in got) <= 0.02 * len(got)
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_windows_hold_each_pair_once():
    rng = np.random.default_rng(5)
    starts, place = np.array([0, 4, 4, 40, 41, 90]), rng.standard_normal(90)
    got = [tuple(sorted(p)) for i, j in vectors.windows(starts, place, 0.5) for p in zip(i.tolist(), j.tolist(), strict=True)]
    want = [(a, b) for s, e in zip(starts, starts[1:], strict=False) for a in range(s, e) for b in range(a + 1, e) if abs(place[a] - place[b]) <= 0.5]
    assert sorted(got) == sorted(want)


def test_vectors_in_double_precision(spark):
    """Pairs on both sides of the threshold that single precision can't tell, and components beyond its range."""
    near, far = 0.95 + 1e-12, 0.95 - 1e-12
    rows = [(1, [1.0, 0.0]), (2, [near, (1 - near * near) ** 0.5]), (3, [0.0, -1.0, 0.0]), (4, [0.0, -far, (1 - far * far) ** 0.5]), (5, [1e300, 1e300, 0.0, 1e10]), (6, [1e299, 1e299, 0.0, 0.0]), (7, [1e300])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7)}
