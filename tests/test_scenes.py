"""Operators on frames of real size against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import graph, regions


def components_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_roots_of_many_graphs(spark):
    rng = random.Random(2)
    edges = [(g, rng.randrange(40), rng.randrange(40)) for g in range(3) for _ in range(25)] + [(7, i, i + 1) for i in range(50)] + [(8, 0, i) for i in range(1, 30)]
    got = {(r["g"], r["item"]): r["root"] for r in graph.roots(spark.createDataFrame(edges, "g int, a long, b long"), ["g"]).collect()}
    want = {}
    for g in {e[0] for e in edges}:
        own = [(a, b) for h, a, b in edges if h == g]
        want |= {(g, n): r for n, r in components_of({x for e in own for x in e}, own).items() if n != r}
    assert got == want
    assert graph.roots(spark.createDataFrame([], "g int, a long, b long"), ["g"]).collect() == []


def frame_rows(spark, masks):
    return spark.createDataFrame([(0, i, [int(v) * 255 for v in m.ravel()]) for i, m in enumerate(masks)], "video int, frame int, px array<int>")


def brute_regions(mask):
    h, w = mask.shape
    nodes = [y * w + x for y in range(h) for x in range(w) if mask[y, x]]
    edges = [(n, m) for n in nodes for dy in (-1, 0, 1) for dx in (-1, 0, 1) for y, x in [(n // w + dy, n % w + dx)] if (dy or dx) and 0 <= y < h and 0 <= x < w and mask[y, x] for m in [y * w + x]]
    out = {}
    for r in components_of(nodes, edges).values():
        out[r] = out.get(r, 0) + 1
    return out


def test_regions_cross_tiles(spark):
    rng = np.random.default_rng(3)
    cross = np.zeros((32, 32), bool)
    cross[15:17, :] = cross[:, 15:17] = True  # over all four tiles
    snake = np.zeros((32, 32), bool)
    snake[::2] = True
    for k, y in enumerate(range(1, 31, 2)):
        snake[y, 31 if k % 2 == 0 else 0] = True
    corners = np.zeros((32, 32), bool)
    corners[15, 15] = corners[16, 16] = corners[15, 20] = corners[16, 19] = True  # only diagonals cross the border
    masks = [cross, snake, corners, np.zeros((32, 32), bool), *(rng.random((32, 32)) < p for p in (0.2, 0.35, 0.5, 0.9))]
    got = {}
    for r in regions.mask_regions(frame_rows(spark, masks), 32, 16, 100).collect():
        got.setdefault(r["frame"], {})[r["region"]] = r["area"]
    assert got == {i: brute_regions(m) for i, m in enumerate(masks) if m.any()}
    assert len(got[0]) == len(got[1]) == 1 and len(got[2]) == 2


def test_regions_need_equal_histories(spark):
    """A band of blocks that moved alike crosses two tiles; a vector that differs by two, another mode or too little activity parts them."""
    rows = []
    for f in range(10):
        for y in range(4):
            for x in range(4):
                mode, dy, dx = (4, -1, 0) if y < 2 else (0, 0, 0)
                if (y, x) == (0, 3):
                    dy = -5 if f == 5 else -1  # once too far off
                if (y, x) == (1, 3):
                    dy = -2  # one off throughout: still alike
                if (y, x) == (1, 0) and f == 9:
                    mode = 1
                if y == 3 and f < 3:
                    mode = 4  # three active frames aren't enough
                rows.append((0, f, y, x, mode, dy, dx))
    df = spark.createDataFrame(rows, "video int, frame int, by int, bx int, mode int, dy int, dx int")
    got = [tuple(r) for r in regions.history_regions(df, 4, 2).collect()]
    assert got == [(0, 9, 1, 6)]  # (0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (1, 3)


def test_moves_of_blocks(spark):
    rng = np.random.default_rng(4)
    first = rng.integers(0, 256, (16, 16))
    second = np.roll(first, -4, 0)  # what was four below is here
    second[12:] = first[12:]
    got = {(r["by"], r["bx"]): (r["mode"], r["dy"], r["dx"]) for r in regions.block_moves(spark.createDataFrame([(0, 0, first.ravel().tolist()), (0, 1, second.ravel().tolist())], "video int, frame int, px array<int>"), 16, 4, 4).collect()}
    assert len(got) == 16 and all(got[y, x] == ((4, -4, 0) if y < 3 else (0, 0, 0)) for y, x in got)


@pytest.mark.parametrize("steps", [regions.FOUR, regions.EIGHT])
def test_label_stack(steps):
    rng = np.random.default_rng(5)
    mask = rng.random((20, 8, 8)) < 0.5
    what = np.zeros((20, 8, 8, 1), np.int32)
    lab = regions.label_stack(mask, what, steps, lambda a, b: np.ones(a.shape[:-1], bool))
    for m, got in zip(mask, lab, strict=True):
        nodes = [int(n) for n in np.flatnonzero(m.ravel())]
        edges = [(n, (n // 8 + dy) * 8 + n % 8 + dx) for n in nodes for dy, dx in steps if n // 8 + dy < 8 and 0 <= n % 8 + dx < 8 and m[n // 8 + dy, n % 8 + dx]]
        want = components_of(nodes, edges)
        assert all(got.ravel()[n] == want[n] for n in nodes) and (got[~m] == 64).all()


@pytest.mark.parametrize("tile", [8, 16, 64, 1024])
def test_tiles_are_labelled_in_bounded_stacks(tile):
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["i"]) for n in (5000, 0, 3)]
    got = list(regions.stacks(iter(batches), tile))
    assert all(b.num_rows == 1 or b.num_rows * tile * tile <= regions.PLACES for b in got)
    assert [v for b in got for v in b.column(0).to_pylist()] == [*range(5000), *range(3)]


def test_a_frame_of_one_tile_needs_no_shuffle(spark):
    rng = np.random.default_rng(6)
    masks = [rng.random((32, 32)) < p for p in (0.0, 0.2, 0.45, 1.0)]
    found = regions.mask_regions(frame_rows(spark, masks), 32, 32, 100)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r)[1:] for r in found.collect()]
    assert sorted(rows) == sorted(tuple(r)[1:] for r in regions.mask_regions(frame_rows(spark, masks), 32, 16, 100).collect())
    assert len(rows) == sum(len(brute_regions(m)) for m in masks)
