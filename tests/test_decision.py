"""The mode decision with vectors and the gated boxes against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import blocks as bl
from tessera.operators import decision

SIDE, B = 32, 8
GATES = bl.Gates(dither=18.75, dense=20)
R, AREA = GATES.rate, B * B


def even(x):
    return np.rint(x / GATES.step).astype(int)


def plain(px, prev, plate, ui=False, m=decision.MotionGates()):
    """(by, bx, mode, bytes, dy, dx, shift) of the blocks of one frame."""
    out, last = [], (0, 0)
    at = lambda f, y, x: f[y : y + B, x : x + B]
    for y in range(0, SIDE, B):
        for x in range(0, SIDE, B):
            now, then, back = at(px, y, x), at(prev, y, x), at(plate, y, x)
            sad = np.abs(now - then).sum()
            if np.abs(now - then).max() < 4:
                out.append((y // B, x // B, "skip", 0, 0, 0, 0))
                continue
            best = (AREA + 1 + R * sad, AREA + 1, "raw", 0, 0, 0)

            def offer(cost, size, mode, dy=0, dx=0, shift=0, ok=True):
                nonlocal best
                if ok and cost < best[0]:
                    best = (cost, size, mode, dy, dx, shift)
                    return True
                return False

            e = np.abs(now - back)
            offer(1 + R * e.sum(), 1, "background", ok=e.sum() < 6 * AREA and (e * e).sum() < 40 * AREA and e.max() < 14)
            rng, level = now.max() - now.min(), now.sum() // AREA
            flat = np.abs(now - level).sum()
            if rng <= 2 and flat <= AREA / 8:
                offer(1.5, 1, "solid")
            elif rng < 10:
                offer(2 + R * flat, 2, "solid")
            colours = np.unique(now)
            if best[0] > 10 and rng > 2 and len(colours) <= 4:
                offer(1 + len(colours) + AREA / 4, 1 + len(colours) + AREA // 4, "palette")
            if best[0] > 10 and len(colours) > 4 and rng > 15:
                high = now > (now.min() + now.max()) // 2
                e = np.abs(now - np.where(high, now[high].sum() // high.sum(), now[~high].sum() // (~high).sum()))
                offer(3 + AREA / 4 + R * e.sum(), 3 + AREA // 4, "palette", ok=e.max() < 8 and (e * e).sum() < 16 * AREA)
            found = None
            inside = lambda v: max(0, min(SIDE - B, v))
            if 2 * sad > AREA and best[0] > m.motion_above and (not ui or best[2] != "palette" or best[0] > 70 - 64 + AREA / 4):
                py, qx = inside(y - last[0]), inside(x - last[1])
                e = np.abs(now - at(prev, py, qx))
                if e.sum() < m.mean * AREA and (e * e).sum() < m.square * AREA and e.max() < m.largest:
                    offer(1 + R * e.sum(), 1, "predicted", *last)
                else:
                    tried = [(((now - at(prev, a, b)) ** 2).sum(), a, b) for a in range(max(0, py - m.reach), min(SIDE - B, py + m.reach) + 1) for b in range(max(0, qx - m.reach), min(SIDE - B, qx + m.reach) + 1)]
                    ssd, a, b = min(tried)
                    e, found = np.abs(now - at(prev, a, b)), (y - a, x - b)
                    offer(3 + R * e.sum(), 3, "searched", *found, ok=ssd < m.searched * AREA and e.max() < m.largest)
            if best[0] > m.fade_above:
                for v in ([found] if found else []) + [best[3:5], last]:
                    c = at(prev, inside(y - v[0]), inside(x - v[1]))
                    shift = int(now.sum() / AREA - c.sum() / AREA)
                    e = np.abs(now - np.clip(c + shift, 0, 255))
                    if offer(4 + R * e.sum(), 4, "faded", *v, shift, ok=(e * e).sum() < m.faded * AREA and abs(shift) <= m.shift and (not ui or e.max() < 35)):
                        break
            if best[0] > GATES.dither and rng > 20:
                levels = np.array([now.min() + i * rng // 3 for i in range(4)])
                e = np.abs(now[..., None] - levels).min(-1)
                offer(5 + AREA / 4 + R * e.sum(), 5 + AREA // 4, "dither")
            if best[0] > GATES.residual:
                q = even(now - then)
                e = np.abs(now - np.clip(then + q * GATES.step, 0, 255))
                nnz = int((q != 0).sum())
                size = GATES.dense if 2 * nnz >= AREA else 1 + 2 * nnz
                offer(size + R * e.sum(), int(size), "residual", ok=not (best[2] == "palette" and e.max() >= 8))
            if best[2] in ("predicted", "searched", "faded"):
                last = best[3:5]
            out.append((y // B, x // B, best[2], best[1], *map(int, best[3:])))
    return out


def video(seed=1, n=14):
    """A texture that moves, fades and jumps over parts that stand still or are of few levels."""
    r = np.random.default_rng(seed)
    big = np.repeat(np.repeat(r.integers(60, 200, (20, 20)), 4, 0), 4, 1) + r.integers(-3, 4, (80, 80))
    out, y, x = [], 20, 20
    for f in range(n):
        y, x = y + (f % 3), x - (f % 2) * 2
        px = big[y : y + SIDE, x : x + SIDE].copy()
        px[:8] = 100 + r.integers(0, 2 if f % 2 else 30, (8, SIDE))
        px[8:16, :8] = r.choice([20, 90, 200], (8, 8))
        px[16:24, :8] = big[:8, :8] + r.integers(0, 3, (8, 8))
        if f % 4 == 3:
            px[24:] += 15
        px[:8, 24:] = np.arange(64).reshape(8, 8) * 3 + 20 + r.integers(0, 2, (8, 8)) if f % 5 != 2 else r.integers(0, 256, (8, 8))  # what was hidden shows again
        if f == 9:
            px = r.integers(0, 256, (SIDE, SIDE))
        if f == 11:
            px[8:, 8:] = r.choice([40, 42, 44, 47, 200, 203, 205], (SIDE - 8, SIDE - 8))
        out.append(np.clip(px, 0, 255))
    return out


def tables(spark, shown):
    return spark.createDataFrame([(0, f, p.ravel().tolist()) for f, p in enumerate(shown)], "video int, frame int, px array<int>")


def test_decisions_equal_plain_python(spark):
    shown = video() + video(2)
    df = tables(spark, shown)
    plates = decision.clean_plates(df)
    plate = np.floor(np.median(np.stack(shown), 0)).astype(int)
    assert plates.first()["plate"] == plate.ravel().tolist()
    got = {}
    for r in decision.decide(df, plates, SIDE, B, GATES).collect():
        got.setdefault(r["frame"], []).append(tuple(r)[2:])
    want = {f: plain(shown[f], shown[f - 1], plate) for f in range(1, len(shown))}
    assert {f: sorted(v) for f, v in got.items()} == want
    seen = {b[2] for v in want.values() for b in v}
    flagged = {}
    for r in decision.decide(df.withColumn("ui", F.lit(True)), plates, SIDE, B, GATES, ui="ui").collect():
        flagged.setdefault(r["frame"], []).append(tuple(r)[2:])
    screens = {f: plain(shown[f], shown[f - 1], plate, True) for f in range(1, len(shown))}
    assert {f: sorted(v) for f, v in flagged.items()} == screens != want
    assert seen >= {"background", "solid", "palette", "predicted", "searched", "faded", "dither", "residual"}


def plain_boxes(still, square, largest, n=16, rows=4, longest=8):
    taken, out = np.zeros((rows, rows), bool), []
    for y in range(rows):
        for x in range(rows):
            if taken[y, x]:
                continue
            kind = "background" if still[y, x] < 12 else "motion" if square[y, x] < 40 * n and largest[y, x] < 14 else "coded"

            def ok(h, w):
                if taken[y : y + h, x : x + w].any():
                    return False
                box = np.s_[y : y + h, x : x + w]
                return (still[box] < 12).all() if kind == "background" else (largest[box] < 14).all() and square[box].sum() < 40 * n * h * w  # noqa: B023

            w = h = 1
            if kind != "coded":
                while w < min(longest, rows - x) and ok(1, w + 1):
                    w += 1
                while h < min(longest, rows - y) and ok(h + 1, w):
                    h += 1
            taken[y : y + h, x : x + w] = True
            out.append((y, x, h, w, kind))
    return out


def test_boxes_hold_their_gates(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for f in range(30):
        p = r.random()
        still, square, largest = r.choice([3, 11, 12, 40], (12, 12), p=[p / 2, p / 2, (1 - p) / 2, (1 - p) / 2]), r.choice([0, 300, 639, 640, 900], (12, 12)), r.choice([2, 13, 14], (12, 12), p=[0.5, 0.45, 0.05])
        rows.append((0, f, [(int(a), int(b), int(c)) for a, b, c in zip(still.ravel(), square.ravel(), largest.ravel(), strict=True)]))
        want[f] = plain_boxes(still, square, largest, rows=12)
    df = spark.createDataFrame(rows, "video int, frame int, errors array<struct<still: int, square: int, largest: int>>")
    got = {}
    for b in decision.gated_boxes(df, 12, 16).collect():
        got.setdefault(b["frame"], []).append(tuple(b)[2:])
    assert got == want
    for boxes in got.values():
        assert sorted((y + i, x + j) for y, x, h, w, _ in boxes for i in range(h) for j in range(w)) == [(y, x) for y in range(12) for x in range(12)]
    assert any(h > 1 and w > 1 for boxes in got.values() for _, _, h, w, k in boxes if k == "motion")
