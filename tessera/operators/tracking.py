"""Frames as images and as scenes of objects: boxes, tags, transforms, hashes, components, matches and event logs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn


def boxes(mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x0, x1, y0, y1, area, cx, cy) of the pixels (y, x) of a mask."""
    mean = lambda c: F.round(F.sum(c).cast("double") / F.count("*"), 6)
    return mask.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("area"), mean("x").alias("cx"), mean("y").alias("cy"))


def box_overlap(df: DataFrame) -> DataFrame:
    """(video, frame, inter, iou) of a frame's box with that of the frame before."""
    size = df.select("video", "frame", F.col("x0").alias("bx"), F.col("y0").alias("by"), (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"))
    then = size.select("video", (F.col("frame") + 1).alias("frame"), *[F.col(c).alias(f"p{c}") for c in ("bx", "by", "w", "h")])
    df = size.join(then, ["video", "frame"])
    edge = lambda a, n: F.greatest(F.lit(0), F.least(F.col(a) + F.col(n), F.col(f"p{a}") + F.col(f"p{n}")) - F.greatest(a, f"p{a}"))
    box = [F.col(c) for c in ("bx", "by", "w", "h")]
    then_box = [F.col(f"p{c}") for c in ("bx", "by", "w", "h")]
    return df.select("video", "frame", (edge("bx", "w") * edge("by", "h")).alias("inter"), F.round(fn.iou(*box, *then_box), 6).alias("iou"))


def sobel_terms(block: int) -> list[tuple[dict[int, int], dict[int, int]]]:
    """For each pixel of a block the weights of its pixels in the 3 x 3 Sobel slopes along x and y; borders mirror without the edge."""
    mirror = lambda k: -k if k < 0 else 2 * (block - 1) - k if k >= block else k
    out = []
    for y in range(block):
        for x in range(block):
            gx, gy = {}, {}
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    at = mirror(y + dy) * block + mirror(x + dx)
                    gx[at] = gx.get(at, 0) + dx * (2 - abs(dy))
                    gy[at] = gy.get(at, 0) + dy * (2 - abs(dx))
            out.append(tuple({k: w for k, w in g.items() if w} for g in (gx, gy)))
    return out


def block_tags(blocks: DataFrame, block: int) -> DataFrame:
    """(video, frame, by, bx, edge, motion, spread, tag): EDGE by the mean of both Sobel slopes within a block, else CHAOS or MOTION by
    variance and mean of how far its pixels are from the frame before, else FLAT. All within a row; a block of the first frame is still.
    """
    dot = lambda g: F.abs(sum((w * F.get("px", at) for at, w in g.items()), F.lit(0)))
    n = block * block
    edge = sum((dot(gx) + dot(gy) for gx, gy in sobel_terms(block)), F.lit(0)).cast("double") / n
    moved = F.coalesce(F.zip_with("px", "prev", lambda a, b: F.abs(a - b)), F.array_repeat(F.lit(0), n))
    df = blocks.select("video", "frame", "by", "bx", edge.alias("edge"), moved.alias("moved"))
    total, squares = fn.array_sum(F.col("moved")), fn.array_sum(F.transform("moved", lambda v: v * v))
    df = df.withColumn("motion", total.cast("double") / n).withColumn("spread", F.round((n * squares - total * total).cast("double") / (n * n), 6))
    tag = F.when(F.col("edge") > 40, "EDGE").when(F.col("spread") > 1.5, "CHAOS").when(F.col("motion") > 0.5, "MOTION").otherwise("FLAT")
    return df.select("video", "frame", "by", "bx", "edge", "motion", "spread", tag.alias("tag"))


def cosine_basis(side: int, keep: int) -> list[list[float]]:
    scale = lambda k: math.sqrt((1 if k == 0 else 2) / side)
    return [[scale(k) * math.cos(math.pi * (2 * i + 1) * k / (2 * side)) for i in range(side)] for k in range(keep)]


def dct(frames: DataFrame, side: int, keep: int) -> DataFrame:
    """(video, frame, ky, kx, coefficient): the keep x keep lowest cosine coefficients of each frame.

    Each is the dot product of the frame's pixels with a constant array, so all is arithmetic within a row.
    """
    rows = cosine_basis(side, keep)
    wave = lambda ky, kx: F.lit([a * b for a in rows[ky] for b in rows[kx]])
    dot = lambda w: F.aggregate(F.zip_with("px", w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    all_ = [F.struct(F.lit(ky).alias("ky"), F.lit(kx).alias("kx"), dot(wave(ky, kx)).alias("c")) for ky in range(keep) for kx in range(keep)]
    df = frames.select("video", "frame", F.explode(F.array(*all_)).alias("d"))
    return df.select("video", "frame", "d.ky", "d.kx", (F.round("d.c", 3) + F.lit(0.0)).alias("coefficient"))


def hash_matches(frames: DataFrame, side: int, keep: int) -> DataFrame:
    """(video, frame, then_frame, k): up to keep latest earlier frames with the same difference hash.

    The frame is halved by sums of 2 x 2 pixels; a bit of the hash says whether a sum is above the one to its left, so every
    pixel counts. A frame looks back through the list of its own hash, which a window holds in order, so that a common
    hash makes keep rows per frame, not one per pair.
    """
    half = side // 2
    corner = lambda i: F.floor(i / half).cast("int") * 2 * side + i % half * 2
    pooled = F.transform(F.sequence(F.lit(0), F.lit(half * half - 1)), lambda i: sum((F.get("px", corner(i) + at) for at in (1, side, side + 1)), F.get("px", corner(i))))
    at = lambda i, o: F.get("pooled", F.floor(i / (half - 1)).cast("int") * half + i % (half - 1) + o)
    bit = lambda i: F.when(at(i, 1) > at(i, 0), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    whole = F.aggregate(F.sequence(F.lit(0), F.lit(half * (half - 1) - 1)), F.lit(0).cast("long"), lambda a, i: a + bit(i))
    df = frames.withColumn("pooled", pooled).select("video", "frame", whole.alias("hash"))
    w = Window.partitionBy("video", "hash").orderBy("frame").rowsBetween(-keep, -1)
    df = df.withColumn("past", F.reverse(F.array_sort(F.collect_list("frame").over(w))))
    return df.select("video", "frame", F.posexplode("past").alias("k", "then_frame")).select("video", "frame", "then_frame", (F.col("k") + 1).alias("k"))


def with_previous(frames: DataFrame) -> DataFrame:
    return frames.withColumn("prev", F.lag("px").over(Window.partitionBy("video").orderBy("frame"))).filter("prev is not null")


def mask_changes(frames: DataFrame, level: int) -> DataFrame:
    """(video, frame, n_changed, n_either): exclusive or and union of a frame's mask above a level with the one before."""
    on = lambda x: x > level
    count = lambda f: F.size(F.filter(F.zip_with("px", "prev", f), lambda x: x)).cast("long")
    return with_previous(frames).select("video", "frame", count(lambda a, b: on(a) != on(b)).alias("n_changed"), count(lambda a, b: on(a) | on(b)).alias("n_either"))


def step_mse(frames: DataFrame) -> DataFrame:
    return with_previous(frames).select("video", "frame", F.round(fn.ssd(F.col("px"), F.col("prev")).cast("double") / F.size("px"), 6).alias("mse"))


def nearest_entry(blocks: DataFrame, book: DataFrame) -> DataFrame:
    """(video, frame, by, bx, distance, entry): the nearest block of a codebook, the first of equals.

    The codebook is one array, in order of its video. It is broadcast, so it is meant to be of a fixed size, such as the blocks of ten videos.
    """
    entries = book.agg(F.array_sort(F.collect_list(F.struct("video", "by", "bx", "px"))).alias("book"))
    best = F.array_min(F.transform("book", lambda e, i: F.struct(fn.ssd(F.col("px"), e["px"]).cast("long").alias("d"), i.alias("i"))))
    return blocks.join(F.broadcast(entries)).select("video", "frame", "by", "bx", best.alias("b")).select("video", "frame", "by", "bx", F.col("b.d").alias("distance"), F.col("b.i").alias("entry"))


def _label(mask: np.ndarray) -> np.ndarray:
    """8-connected components of a mask: each pixel takes the least place around it until nothing changes; -1 outside."""
    side = mask.shape
    far = mask.size
    lab = np.where(mask, np.arange(mask.size).reshape(side), far)
    while True:
        wide = np.pad(lab, 1, constant_values=far)
        new = np.min([wide[1 + y : 1 + y + side[0], 1 + x : 1 + x + side[1]] for y in (-1, 0, 1) for x in (-1, 0, 1)], 0)
        new = np.where(mask, new, far)
        if (new == lab).all():
            return np.where(mask, lab, -1)
        lab = new


def components(mask: DataFrame, side: int, least: int = 1) -> DataFrame:
    """(video, frame, component, area) of the 8-connected regions of at least so many pixels; component is the first place.

    Each frame is one row of places, labelled in numpy: a task holds an Arrow batch of frames.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for video, frame, places in batch.itertuples(index=False):
                m = np.zeros(side * side, bool)
                m[places] = True
                found, area = np.unique(_label(m.reshape(side, side)), return_counts=True)
                out += [(video, frame, int(c), int(a)) for c, a in zip(found, area, strict=True) if c >= 0 and a >= least]
            yield pd.DataFrame(out, columns=["video", "frame", "component", "area"])

    places = mask.groupBy("video", "frame").agg(F.collect_list(F.col("y") * side + F.col("x")).alias("places"))
    return places.mapInPandas(run, "video int, frame int, component int, area long")


def blobs(mask: DataFrame, side: int, least: int = 2) -> DataFrame:
    """(video, frame, blob, x, y, w, h, cx, cy): boxes and centres of the regions of each frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for video, frame, places in batch.itertuples(index=False):
                m = np.zeros(side * side, bool)
                m[places] = True
                lab = _label(m.reshape(side, side))
                for c in np.unique(lab[lab >= 0]):
                    y, x = np.nonzero(lab == c)
                    if len(y) >= least:
                        out.append((video, frame, int(c), int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1, round(float(x.mean()), 6), round(float(y.mean()), 6)))
            yield pd.DataFrame(out, columns=["video", "frame", "blob", "x", "y", "w", "h", "cx", "cy"])

    places = mask.groupBy("video", "frame").agg(F.collect_list(F.col("y") * side + F.col("x")).alias("places"))
    return places.mapInPandas(run, "video int, frame int, blob int, x int, y int, w int, h int, cx double, cy double")


def _pairs_by_distance(a: list[tuple], b: list[tuple], within: float) -> list[tuple[int, int]]:
    """Greedy one-to-one pairs of points, nearest first, then by place in the lists."""
    near = sorted((math.dist(p, q), i, j) for i, p in enumerate(a) for j, q in enumerate(b) if math.dist(p, q) < within)
    used_a, used_b, out = set(), set(), []
    for _, i, j in near:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            out.append((i, j))
    return out


def greedy_matches(found: DataFrame, within: float) -> DataFrame:
    """(video, frame, blob, then_blob): one-to-one matches of a frame's regions with those of the frame before."""
    row = F.array_sort(F.collect_list(F.struct("blob", "cx", "cy")))
    now = found.groupBy("video", "frame").agg(row.alias("now"))
    both = now.join(now.select("video", (F.col("frame") + 1).alias("frame"), F.col("now").alias("then")), ["video", "frame"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for video, frame, a, b in batch[["video", "frame", "now", "then"]].itertuples(index=False):
                point = lambda r: (r["cx"], r["cy"])
                out += [(video, frame, a[i]["blob"], b[j]["blob"]) for i, j in _pairs_by_distance([*map(point, a)], [*map(point, b)], within)]
            yield pd.DataFrame(out, columns=["video", "frame", "blob", "then_blob"])

    return both.mapInPandas(run, "video int, frame int, blob int, then_blob int")


EVENTS = "video int, frame int, obj_id int, type string, x int, y int"


class Tracker:
    """Objects of one video: SPAWN when a region has no object near, MOVE when its box's corner shifts, DESPAWN after patience frames unseen."""

    def __init__(self, within: float, patience: int) -> None:
        self.within, self.patience = within, patience
        self.objects: dict[int, list] = {}
        self.next = 0

    def step(self, frame: int, regions: list[tuple]) -> list[tuple]:
        """regions: (cx, cy, x, y). Gives (obj_id, type, x, y)."""
        ids = sorted(self.objects)
        pairs = _pairs_by_distance([r[:2] for r in regions], [self.objects[i][:2] for i in ids], self.within)
        out, taken = [], set()
        for r, o in pairs:
            cx, cy, x, y = regions[r]
            old = self.objects[ids[o]]
            if (x, y) != (old[2], old[3]):
                out.append((ids[o], "MOVE", x - old[2], y - old[3]))
            self.objects[ids[o]] = [cx, cy, x, y, frame]
            taken.add(r)
        for r, (cx, cy, x, y) in enumerate(regions):
            if r not in taken:
                self.objects[self.next] = [cx, cy, x, y, frame]
                out.append((self.next, "SPAWN", x, y))
                self.next += 1
        return out + self.expire(frame)

    def expire(self, frame: int) -> list[tuple]:
        gone = [i for i, o in self.objects.items() if frame - o[4] > self.patience]
        return [(i, "DESPAWN", *self.objects.pop(i)[2:4]) for i in sorted(gone)]


def events(found: DataFrame, within: float, patience: int) -> DataFrame:
    """EVENTS of all objects: a fold over each video's frames in order. State is a video's live objects; frames stream through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video = tracker = None
        for batch in batches:
            out = []
            for v, frame, regions in batch[["video", "frame", "regions"]].itertuples(index=False):
                if v != video:
                    video, tracker = v, Tracker(within, patience)
                out += [(v, frame, *e) for e in tracker.step(frame, [(r["cx"], r["cy"], r["x"], r["y"]) for r in regions])]
            yield pd.DataFrame(out, columns=["video", "frame", "obj_id", "type", "x", "y"])

    row = F.array_sort(F.collect_list(F.struct("blob", "cx", "cy", "x", "y")))
    rows = found.groupBy("video", "frame").agg(row.alias("regions"))
    return rows.repartition("video").sortWithinPartitions("video", "frame").mapInPandas(run, EVENTS)


def interned_states(frames: DataFrame, level: int) -> DataFrame:
    """(video, frame, state, is_new): a number for each distinct mask above a level of a video, in the order in which they are first seen.

    Masks meet by their bits; only the distinct ones of a video are ranked.
    """
    mask = F.array_join(F.transform("px", lambda v: (v > level).cast("int").cast("string")), "")
    held = frames.select("video", "frame", mask.alias("mask"))
    seen = held.groupBy("video", "mask").agg(F.min("frame").alias("first"))
    seen = seen.withColumn("state", F.row_number().over(Window.partitionBy("video").orderBy("first")) - 1)
    return held.join(seen, ["video", "mask"]).select("video", "frame", "state", (F.col("frame") == F.col("first")).alias("is_new"))


def coherence(boxes_: DataFrame) -> DataFrame:
    """(video, frame, score, dx, dy, locked): of a frame's box the mean overlap with the four frames before, and how far its centre
    strayed over the five; locked where the overlap is above 0.85 or the centre within 2 either way. Frames with fewer before them are left out."""
    w = Window.partitionBy("video").orderBy("frame").rowsBetween(-4, 0)
    box = F.struct("x0", "y0", (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"))
    stray = lambda c: F.round(F.max(c).over(w) - F.min(c).over(w), 6)
    df = boxes_.withColumn("past", F.collect_list(box).over(w)).withColumn("dx", stray("cx")).withColumn("dy", stray("cy")).filter(F.size("past") == 5)
    now = F.get("past", F.lit(4))
    one = lambda b: fn.iou(b["x0"], b["y0"], b["w"], b["h"], now["x0"], now["y0"], now["w"], now["h"])
    score = F.round(F.aggregate(F.transform(F.slice("past", 1, 4), one), F.lit(0.0), lambda a, v: a + v) / 4, 6)
    return df.select("video", "frame", score.alias("score"), "dx", "dy", ((score > 0.85) | (F.col("dx") <= 2) & (F.col("dy") <= 2)).alias("locked"))


def first_match(blocks: DataFrame, most: int) -> DataFrame:
    """(video, frame, by, bx, entry): the first block of its video's frame 0 within a mean squared error of most."""
    first = blocks.filter("frame = 0").groupBy("video").agg(F.array_sort(F.collect_list(F.struct("by", "bx", "px"))).alias("book"))
    hit = lambda e, i: F.when(fn.ssd(F.col("px"), e["px"]) < most * F.size("px"), i)
    df = blocks.filter("frame > 0").join(first, "video").withColumn("entry", F.array_min(F.transform("book", hit)))
    return df.filter("entry is not null").select("video", "frame", "by", "bx", "entry")


def scaled_mse(frames: DataFrame, side: int, num: int, den: int) -> DataFrame:
    """(video, frame, mse) of each frame with the one before, enlarged by den / num about its corner by nearest pixels."""
    down = lambda i: F.floor(i * num / den).cast("int")
    source = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.get("prev", down(F.floor(i / side)) * side + down(i % side)))
    df = with_previous(frames).withColumn("scaled", source)
    return df.select("video", "frame", F.round(fn.ssd(F.col("px"), F.col("scaled")).cast("double") / (side * side), 6).alias("mse"))


def levels16(blocks: DataFrame) -> DataFrame:
    """(video, frame, by, bx, packed, sad): the nearest of 16 even levels per pixel, two to a byte, lower level of equals."""
    near = F.transform("px", lambda v: F.floor(v / 17).cast("int") + F.when((v % 17) * 2 > 17, 1).otherwise(0))
    df = blocks.withColumn("codes", near)
    packed = F.transform(F.sequence(F.lit(0), (F.size("codes") / 2).cast("int") - 1), lambda i: F.get("codes", 2 * i) * 16 + F.get("codes", 2 * i + 1))
    return df.select("video", "frame", "by", "bx", F.array_join(packed, ",").alias("packed"), fn.sad(F.col("px"), F.transform("codes", lambda c: c * 17)).alias("sad"))


def grid_edges(df: DataFrame, least: int = 3) -> DataFrame:
    """(video, frame, n_edges, n_joined): pairs of blocks side by side or one above the other, and those of one activity above least.

    Two equi-joins on the neighbour's place.
    """
    now = df.select("video", "frame", "by", "bx", F.col("n_active").alias("act"))
    other = lambda dy, dx: df.select("video", "frame", (F.col("by") - dy).alias("by"), (F.col("bx") - dx).alias("bx"), F.col("n_active").alias("beside"))
    near = other(0, 1).unionByName(other(1, 0))
    same = ((F.col("act") == F.col("beside")) & (F.col("act") > least)).cast("long")
    return now.join(near, ["video", "frame", "by", "bx"]).groupBy("video", "frame").agg(F.count("*").alias("n_edges"), F.sum(same).alias("n_joined"))


def four_means(blocks: DataFrame, rounds: int = 8) -> DataFrame:
    """(video, frame, by, bx, centres, sse): four levels per block by Lloyd's rounds from even quantiles, the same each time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            px = np.stack(batch["px"].to_numpy()).astype(float)  # all blocks of the batch at once
            c = np.quantile(px, [0.125, 0.375, 0.625, 0.875], axis=1).T
            for _ in range(rounds):
                own = np.abs(px[:, :, None] - c[:, None]).argmin(2)[:, :, None] == np.arange(4)
                n = own.sum(1)
                c = np.where(n > 0, (px[:, :, None] * own).sum(1) / np.maximum(n, 1), c)
            c = np.sort(np.trunc(c), 1)
            sse = (np.abs(px[:, :, None] - c[:, None]).min(2) ** 2).sum(1).astype(np.int64)
            centres = [",".join(map(str, r)) for r in c.astype(int).tolist()]
            yield batch[["video", "frame", "by", "bx"]].assign(centres=centres, sse=sse)

    return blocks.select("video", "frame", "by", "bx", "px").mapInPandas(run, "video int, frame int, by int, bx int, centres string, sse long")


def ssim(frames: DataFrame, side: int, window: int = 7, peak: int = 255) -> DataFrame:
    """(video, frame, ssim): structural similarity with the frame before, the mean over all square windows.

    Sample variances and the usual constants (0.01 and 0.03 of the peak, squared).
    """
    c1, c2, n = (0.01 * peak) ** 2, (0.03 * peak) ** 2, window * window
    per_row = side - window + 1
    place = lambda k, i: ((k / per_row).cast("int") + (i / window).cast("int")) * side + k % per_row + i % window
    sums = lambda k: F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)),
        F.struct(*[F.lit(0).alias(c) for c in ("a", "b", "aa", "bb", "ab")]),
        lambda s, i: F.struct(
            (s["a"] + F.get("px", place(k, i))).alias("a"), (s["b"] + F.get("prev", place(k, i))).alias("b"), (s["aa"] + F.get("px", place(k, i)) * F.get("px", place(k, i))).alias("aa"),
            (s["bb"] + F.get("prev", place(k, i)) * F.get("prev", place(k, i))).alias("bb"), (s["ab"] + F.get("px", place(k, i)) * F.get("prev", place(k, i))).alias("ab"),
        ),
    )
    df = with_previous(frames).withColumn("s", F.explode(F.transform(F.sequence(F.lit(0), F.lit(per_row * per_row - 1)), sums)))
    ma, mb = F.col("s.a") / n, F.col("s.b") / n
    va, vb, vab = ((F.col(f"s.{x}") - n * y * z) / (n - 1) for x, y, z in (("aa", ma, ma), ("bb", mb, mb), ("ab", ma, mb)))
    one = (2 * ma * mb + c1) * (2 * vab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return df.groupBy("video", "frame").agg(F.round(F.avg(one), 5).alias("ssim"))
