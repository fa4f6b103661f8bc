"""The whole mode decision of a frame: a fold over its blocks in raster order that carries the last motion vector, and covers by boxes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..sources.relations import cut
from . import blocks as bl
from .tracking import with_previous


@dataclass(frozen=True)
class MotionGates:
    """Limits of the decision. Mean absolute, mean squared and largest error that background and a carried vector may have,
    mean squared error of a searched vector, of a faded one, and its largest shift of level; costs above which vectors and fades are tried."""

    mean: float = 6.0
    square: float = 40.0
    largest: int = 14
    searched: float = 60.0
    faded: float = 180.0
    shift: int = 24
    motion_above: float = 10
    fade_above: float = 15
    reach: int = 4
    #: With the flag ui: what a palette block of 256 pixels must cost more than for vectors to be tried, and the largest error of a fade.
    ui_palette: float = 70
    ui_fade: int = 35


#: Pixels in a row whose levels over a video meet in one place.
STRIP = 64


def clean_plates(frames: DataFrame) -> DataFrame:
    """(video, plate): the median of each pixel over a video's frames, rounded down.

    Frames are cut into strips before they are dealt out, so that a row of the shuffle is a strip and not a pixel, and a task holds one strip of a video.
    """
    strips = F.transform(F.sequence(F.lit(0), F.size("px") - 1, F.lit(STRIP)), lambda i: F.slice("px", i + 1, STRIP).cast("array<smallint>"))
    held = frames.filter(F.size("px") > 0).select("video", F.posexplode(strips).alias("i", "v")).groupBy("video", "i").agg(F.collect_list("v").alias("vs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = [np.floor(np.median(v.values.flatten().to_numpy(zero_copy_only=False).reshape(len(v.values), -1), 0)).astype(np.int32) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(levels, pa.list_(pa.int32()))], names=["video", "i", "v"])

    levels = held.mapInArrow(run, "video int, i int, v array<int>")
    return levels.groupBy("video").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])).alias("plate"))


def let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


class Decider:
    """The decision of a stack of frames at once: arrays of frames, blocks in raster order, pixels of a block."""

    #: Modes by number, and those that carry a vector on.
    MODES = ("skip", "raw", "background", "solid", "palette", "predicted", "searched", "faded", "dither", "residual")
    SKIP, RAW, BACKGROUND, SOLID, PALETTE, PREDICTED, SEARCHED, FADED, DITHER, RESIDUAL = range(10)
    #: What stands around a frame, so that no block that leaves it is nearest.
    FAR = 2000

    def __init__(self, side: int, block: int, gates: bl.Gates, motion: MotionGates) -> None:
        self.side, self.block, self.n, self.area = side, block, side // block, block * block
        self.gates, self.motion = gates, motion

    def blocks(self, px: np.ndarray) -> np.ndarray:
        n, b = self.n, self.block
        return px.reshape(-1, n, b, n, b).transpose(0, 1, 3, 2, 4).reshape(-1, n * n, self.area)

    def settle(self, now: np.ndarray, then: np.ndarray, back: np.ndarray) -> dict[str, np.ndarray]:
        """Of each block what needs no vector: the cheapest of raw, background, solid and palettes, and dithered and coded, which come after
        the vectors. A cost is infinite where the candidate's gate fails."""
        g, m, area = self.gates, self.motion, self.area
        own, quarter = np.abs(now - then), area / 4
        sad, low, high = own.sum(-1), now.min(-1), now.max(-1)
        rng = high - low
        cost, size, mode = area + 1 + g.rate * sad, np.full(sad.shape, area + 1), np.full(sad.shape, self.RAW)

        def offer(ok: np.ndarray, new: np.ndarray, n: np.ndarray | int, kind: int, above: float = 0) -> None:
            won = ok & (cost > above) & (new < cost)
            cost[won], size[won], mode[won] = np.broadcast_to(new, won.shape)[won], np.broadcast_to(n, won.shape)[won], kind

        e = np.abs(now - back)
        offer((e.sum(-1) < m.mean * area) & ((e * e).sum(-1) < m.square * area) & (e.max(-1) < m.largest), 1 + g.rate * e.sum(-1), 1, self.BACKGROUND)
        flat = np.abs(now - (now.sum(-1) // area)[..., None]).sum(-1)
        tiny = (rng <= 2) & (flat <= area / 8)
        offer(tiny | (rng < g.solid_range), np.where(tiny, 1.5, 2 + g.rate * flat), np.where(tiny, 1, 2), self.SOLID)
        colours = 1 + (np.diff(np.sort(now, -1)) > 0).sum(-1)
        offer((rng > 2) & (colours <= 4), 1 + colours + quarter, (1 + colours + quarter).astype(int), self.PALETTE, g.palette)
        upper = now > ((low + high) // 2)[..., None]
        mean = lambda on: (now * on).sum(-1) // np.maximum(1, on.sum(-1))
        e = np.abs(now - np.where(upper, mean(upper)[..., None], mean(~upper)[..., None]))
        offer((colours > 4) & (rng > 15) & (e.max(-1) < 8) & ((e * e).sum(-1) < 16 * area), 3 + quarter + g.rate * e.sum(-1), int(3 + quarter), self.PALETTE, g.palette)
        nearest = np.abs(now - low[..., None])
        for i in (1, 2, 3):
            nearest = np.minimum(nearest, np.abs(now - (low + i * rng // 3)[..., None]))
        dithered = np.where(rng > 20, 5 + quarter + g.rate * nearest.sum(-1), np.inf)
        q = np.rint((now - then) / g.step).astype(now.dtype)
        e = np.abs(now - np.clip(then + q * g.step, 0, 255))
        nnz = (q != 0).sum(-1)
        bytes_ = np.where(2 * nnz >= area, g.dense, 1 + 2 * nnz)
        return {"cost": cost, "size": size, "mode": mode, "sad": sad, "skip": own.max(-1) < g.skip_max, "dithered": dithered, "coded": bytes_ + g.rate * e.sum(-1), "coded_size": bytes_.astype(int), "spoilt": e.max(-1) >= 8}

    def decide(self, px: np.ndarray, prev: np.ndarray, plate: np.ndarray, screen: np.ndarray) -> dict[str, np.ndarray]:
        """mode (a number), bytes, dy, dx, shift of the blocks of frames px, each with the one before, its plate, and whether it is a screen."""
        g, m, b, area, n = self.gates, self.motion, self.block, self.area, self.n
        now_all = self.blocks(px)
        f = self.settle(now_all, self.blocks(prev), self.blocks(plate))
        around = np.pad(prev, ((0, 0), (m.reach, m.reach), (m.reach, m.reach)), constant_values=self.FAR)
        windows = np.lib.stride_tricks.sliding_window_view(prev, (b, b), (1, 2))
        regions = np.lib.stride_tricks.sliding_window_view(around, (b + 2 * m.reach,) * 2, (1, 2))
        inside = lambda at: np.clip(at, 0, self.side - b)
        patch = lambda i, y, x: windows[i, y, x].reshape(len(i), area)
        dear = m.ui_palette - 64 + area / 4  # 64 bytes of that price are the indices of 256 pixels
        out = {k: np.zeros((len(px), n * n), np.int32) for k in ("mode", "bytes", "dy", "dx", "shift")}
        last = np.zeros((2, len(px)), int)
        for k in range(n * n):
            at = np.flatnonzero(~f["skip"][:, k])
            top, left, now, lit, carried = k // n * b, k % n * b, now_all[at, k], screen[at], last[:, at]
            cost, size, mode, shift = f["cost"][at, k], f["size"][at, k], f["mode"][at, k], np.zeros(len(at), int)
            vector, found, has = np.zeros((2, len(at)), int), np.zeros((2, len(at)), int), np.zeros(len(at), bool)

            def offer(i: np.ndarray, new: np.ndarray, ok: np.ndarray | bool, n_bytes: np.ndarray | int, kind: int, to: np.ndarray | int = 0, level: np.ndarray | int = 0) -> np.ndarray:
                """Puts a candidate of the rows i in its place where it may be and is cheaper; gives where that was."""
                won = ok & (new < cost[i])  # noqa: B023
                j = i[won]
                put = lambda v: np.broadcast_to(v, (*np.shape(v)[:-1], len(i)))[..., won] if np.ndim(v) else v
                cost[j], size[j], mode[j], vector[:, j], shift[j] = put(new), put(n_bytes), kind, put(to), put(level)  # noqa: B023
                return won

            free = ~lit | (mode != self.PALETTE) | (cost > dear)
            i = np.flatnonzero((2 * f["sad"][at, k] > area) & (cost > m.motion_above) & free)
            y, x = inside(top - carried[0, i]), inside(left - carried[1, i])
            e = np.abs(now[i] - patch(at[i], y, x))
            hit = (e.sum(-1) < m.mean * area) & ((e * e).sum(-1) < m.square * area) & (e.max(-1) < m.largest)
            offer(i[hit], 1 + g.rate * e[hit].sum(-1), True, 1, self.PREDICTED, carried[:, i[hit]])
            i, y, x = i[~hit], y[~hit], x[~hit]
            tried = np.lib.stride_tricks.sliding_window_view(regions[at[i], y, x], (b, b), (1, 2)) - now[i].reshape(-1, 1, 1, b, b)
            best = np.einsum("fyxij,fyxij->fyx", tried, tried).reshape(len(i), (2 * m.reach + 1) ** 2)
            place = best.argmin(-1)  # the first of equals: least row, then least column
            y, x = y - m.reach + place // (2 * m.reach + 1), x - m.reach + place % (2 * m.reach + 1)
            e = np.abs(now[i] - patch(at[i], y, x))
            has[i], found[:, i] = True, (top - y, left - x)
            offer(i, 3 + g.rate * e.sum(-1), ((e * e).sum(-1) < m.searched * area) & (e.max(-1) < m.largest), 3, self.SEARCHED, found[:, i])

            i, own = np.flatnonzero(cost > m.fade_above), vector.copy()  # the first vector whose faded block is cheaper ends it
            for to, some in ((found, has), (own, None), (carried, None)):
                j = i if some is None else i[some[i]]
                c = patch(at[j], inside(top - to[0, j]), inside(left - to[1, j]))
                level = np.trunc(now[j].sum(-1) / area - c.sum(-1) / area).astype(int)
                e = np.abs(now[j] - np.clip(c + level[:, None], 0, 255))
                ok = ((e * e).sum(-1) < m.faded * area) & (np.abs(level) <= m.shift) & (~lit[j] | (e.max(-1) < m.ui_fade))
                i = np.setdiff1d(i, j[offer(j, 4 + g.rate * e.sum(-1), ok, 4, self.FADED, to[:, j], level)], assume_unique=True)
            i = np.arange(len(at))
            offer(i, f["dithered"][at, k], cost > g.dither, int(5 + area / 4), self.DITHER)
            offer(i, f["coded"][at, k], (cost > g.residual) & ~((mode == self.PALETTE) & f["spoilt"][at, k]), f["coded_size"][at, k], self.RESIDUAL)
            for name, v in (("mode", mode), ("bytes", size), ("dy", vector[0]), ("dx", vector[1]), ("shift", shift)):
                out[name][at, k] = v
            on = np.isin(mode, (self.PREDICTED, self.SEARCHED, self.FADED))
            last[:, at[on]] = vector[:, on]
        return out


#: Frames that a task decides at once.
STACK = 128


def decide(frames: DataFrame, plates: DataFrame, side: int, block: int, gates: bl.Gates, motion: MotionGates = MotionGates(), ui: str | None = None) -> DataFrame:
    """(video, frame, by, bx, mode, bytes, dy, dx, shift) of each block of a frame that has one before it.

    In raster order, each candidate behind its gate and only if cheaper than the best so far: raw, background, solid, palettes; where the
    block changed and is still dear, the carried vector (predicted), or, if that is too far off, the least squared error within reach of
    it (searched); then, if still dear, the vector found, the best one's and the carried one with a shift of level (faded), of which the
    first that is cheaper ends it; then dither and residual. A block of a vector hands it on; a frame begins with none. Blocks that
    hardly changed are skipped. All is predicted from the source, so frames are independent of each other. ui names a column of frames that
    is true for screens: there a palette block keeps off vectors unless it is dear, and a fade has a limit on its largest error.

    Spark puts frames beside the ones before them and their plates; a task then takes STACK frames at a time through their blocks.
    """
    screen = F.coalesce(F.col(ui), F.lit(False)) if ui else F.lit(False)
    small = lambda c: F.col(c).cast("array<smallint>").alias(c)
    held = frames.select("video", "frame", screen.alias("screen"), small("px"))
    held = with_previous(held).join(plates.select("video", small("plate")), "video").select("video", "frame", "screen", "px", "prev", "plate")
    n = side // block
    by, bx = np.divmod(np.arange(n * n, dtype=np.int32), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decider, modes = Decider(side, block, gates, motion), pa.array(Decider.MODES)
        for batch in (whole.slice(i, STACK) for whole in batches for i in range(0, whole.num_rows, STACK)):
            px, prev, plate = (batch.column(k).flatten().to_numpy().astype(np.int32).reshape(-1, side, side) for k in (3, 4, 5))
            got = decider.decide(px, prev, plate, batch.column(2).to_numpy(zero_copy_only=False))
            keys = [pa.array(np.repeat(batch.column(k).to_numpy(), n * n)) for k in (0, 1)]
            grid = [pa.array(np.tile(v, batch.num_rows)) for v in (by, bx)]
            yield pa.RecordBatch.from_arrays([*keys, *grid, modes.take(pa.array(got["mode"].ravel())), *(pa.array(got[k].ravel()) for k in ("bytes", "dy", "dx", "shift"))], names=["video", "frame", "by", "bx", "mode", "bytes", "dy", "dx", "shift"])

    return held.mapInArrow(run, "video int, frame int, by int, bx int, mode string, bytes int, dy int, dx int, shift int")


def block_errors(frames: DataFrame, plates: DataFrame, side: int, block: int, dy: int) -> DataFrame:
    """(video, frame, errors): of each block in raster order the largest error against the plate and, against the frame before moved by
    dy rows, the sum of squares and the largest. Rows beyond the frame repeat its edge."""
    n = side // block
    grid = F.array(*[F.struct(F.lit(y * block).alias("y"), F.lit(x * block).alias("x")) for y in range(n) for x in range(n)])
    df = with_previous(frames).join(plates, "video")

    def one(g: Column) -> Column:
        part = lambda c: cut(F.col(c), side, g["y"], g["x"], block, block)
        then = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda r: F.slice("prev", fn.clamp(g["y"] + r - dy, 0, side - 1) * side + g["x"] + 1, block)))
        return let(F.struct(part("px").alias("now"), then.alias("then")), lambda e: F.struct(fn.largest_diff(e["now"], part("plate")).alias("still"), fn.ssd(e["now"], e["then"]).alias("square"), fn.largest_diff(e["now"], e["then"]).alias("largest")))

    return df.select("video", "frame", F.transform(grid, one).alias("errors"))


def gated_boxes(errors: DataFrame, rows: int, pixels: int, longest: int = 8, still: int = 12, square: float = 40, largest: int = 14) -> DataFrame:
    """(video, frame, by, bx, h, w, kind): boxes that cover the blocks (errors, in raster order) of each frame, every block once.

    A free block whose error against the plate is below still begins a box of background; else one whose mean square and largest error after
    the motion are below square and largest one of motion; else it stays alone as coded. A box grows to the right, then down, by free blocks
    up to longest of them, as long as all of it stays below its gate: largest errors of what is added, sums of squares of the whole
    rectangle from a table of prefix sums. The state of the fold over a frame's blocks is which of them are taken.
    """
    area, wide = rows * rows, rows + 1
    # table[(y, x)]: sum of squares of the blocks above and to the left
    line = lambda y: F.aggregate(F.slice("errors", y * rows + 1, rows), F.struct(F.lit(0).cast("long").alias("s"), F.array(F.lit(0).cast("long")).alias("t")), lambda a, e: F.struct((a["s"] + e["square"]).alias("s"), F.concat(a["t"], F.array(a["s"] + e["square"])).alias("t")))["t"]
    zero = F.array_repeat(F.lit(0).cast("long"), wide)
    table = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), line), F.struct(zero.alias("last"), zero.alias("all")), lambda a, r: let(F.zip_with(a["last"], r, lambda p, q: p + q), lambda s: F.struct(s.alias("last"), F.concat(a["all"], s).alias("all"))))["all"]
    df = errors.withColumn("table", table)

    def step(a: Column, i: Column) -> Column:
        y, x = F.floor(i / rows).cast("int"), i % rows
        own = F.get("errors", i)
        moves = (own["square"] < square * pixels) & (own["largest"] < largest)
        kind = F.when(own["still"] < still, "background").when(moves, "motion").otherwise("coded")

        def sum_of(h: Column, w: Column) -> Column:
            at = lambda r, c: F.get("table", r * wide + c)
            return at(y + h, x + w) - at(y, x + w) - at(y + h, x) + at(y, x)

        def free(r: Column, c: Column, k: Column) -> Column:
            """A block may be added: it isn't taken, and its largest error is below the gate."""
            e = F.get("errors", r * rows + c)
            return (F.get(a["taken"], r * rows + c) == 0) & F.when(k == "background", e["still"] < still).otherwise(e["largest"] < largest)

        def even(k: Column, h: Column, w: Column) -> Column:
            return (k == "background") | (sum_of(h, w) < square * pixels * h * w)

        def wider(k: Column) -> Column:
            most = F.least(F.lit(longest), rows - x)
            grown = lambda s, n: F.when((s == n - 1) & (n <= most) & free(y, x + n - 1, k) & even(k, F.lit(1), n), n).otherwise(s)
            w = F.when(k == "coded", F.lit(1)).otherwise(F.aggregate(F.sequence(F.lit(2), F.lit(longest)), F.lit(1), grown))
            return let(w, lambda v: taller(k, v))

        def taller(k: Column, w: Column) -> Column:
            most = F.least(F.lit(longest), rows - y)
            row = lambda n: F.forall(F.sequence(F.lit(0), w - 1), lambda c: free(y + n - 1, x + c, k))
            grown = lambda s, n: F.when((s == n - 1) & (n <= most) & row(n) & even(k, n, w), n).otherwise(s)
            h = F.when(k == "coded", F.lit(1)).otherwise(F.aggregate(F.sequence(F.lit(2), F.lit(longest)), F.lit(1), grown))
            return let(h, lambda v: claimed(k, v, w))

        def claimed(k: Column, h: Column, w: Column) -> Column:
            inside = lambda j: F.floor(j / rows).cast("int").between(y, y + h - 1) & (j % rows).between(x, x + w - 1)
            taken = F.transform(a["taken"], lambda t, j: F.when(inside(j), 1).otherwise(t))
            box = F.struct(y.alias("by"), x.alias("bx"), h.alias("h"), w.alias("w"), k.alias("kind"))
            return F.struct(taken.alias("taken"), F.concat(a["out"], F.array(box)).alias("out"))

        return F.when(F.get(a["taken"], i) == 1, a).otherwise(let(kind, wider))

    start = F.struct(F.array_repeat(F.lit(0), area).alias("taken"), F.array().cast("array<struct<by:int,bx:int,h:int,w:int,kind:string>>").alias("out"))
    return df.select("video", "frame", F.explode(F.aggregate(F.sequence(F.lit(0), F.lit(area - 1)), start, step)["out"]).alias("b")).select("video", "frame", "b.*")
