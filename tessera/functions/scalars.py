"""Column functions of signal and report work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the quality, ratio and speed bands.
QUALITY_BANDS = ((10, "Visually Lossless"), (50, "Good"), (150, "Acceptable"), (400, "Degraded"))
RATIO_BANDS = ((0.5, "green"), (0.7, "light green"), (0.8, "yellow"), (1.0, "orange"))
SPEED_BANDS = ((10, "green"), (5, "yellow"), (2, "orange"))


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def floor_div(a: Column, b: int) -> Column:
    """Division that rounds down, as for negative motion vectors; div truncates."""
    return F.floor(a / b).cast("int")


def quantize(delta: Column, step: int) -> Column:
    """Nearest multiple, halves to even."""
    return F.bround(delta / step).cast("int")


def deadzone(q: Column, zone: int = 1) -> Column:
    return F.when(F.abs(q) <= zone, F.lit(0)).otherwise(q)


def dequantize(prev: Column, q: Column, step: int) -> Column:
    return clamp(prev + q * step, 0, 255)


def psnr(mse: Column, peak: int = 255) -> Column:
    """10 log10(peak**2 / mse); infinite for equal signals, null for null."""
    return F.when(mse > 0, 10 * F.log10(F.lit(float(peak * peak)) / mse)).when(mse == 0, F.lit(float("inf")))


def reduction(comp: Column, orig: Column) -> Column:
    """Saved share in percent; null where a run failed or the original is empty."""
    return F.when(orig > 0, 100 - comp * 100.0 / orig)


def fps(frames: Column, seconds: Column) -> Column:
    return frames / F.greatest(seconds, F.lit(0.001))


def band(x: Column, limits: tuple, above: str) -> Column:
    """Name of the first limit that x doesn't exceed."""
    out = F.lit(above)
    for limit, name in reversed(limits):
        out = F.when(x <= limit, name).otherwise(out)
    return F.when(x.isNotNull(), out)


def band_down(x: Column, limits: tuple, below: str) -> Column:
    """Name of the first limit that x reaches."""
    out = F.lit(below)
    for limit, name in reversed(limits):
        out = F.when(x >= limit, name).otherwise(out)
    return F.when(x.isNotNull(), out)


def change_symbol(delta: Column, dead: float) -> Column:
    """up, down or same within a dead zone; NEW where there is nothing to compare with."""
    return F.when(delta.isNull(), "NEW").when(delta > dead, "up").when(delta < -dead, "down").otherwise("same")


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma by integer weights, rounded half up."""
    return ((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of two boxes given by corner and size."""
    w = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, (w * h).cast("double") / union).otherwise(0.0)


def pack2(codes: Column) -> Column:
    """Array of 2-bit codes to an array of bytes, four to a byte, first highest. Its length is a multiple of four."""
    n = (F.size(codes) / 4).cast("int")
    at = lambda i, k: F.shiftleft(F.get(codes, i * 4 + k), 6 - 2 * k)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i, 0).bitwiseOR(at(i, 1)).bitwiseOR(at(i, 2)).bitwiseOR(at(i, 3)))


def unpack2(packed: Column) -> Column:
    return F.flatten(F.transform(packed, lambda b: F.array(*[F.shiftright(b, s).bitwiseAND(3) for s in (6, 4, 2, 0)])))


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def sad(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two arrays."""
    return array_sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def ssd(a: Column, b: Column) -> Column:
    """Sum of squared differences."""
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def largest_diff(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
