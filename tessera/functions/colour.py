"""Colours as columns, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Linear light of sRGB, its matrix to XYZ, the white point, and where the cube root gives way to a line.
GAMMA_FROM, GAMMA_SLOPE, GAMMA_SHIFT, GAMMA_POWER = 0.04045, 12.92, 0.055, 2.4
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
ROOT_FROM, ROOT_SLOPE, LIGHT_SLOPE = 0.008856, 7.787, 903.3


def _linear(v: Column) -> Column:
    u = v / 255.0
    return F.when(u <= GAMMA_FROM, u / GAMMA_SLOPE).otherwise(F.pow((u + GAMMA_SHIFT) / (1 + GAMMA_SHIFT), GAMMA_POWER))


def _root(t: Column) -> Column:
    return F.when(t > ROOT_FROM, F.cbrt(t)).otherwise(ROOT_SLOPE * t + 16 / 116)


def lab8(r: Column, g: Column, b: Column) -> Column:
    """[L, a, b] of 8-bit red, green and blue, as 8-bit numbers: L stretched to 0..255, a and b moved by 128."""
    light = [_linear(c) for c in (r, g, b)]
    x, y, z = (sum((w * c for w, c in zip(row[1:], light[1:], strict=True)), row[0] * light[0]) / white for row, white in zip(TO_XYZ, WHITE, strict=True))
    bright = F.when(y > ROOT_FROM, 116 * F.cbrt(y) - 16).otherwise(LIGHT_SLOPE * y)
    made = (bright * 255 / 100, 500 * (_root(x) - _root(y)) + 128, 200 * (_root(y) - _root(z)) + 128)
    return F.array(*[F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + 0.5))).cast("int") for v in made])


def gray8(r: Column, g: Column, b: Column) -> Column:
    """Luminance in whole thousandths, halves up."""
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")


def _d(x: float) -> str:
    return f"{x!r}::double"


def lab8_sql(r: str, g: str, b: str) -> str:
    """lab8 as an SQL list, of three expressions."""
    light = [f"(case when {c} / 255.0::double <= {_d(GAMMA_FROM)} then {c} / 255.0::double / {_d(GAMMA_SLOPE)} else pow(({c} / 255.0::double + {_d(GAMMA_SHIFT)}) / {_d(1 + GAMMA_SHIFT)}, {_d(GAMMA_POWER)}) end)" for c in (r, g, b)]
    x, y, z = ("((" + " + ".join(f"{_d(w)} * {c}" for w, c in zip(row, light, strict=True)) + f") / {_d(white)})" for row, white in zip(TO_XYZ, WHITE, strict=True))
    root = lambda t: f"(case when {t} > {_d(ROOT_FROM)} then cbrt({t}) else {_d(ROOT_SLOPE)} * {t} + {_d(16 / 116)} end)"
    bright = f"(case when {y} > {_d(ROOT_FROM)} then 116 * cbrt({y}) - 16 else {_d(LIGHT_SLOPE)} * {y} end)"
    made = (f"{bright} * 255 / 100", f"500 * ({root(x)} - {root(y)}) + 128", f"200 * ({root(y)} - {root(z)}) + 128")
    return "[" + ", ".join(f"greatest(0, least(255, floor({v} + 0.5::double)))::int" for v in made) + "]"
