"""Tone curves as column expressions over samples in 0 to 1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET, CLIP = 0.2, -2.8


def unit(v: Column) -> Column:
    return F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))


def linear(v: Column, black: Column | float, white: Column | float) -> Column:
    """Affine to 0 and 1, not clamped; masked samples stay masked."""
    b, w = (c if isinstance(c, Column) else F.lit(float(c)) for c in (black, white))
    return (v - b) / (w - b)


def asinh(v: Column, black: float, white: float, strength: float) -> Column:
    return unit(F.asinh(F.greatest(linear(v, black, white), F.lit(0.0)) * strength) / math.asinh(strength))


def mtf(midtone: Column | float, x: Column) -> Column:
    m = midtone if isinstance(midtone, Column) else F.lit(float(midtone))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise((m - 1.0) * x / ((m * 2.0 - 1.0) * x - m))


def mtf_curve(v: Column, shadows: Column | float, midtone: Column | float, highlights: Column | float) -> Column:
    s, h = (c if isinstance(c, Column) else F.lit(float(c)) for c in (shadows, highlights))
    return unit(mtf(midtone, F.lit(1.0) - h + (v - s)))


def auto_mtf(median: Column, mad: Column, target: float = TARGET, clip: float = CLIP) -> Column:
    """struct<shadows, midtone, highlights, identity> resolved from a median and an unscaled deviation."""
    d = mad * 1.4826
    high = F.least(median - d * clip, F.lit(1e9))
    low = F.greatest(median + d * clip, F.lit(0.0))
    bright = median > 0.5
    return F.struct(
        F.when(bright, 0.0).otherwise(low).alias("shadows"), F.when(bright, mtf(F.lit(target), F.lit(1.0) - (high - median))).otherwise(mtf(F.lit(target), median - low)).alias("midtone"),
        F.when(bright, high).otherwise(1.0).alias("highlights"), (d <= 2.0**-23).alias("identity"),
    )


def ghs(v: Column, d: float, b: float, symmetry: float, shadows: float = 0.0, highlights: float = 1.0, black: float = 0.0, white: float = 1.0) -> Column:
    """Generalised hyperbolic stretch: the published family in ``b``, linear beyond the protected ends, scaled to 0 and 1."""

    def base(x: float) -> float:
        if abs(b + 1) < 1e-8:
            return math.log1p(d * x)
        if abs(b) < 1e-8:
            return 1 - math.exp(-d * x)
        return (1 - (1 - b * d * x) ** ((b + 1) / b)) / (d * (b + 1)) if b < 0 else 1 - (1 + b * d * x) ** (-1 / b)

    def slope(x: float) -> float:
        if abs(b + 1) < 1e-8:
            return d / (1 + d * x)
        if abs(b) < 1e-8:
            return d * math.exp(-d * x)
        return (1 - b * d * x) ** (1 / b) if b < 0 else d * (1 + b * d * x) ** (-(1 + b) / b)

    def column(x: Column) -> Column:
        if abs(b + 1) < 1e-8:
            return F.log1p(x * d)
        if abs(b) < 1e-8:
            return F.lit(1.0) - F.exp(x * -d)
        return (F.lit(1.0) - F.pow(F.lit(1.0) - x * (b * d), F.lit((b + 1) / b))) / (d * (b + 1)) if b < 0 else F.lit(1.0) - F.pow(F.lit(1.0) + x * (b * d), F.lit(-1 / b))

    low, low_slope = -base(symmetry - shadows), slope(symmetry - shadows)
    high, high_slope = base(highlights - symmetry), slope(highlights - symmetry)
    start, end = low_slope * (0 - shadows) + low, high_slope * (1 - highlights) + high
    x = unit(linear(v, black, white))
    raw = F.when(x < shadows, (x - shadows) * low_slope + low).when(x < symmetry, -column(F.greatest(F.lit(symmetry) - x, F.lit(0.0)))).when(x < highlights, column(F.greatest(x - symmetry, F.lit(0.0)))).otherwise((x - highlights) * high_slope + high)
    return unit((raw - start) / (end - start))


def to_u16(v: Column) -> Column:
    return F.floor(unit(v) * 65535.0 + 0.5).cast("int")


def to_u8(v: Column) -> Column:
    return F.floor(unit(v) * 255.0 + 0.5).cast("int")
