"""Colour composition of aligned mono channels: pixels meet by position, channels are scaled by their percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.curves import auto_mtf, mtf_curve, unit
from . import stats

BLACK, WHITE = 0.001, 0.995
#: The palettes' mixing matrices, rows red, green and blue over (S, H, O).
PALETTES: dict[str, tuple[tuple[float, float, float], ...]] = {
    "sho": ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
    "hso": ((0, 1, 0), (1, 0, 0), (0, 0, 1)),
    "hos": ((0, 1, 0), (0, 0, 1), (1, 0, 0)),
    "hoo": ((0, 1, 0), (0, 0, 1), (0, 0, 1)),
}


def levels(channels: DataFrame, keys: list[str], black: float = BLACK, white: float = WHITE) -> DataFrame:
    """Black and white points of each channel (keys), by the rounding percentile convention."""
    s = stats.sorted_values(channels, keys)
    return s.select(*keys, stats.percentile_round(F.col("samples"), black).alias("black"), stats.percentile_round(F.col("samples"), white).alias("white"))


def prepared(channels: DataFrame, keys: list[str], black: float = BLACK, white: float = WHITE) -> DataFrame:
    """Channels scaled to 0 and 1 between their percentiles, clamped; a channel without range is masked."""
    lv = levels(channels, keys, black, white)
    return channels.join(lv, keys).withColumn("v", F.when(F.col("white") > F.col("black"), unit((F.col("v") - F.col("black")) / (F.col("white") - F.col("black"))))).drop("black", "white")


def channels_by_pixel(channels: DataFrame, name: str, wanted: list[str], keys: list[str]) -> DataFrame:
    """One row a pixel with a column for each wanted channel; pixels that lack one are masked out."""
    p = channels.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == w, F.col("v"))).alias(w) for w in wanted])
    return p.where(" and ".join(f"{w} is not null" for w in wanted))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def rescaled(r: Column, g: Column, b: Column, target: Column) -> list[Column]:
    """The triplet brought to a target luminance, its chromaticity kept; black stays grey."""
    y = luminance(r, g, b)
    return [F.when(y > 1e-8, c * (target / y)).otherwise(target).alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))]


def lrgb(p: DataFrame, keys: list[str], weight: float = 1.0) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return p.select(*keys, *(rescaled(r, g, b, luminance(r, g, b) * (1.0 - weight) + F.col("l") * weight) if weight else (r, g, b)))


def super_lrgb(p: DataFrame, keys: list[str]) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return p.select(*keys, *rescaled(r, g, b, F.col("l") + r + g + b if "l" in p.columns else r + g + b))


def narrowband(p: DataFrame, keys: list[str], matrix: str | tuple) -> DataFrame:
    """Columns s (optional), h and o mixed by a palette or a 3 by 3 matrix."""
    rows = PALETTES[matrix] if isinstance(matrix, str) else matrix
    s = F.col("s") if "s" in p.columns else F.lit(0.0)
    return p.select(*keys, *[(s * float(a) + F.col("h") * float(b) + F.col("o") * float(c)).alias(n) for (a, b, c), n in zip(rows, ("r", "g", "b"))])


def foraxx(p: DataFrame, keys: list[str]) -> DataFrame:
    """The dynamic palette over display-referred channels: SHO with an s column, else HOO."""
    h, o = F.col("h"), F.col("o")
    product = unit(o * h)
    gf = F.pow(product, F.lit(1.0) - product)
    of = F.pow(o, F.lit(1.0) - o)
    red = of * F.col("s") + (F.lit(1.0) - of) * h if "s" in p.columns else h
    return p.select(*keys, red.alias("r"), (gf * h + (F.lit(1.0) - gf) * o).alias("g"), o.alias("b"))


def display(channels: DataFrame, keys: list[str], target: float = 0.2, clip: float = -2.8) -> DataFrame:
    """Each channel through the midtone curve its own median and deviation resolve to."""
    d = stats.robust_distribution(channels, keys).select(*keys, auto_mtf(F.col("median"), F.col("mad"), target, clip).alias("c"))
    curve = F.when(F.col("c.identity"), unit(F.col("v"))).otherwise(mtf_curve(F.col("v"), F.col("c.shadows"), F.col("c.midtone"), F.col("c.highlights")))
    return channels.join(d, keys).withColumn("v", curve).drop("c")
