"""Tracks: consecutive samples projected, clipped to the image, rated for bright trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clip(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int, margin: float = 0.0) -> Column:
    """struct<x0, y0, x1, y1> of a segment inside the image, null if it misses: the parametric clip against four sides."""
    dx, dy = x1 - x0, y1 - y0
    sides = [(-dx, x0 + margin), (dx, F.lit(width - 1 + margin) - x0), (-dy, y0 + margin), (dy, F.lit(height - 1 + margin) - y0)]
    low, high, parallel = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in sides:
        low = F.greatest(low, F.when(p < 0, q / F.nullif(p, F.lit(0.0))).otherwise(0.0))
        high = F.least(high, F.when(p > 0, q / F.nullif(p, F.lit(0.0))).otherwise(1.0))
        parallel = parallel | ((p == 0) & (q < 0))
    inside = ~parallel & (low <= high) & x0.isNotNull() & x1.isNotNull() & y0.isNotNull() & y1.isNotNull()
    return F.when(inside, F.struct((x0 + dx * low).alias("x0"), (y0 + dy * low).alias("y0"), (x0 + dx * high).alias("x1"), (y0 + dy * high).alias("y1")))


def segments(samples: DataFrame, keys: list[str], order: str, width: int, height: int) -> DataFrame:
    """The clipped segments between neighbouring samples (x, y): keys, order, x0, y0, x1, y1."""
    w = Window.partitionBy(*keys).orderBy(order)
    s = samples.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).where("nx is not null and ny is not null")
    c = s.withColumn("c", clip(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"), width, height)).where("c is not null")
    return c.select(*keys, order, "c.x0", "c.y0", "c.x1", "c.y1")


def path_lengths(parts: DataFrame, keys: list[str]) -> DataFrame:
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return parts.groupBy(*keys).agg(F.count("*").alias("segments"), F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"))


def trail_score(sunlight: Column, range_km: Column, elevation: Column, length: Column) -> Column:
    unit = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    score = unit(sunlight) * (unit(F.lit(1.0) - (range_km - 500.0) / 9500.0) * 0.60 + unit(elevation / 60.0) * 0.20 + unit(length / 100.0) * 0.20)
    return F.when(F.coalesce(sunlight > 0, F.lit(False)) & range_km.isNotNull() & elevation.isNotNull() & length.isNotNull(), unit(score)).otherwise(0.0)


def trail_level(score: Column, sunlight: Column, range_km: Column, length: Column) -> Column:
    high = (score >= 0.55) & (sunlight >= 0.5) & (range_km <= 4000) & (length >= 10)
    possible = (sunlight >= 0.2) & (range_km <= 10000) & (length >= 2)
    return F.when(high, "high").when(possible, "possible").otherwise("low")


def fresh(elements: DataFrame, epoch: str, midpoint: float, max_age: float) -> tuple[DataFrame, DataFrame]:
    """Element sets young enough at the midpoint, and the one-row count of those that are not."""
    old = F.abs(F.col(epoch) - midpoint) > max_age
    return elements.where(~F.coalesce(old, F.lit(True))), elements.agg(F.count_if(F.coalesce(old, F.lit(True))).alias("stale"))
