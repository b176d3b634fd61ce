"""Robust statistics by key, each convention under its own name. Null samples are masked and never counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAD_SCALE = 1.4826


def median_mad(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """n, median (mean of the two middles), sigma (scaled median absolute deviation) by key; two shuffles on one key."""
    m = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.median(value).alias("median"))
    dev = df.where(F.col(value).isNotNull()).join(m, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("median").alias("median"), (F.median(F.abs(F.col(value) - F.col("median"))) * MAD_SCALE).alias("sigma"))
    return dev


def sorted_values(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """The sorted samples by key, for conventions that index them; a key's samples must fit a task (one frame, one tile)."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("samples"))


def upper_median(s: Column) -> Column:
    return s[F.floor(F.size(s) / 2).cast("int")]


def percentile_floor(s: Column, p: float) -> Column:
    return s[F.least(F.floor(F.size(s) * p), F.size(s) - 1).cast("int")]


def percentile_round(s: Column, p: float) -> Column:
    return s[F.round((F.size(s) - 1) * p).cast("int")]


def percentile_trunc(s: Column, p: float) -> Column:
    return s[F.least((F.size(s) * p).cast("int"), F.size(s) - 1)]


def robust_distribution(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """n, min, max, upper median and upper median absolute deviation by key."""
    s = sorted_values(df, keys, value)
    mid = upper_median(F.col("samples"))
    dev = F.array_sort(F.transform("samples", lambda x: F.abs(x - F.col("m"))))
    s = s.withColumn("m", mid)
    return s.select(*keys, F.size("samples").cast("long").alias("n"), F.col("samples")[0].alias("min"), F.element_at("samples", -1).alias("max"), F.col("m").alias("median"), upper_median(dev).alias("mad"))


def histogram_stats(df: DataFrame, keys: list[str], value: str = "g") -> DataFrame:
    """Exact statistics of integer samples from their histogram: n, min, max, mean, population sigma, lower median, and the
    least distance d whose band median +- d holds half the samples."""
    h = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    tot = h.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(F.col("c") * F.col(value)) / F.sum("c")).alias("mean"),
        F.sqrt(F.greatest(F.sum(F.col("c") * F.col(value) * F.col(value)) / F.sum("c") - F.pow(F.sum(F.col("c") * F.col(value)) / F.sum("c"), F.lit(2)), F.lit(0.0))).alias("sigma"),
    )
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = h.withColumn("cum", F.sum("c").over(w)).join(tot.select(*keys, "n"), keys)
    med = cum.where(F.col("cum") >= F.ceil(F.col("n") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))
    dev = h.join(med, keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("d"), "c").groupBy(*keys, "d").agg(F.sum("c").alias("c"))
    wd = Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    mad = dev.withColumn("cum", F.sum("c").over(wd)).join(tot.select(*keys, "n"), keys).where(F.col("cum") >= F.ceil(F.col("n") / 2)).groupBy(*keys).agg(F.min("d").alias("mad"))
    return tot.join(med, keys).join(mad, keys)


def otsu(df: DataFrame, keys: list[str], value: str = "g") -> DataFrame:
    """The threshold (0 to 255) of the largest between-class variance, the first of equals."""
    h = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = h.withColumn("n0", F.sum("c").over(w)).withColumn("s0", F.sum(F.col("c") * F.col(value)).over(w))
    tot = h.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col(value)).alias("s"))
    j = cum.join(tot, keys).where("n0 < n")
    m0, m1 = F.col("s0") / F.col("n0"), (F.col("s") - F.col("s0")) / (F.col("n") - F.col("n0"))
    var = F.round(F.col("n0") * (F.col("n") - F.col("n0")) * (m0 - m1) * (m0 - m1) / (F.col("n") * F.col("n")), 9)
    best = Window.partitionBy(*keys).orderBy(F.desc("var"), value)
    return j.withColumn("var", var).withColumn("r", F.row_number().over(best)).where("r = 1").select(*keys, F.col(value).alias("threshold"))


def strided(df: DataFrame, position: str, n: int, most: int) -> DataFrame:
    """A bounded sample before analysis: every k-th position, the same on every run."""
    return df.where(F.col(position) % max(1, n // most) == 0)


def ranked(df: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Numbers the rows of a table in an order, from 1, without one task that holds them all: ``bucket`` rises with the order and
    cuts the table into parts, which are numbered apart; only the buckets' counts meet in one place."""
    b = df.withColumn("__bucket", bucket)
    counts = b.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    j = b.withColumn("__rank", inside).join(starts, "__bucket")
    return j.withColumn(name, (F.col("__rank") + F.col("__start")).cast("int")).drop("__bucket", "__rank", "__start")
