"""Order-dependent folds over sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOW, HIGH, WARMUP, FLOOR = 3.0, 3.0, 5, 1e-6

STATE = "struct<n:bigint,mean:double,m2:double,rejected:bigint>"


def empty() -> Column:
    return F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(0).cast("long").alias("rejected"))


def rejects(s: Column, v: Column, low: float = LOW, high: float = HIGH, warmup: int = WARMUP, floor: float = FLOOR) -> Column:
    sigma = F.greatest(F.sqrt(s["m2"] / F.greatest(s["n"] - 1, F.lit(1))), F.lit(floor))
    d = v - s["mean"]
    return (s["n"] >= warmup) & (s["n"] > 1) & ((d < sigma * -low) | (d > sigma * high))


def step(s: Column, v: Column, **limits: float) -> Column:
    """One sample into the running mean and second moment; a rejected sample moves only the count of rejections."""
    n = s["n"] + 1
    mean = s["mean"] + (v - s["mean"]) / n
    taken = F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (v - s["mean"]) * (v - mean)).alias("m2"), s["rejected"].alias("rejected"))
    refused = F.struct(s["n"].alias("n"), s["mean"].alias("mean"), s["m2"].alias("m2"), (s["rejected"] + 1).alias("rejected"))
    return F.when(v.isNull(), s).when(rejects(s, v, **limits), refused).otherwise(taken)


def delta_sigma(df: DataFrame, keys: list[str], order: str, value: str = "v", **limits: float) -> DataFrame:
    """The online clip by key in the order of ``order``: n, mean (null if none), variance, rejected."""
    seq = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("seq"))
    out = seq.withColumn("s", F.aggregate("seq", empty(), lambda s, x: step(s, x["v"], **limits)))
    return out.select(*keys, F.col("s.n").alias("n"), F.when(F.col("s.n") > 0, F.col("s.mean")).alias("mean"), F.when(F.col("s.n") > 1, F.col("s.m2") / (F.col("s.n") - 1)).otherwise(0.0).alias("variance"), F.col("s.rejected").alias("rejected"))


def checkpoint_depths(df: DataFrame, keys: list[str], order: str, value: str = "v") -> DataFrame:
    """Running mean and deviation at depths 1, 2, 4 and so on, and at the last."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    d = df.withColumn("depth", F.count("*").over(w)).withColumn("mean", F.avg(value).over(w)).withColumn("sd", F.stddev_samp(value).over(w)).withColumn("last", F.count("*").over(whole))
    power = F.expr("depth & (depth - 1)") == 0
    return d.where(power | (F.col("depth") == F.col("last"))).select(*keys, "depth", "mean", "sd")


def max_rate(df: DataFrame, keys: list[str], time: str, value: str = "v") -> DataFrame:
    """The largest rate between neighbouring samples (time in seconds), over pairs with time between them."""
    w = Window.partitionBy(*keys).orderBy(time, "seq")
    d = df.withColumn("dt", F.col(time) - F.lag(time).over(w)).withColumn("dv", F.abs(F.col(value) - F.lag(value).over(w)))
    return d.where("dt > 0").groupBy(*keys).agg(F.max(F.col("dv") / F.col("dt")).alias("rate"))


def nearest_in_time(left: DataFrame, right: DataFrame, window: float, key: str | None = None, later_wins: bool = False) -> DataFrame:
    """For each left row (id, t) the right row (rid, rt) closest in time within ``window`` seconds.

    Both sides are cut into strips as wide as the window, so rows meet their own and the two neighbouring strips only.
    Ties: the larger rid with ``later_wins``, else the later time, then the larger rid.
    """
    keys = [key] if key else []
    strip = lambda c: F.floor(F.col(c) / window)
    none = F.lit(None)
    a = left.select("id", F.col("t").cast("double").alias("t"), *keys, F.explode(F.array(*[strip("t") + d for d in (-1, 0, 1)])).alias("strip"))
    b = right.select("rid", F.col("rt").cast("double").alias("rt"), *keys, strip("rt").alias("strip")).groupBy(*keys, "strip", "rt").agg(F.max("rid").alias("rid"))
    point = F.struct("rt", "rid")
    kind = dict(left.dtypes)["id"]
    both = a.select(*keys, "strip", "t", "id", none.cast(f"struct<rt:double,rid:{dict(right.dtypes)['rid']}>").alias("p")).union(b.select(*keys, "strip", "rt", none.cast(kind), point))
    # the last point up to each instant, and the first one after it, each by one pass over a sorted strip
    up = Window.partitionBy(*keys, "strip").orderBy("t", F.col("p").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "strip").orderBy(F.desc("t"), F.col("p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("before", F.last("p", True).over(up)).withColumn("after", F.last("p", True).over(down)).where("p is null")
    e = seen.select("id", *keys, "t", F.explode(F.array_compact(F.array("before", "after"))).alias("p")).withColumn("dist", F.abs(F.col("t") - F.col("p.rt"))).where(F.col("dist") <= window)
    tie = (F.col("p.rid"),) if later_wins else (F.col("p.rt"), F.col("p.rid"))
    best = e.groupBy("id", *keys).agg(F.first("t").alias("t"), F.max(F.struct((-F.col("dist")).alias("d"), *[c.alias(f"k{i}") for i, c in enumerate(tie)], F.col("p").alias("p"))).alias("m"))
    return best.select("id", *keys, "t", F.col("m.p.rid").alias("rid"), F.col("m.p.rt").alias("rt"), (-F.col("m.d")).alias("dist"))


def eviction(snapshots: DataFrame, cap: int, keep: int | None = None, provider: str = "provider") -> DataFrame:
    """Which snapshots (id, t, bytes, provider) a size cap evicts: oldest first until the rest fits; the newest of each
    provider and the one kept by the caller never go."""
    whole = Window.partitionBy(provider)
    newest = F.row_number().over(Window.partitionBy(provider).orderBy(F.desc("t"), F.desc("id"))) == 1
    s = snapshots.withColumn("guarded", newest | (F.col("id") == F.lit(keep if keep is not None else -1))).withColumn("total", F.sum("bytes").over(whole))
    older = Window.partitionBy(provider).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    free = F.coalesce(F.sum(F.when(~F.col("guarded"), F.col("bytes"))).over(older), F.lit(0))
    return s.withColumn("freed", free).withColumn("evict", ~F.col("guarded") & (F.col("total") - F.col("freed") > cap)).select(provider, "id", "t", "bytes", "evict")
