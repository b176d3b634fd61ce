"""Artifact manifests as DataFrames: parsing, validation, planning, verification, presets, roll-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = "struct<name:string,key:string,bytes:bigint,sha256:string>"
#: Presets of artifact names.
PRESETS = {
    "solver-lite": ["stars-lite", "objects"], "solver-gaia": ["stars-gaia", "objects"], "blind-deep": ["stars-gaia", "blind-deep", "objects"],
    "all": ["stars-lite", "stars-gaia", "blind-deep", "objects", "identifiers", "minor-bodies", "transients"],
}


def parse(texts: DataFrame, text: str = "value") -> DataFrame:
    """version, name, key, bytes, sha256 of manifest documents; unreadable ones give no rows."""
    m = texts.select(F.from_json(text, f"struct<version:string,files:array<{FILE}>>").alias("m")).where("m.files is not null")
    return m.select("m.version", F.explode("m.files").alias("f")).select("version", "f.*")


def violations(files: DataFrame) -> DataFrame:
    """rule, n: broken rules (empty or path-like names, bad sizes and hashes, repeated names)."""
    bad = [("empty-name", F.coalesce(F.trim("name"), F.lit("")) == ""), ("unsafe-name", F.col("name").rlike(r"[/\\]|^\.")), ("bad-size", F.coalesce(F.col("bytes") <= 0, F.lit(True))), ("bad-hash", ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)))]
    rows = files.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad]))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    again = files.groupBy("name").count().where("count > 1").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("repeated-name").alias("rule"), "n")
    return rows.union(again)


def plan(files: DataFrame, present: DataFrame, wanted: list[str]) -> DataFrame:
    """Wanted artifacts with what is to be done: use (same hash present), fetch, or missing (not offered)."""
    spark = files.sparkSession
    w = spark.createDataFrame([(n,) for n in wanted], "name string")
    j = w.join(files, "name", "left").join(present.select(F.col("name").alias("p"), F.col("sha256").alias("have")), F.col("name") == F.col("p"), "left")
    return j.select("name", "bytes", "sha256", F.when(F.col("sha256").isNull(), "missing").when(F.col("have") == F.col("sha256"), "use").otherwise("fetch").alias("action"))


def verify(files: DataFrame, path: str) -> DataFrame:
    """Checks the files under a path against size and hash: name, ok."""
    spark = files.sparkSession
    b = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length"), F.sha2("content", 256).alias("found"))
    return files.join(b, "name", "left").select("name", F.coalesce((F.col("length") == F.col("bytes")) & (F.col("found") == F.col("sha256")), F.lit(False)).alias("ok"))


def roll_forward(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new manifest's entries, and the old ones that it does not replace."""
    o = old.select(*[F.col(c).alias("o_" + c) for c in old.columns])
    j = new.join(o, new["name"] == o["o_name"], "full")
    return j.select(*[F.coalesce(F.col(c), F.col("o_" + c)).alias(c) for c in new.columns])


def nearest_entry(entries: DataFrame, instant: float, window: float) -> DataFrame:
    """The entry (ord, t) nearest to an instant within the window; equal distances go to the later entry in the list."""
    e = entries.withColumn("dist", F.abs(F.col("t") - instant)).where(F.col("dist") <= window)
    return e.orderBy("dist", F.desc("ord")).limit(1)


def cache_decision(policy: F.Column, cached: F.Column, age: F.Column, max_age: F.Column, fetched: F.Column) -> F.Column:
    """What a manifest request does under a cache policy (offline, prefer-cached, force, refresh): ``cached``, ``fetched``,
    ``stale`` (an old copy after a failed fetch) or ``error``. ``fetched``: whether a fetch would succeed."""
    fetch = F.when(fetched, "fetched").otherwise("error")
    held = F.coalesce(cached, F.lit(False))
    return (
        F.when(policy == "offline", F.when(held, "cached").otherwise("error"))
        .when(policy == "prefer-cached", F.when(held, "cached").otherwise(fetch))
        .when(policy == "force", fetch)
        .when(policy == "refresh", F.when(held & (age <= max_age), "cached").when(fetched, "fetched").when(held, "stale").otherwise("error"))
    )


def resolve_path(argument: F.Column, environment: F.Column, configured: F.Column, found: F.Column) -> F.Column:
    """A data path: the argument, else the environment's, else the configured one, else the deepest catalogue found
    (array of struct<depth, path>); blanks count as unset."""
    known = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(known(argument), known(environment), known(configured), F.get(F.sort_array(found, asc=False), F.lit(0))["path"])


def rolling(snapshots: DataFrame, now: float, keep: float, refresh: float) -> DataFrame:
    """A rolling history of snapshots (provider, t): the young ones and each provider's newest, marked where that one is due again."""
    newest = snapshots.groupBy("provider").agg(F.max("t").alias("newest"))
    j = snapshots.join(newest, "provider")
    return j.where((F.lit(now) - F.col("t") <= keep) | (F.col("t") == F.col("newest"))).withColumn("due", (F.col("t") == F.col("newest")) & (F.lit(now) - F.col("t") > refresh)).drop("newest")
