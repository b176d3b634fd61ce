"""Object identity: joins on designations, merging of records, deduplication across sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import merge_key


def designations(objects: DataFrame, columns: list[str]) -> DataFrame:
    """All non-blank designations of an object, as distinct keys: id, source, key."""
    names = F.array_compact(F.array(*[F.when(F.trim(c) != "", merge_key(F.col(c))) for c in columns]))
    return objects.select("id", "source", F.explode(F.array_distinct(names)).alias("key"))


def resolve(new: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """new id to catalogue id where its designations name exactly one object of another source: id, target, status
    (merged, ambiguous, added).

    No pair of objects is made: whether the objects of other sources are none, one or more is told by their least and greatest id,
    so a key needs the extreme ids over all sources and those over all sources but the one that holds the extreme."""
    a = designations(new, columns).where("source IS NOT NULL")
    b = designations(catalog, columns).where("source IS NOT NULL").groupBy("key", "source").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    first = b.groupBy("key").agg(F.min(F.struct("lo", "source")).alias("least"), F.max(F.struct("hi", "source")).alias("most"))
    other = lambda end: F.when(F.col("source") != F.col(f"{end}.source"), F.col("lo" if end == "least" else "hi"))
    second = b.join(first, "key").groupBy("key").agg(F.min(other("least")).alias("lo2"), F.max(other("most")).alias("hi2"))
    j = a.join(first.join(second, "key"), "key")
    lo = F.when(F.col("source") != F.col("least.source"), F.col("least.lo")).otherwise(F.col("lo2"))
    hi = F.when(F.col("source") != F.col("most.source"), F.col("most.hi")).otherwise(F.col("hi2"))
    hits = j.groupBy("id").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    out = new.select("id").join(hits, "id", "left")
    one = F.col("lo") == F.col("hi")
    status = F.when(one, "merged").when(~one, "ambiguous").otherwise("added")
    return out.select("id", F.when(one, F.col("lo")).alias("target"), status.alias("status"))


def tally(resolved: DataFrame) -> DataFrame:
    """One row: how many rows of ``resolve`` were added, merged and ambiguous."""
    return resolved.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "merged", "ambiguous")])


def merge(records: DataFrame, key: str, priority: str, measures: list[str], lists: list[str]) -> DataFrame:
    """One record a key: measures keep the first known value by priority, lists are united."""
    p = F.col(priority)
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), p)).alias(c) for c in measures]
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists]
    return records.groupBy(key).agg(F.count("*").alias("n"), *first, *united)


def unresolved_parents(objects: DataFrame, key: str, parents: str) -> DataFrame:
    """Parent links that name no object: id, parent."""
    e = objects.select(key, F.explode(parents).alias("parent"))
    return e.join(objects.select(F.col(key).alias("parent")), "parent", "left_anti")


def fallback(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """The primary source's rows, and those of the secondary whose key it lacks."""
    return primary.unionByName(secondary.join(primary.select(key), key, "left_anti").select(*primary.columns))


def missing(requested: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """One row: the requested artifacts that are not offered, in order, joined by commas."""
    m = requested.select(key).join(offered.select(key), key, "left_anti").distinct()
    return m.agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("missing"), F.count("*").alias("n"))
