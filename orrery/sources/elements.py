"""Orbital element sets: two- and three-line text and OMM JSON, as DataFrames; malformed records are kept apart and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.astro import julian_date

OMM = "OBJECT_NAME string, OBJECT_ID string, EPOCH string, MEAN_MOTION double, ECCENTRICITY double, INCLINATION double, RA_OF_ASC_NODE double, ARG_OF_PERICENTER double, MEAN_ANOMALY double, NORAD_CAT_ID int, BSTAR double"
FIELDS = ["norad_id", "cospar_id", "name", "epoch", "inclination", "node", "eccentricity", "perigee", "anomaly", "motion", "bstar"]


def checksum_ok(line: Column) -> Column:
    digits = F.split(F.regexp_replace(F.regexp_replace(F.substring(line, 1, 68), "-", "1"), r"[^0-9]", ""), "")
    total = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda s, d: s + d.cast("int"))
    return total % 10 == F.substring(line, 69, 1).try_cast("int")


def _exponent(text: Column) -> Column:
    """A number such as `` 12345-3`` (a decimal point understood before it)."""
    t = F.trim(text)
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    body = F.regexp_replace(t, "^[+-]", "")
    return sign * F.regexp_extract(body, r"^(\d+)", 1).try_cast("double") / F.pow(F.lit(10.0), F.length(F.regexp_extract(body, r"^(\d+)", 1))) * F.pow(F.lit(10.0), F.coalesce(F.regexp_extract(body, r"([+-]\d)$", 1).try_cast("double"), F.lit(0.0)))


def tle(texts: DataFrame, key: str = "path", text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Element sets of whole files (key, text), and the number of malformed records of each. A record is a line that begins
    with ``1 `` and the one after it, with the line before as its name if that is no element line."""
    t = texts.select(key, F.filter(F.transform(F.split(text, r"\r?\n"), lambda s: F.rtrim(s)), lambda s: s != "").alias("lines"))
    at = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0))), lambda i: F.struct(i.alias("i"), F.get("lines", i).alias("a"), F.coalesce(F.get("lines", i + 1), F.lit("")).alias("b"), F.when(i > 0, F.get("lines", i - 1)).alias("n"))), lambda r: r["a"].startswith("1 "))
    r = t.select(key, F.explode(at).alias("r")).select(key, F.col("r.a").alias("line1"), F.col("r.b").alias("line2"), F.col("r.n").alias("n"))
    a, b = F.col("line1"), F.col("line2")
    cut = lambda c, i, j: F.trim(F.substring(c, i, j - i + 1))
    year = cut(a, 19, 20).try_cast("int")
    epoch = (julian_date(F.when(year < 57, year + 2000).otherwise(year + 1900), F.lit(1), F.lit(1.0)) + cut(a, 21, 32).try_cast("double") - 1.0 - 2440587.5) * 86400.0
    named = F.when(~F.col("n").rlike("^[12] "), F.regexp_replace(F.trim("n"), "^0 ", ""))
    r = r.select(
        key, cut(a, 3, 7).try_cast("int").alias("norad_id"), cut(a, 10, 17).alias("cospar_id"), F.coalesce(named, cut(a, 3, 7)).alias("name"), epoch.alias("epoch"), cut(b, 9, 16).try_cast("double").alias("inclination"), cut(b, 18, 25).try_cast("double").alias("node"),
        (cut(b, 27, 33).try_cast("double") / 1e7).alias("eccentricity"), cut(b, 35, 42).try_cast("double").alias("perigee"), cut(b, 44, 51).try_cast("double").alias("anomaly"), cut(b, 53, 63).try_cast("double").alias("motion"), _exponent(F.substring(a, 54, 8)).alias("bstar"),
        "line1", "line2", (b.startswith("2 ") & (F.length(a) >= 69) & (F.length(b) >= 69) & checksum_ok(a) & checksum_ok(b) & (cut(a, 3, 7) == cut(b, 3, 7))).alias("ok"),
    )
    good = F.coalesce(F.col("ok"), F.lit(False)) & F.col("norad_id").isNotNull() & F.col("epoch").isNotNull() & F.col("motion").isNotNull()
    return r.where(good).drop("ok"), r.where(~good).groupBy(key).agg(F.count("*").alias("malformed"))


def omm(texts: DataFrame, text: str = "value") -> DataFrame:
    """Element sets of JSON texts, one object or an array of them; rows without an id or epoch go."""
    one = F.when(F.trim(text).startswith("["), F.col(text)).otherwise(F.concat(F.lit("["), F.col(text), F.lit("]")))
    o = texts.select(F.explode(F.from_json(one, f"array<struct<{OMM.replace(' ', ':')}>>".replace(",:", ","))).alias("o")).select("o.*")
    t = F.regexp_replace("EPOCH", "Z$", "")
    return o.select(
        F.col("NORAD_CAT_ID").alias("norad_id"), F.col("OBJECT_ID").alias("cospar_id"), F.col("OBJECT_NAME").alias("name"), (F.unix_micros(F.try_to_timestamp(t)) / 1e6).alias("epoch"), F.col("INCLINATION").alias("inclination"), F.col("RA_OF_ASC_NODE").alias("node"),
        F.col("ECCENTRICITY").alias("eccentricity"), F.col("ARG_OF_PERICENTER").alias("perigee"), F.col("MEAN_ANOMALY").alias("anomaly"), F.col("MEAN_MOTION").alias("motion"), F.col("BSTAR").alias("bstar"),
    ).where("norad_id is not null and epoch is not null")


def sniff(text: Column) -> Column:
    """The format by the first character: json or tle."""
    t = F.ltrim(text)
    return F.when(t.startswith("[") | t.startswith("{"), "json").otherwise("tle")


def by_epoch(elements: DataFrame, midpoint: float, max_age: float) -> DataFrame:
    """The nearest element set of each object within ``max_age`` seconds; ties go to the later epoch."""
    d = elements.withColumn("age", F.abs(F.col("epoch") - midpoint)).where(F.col("age") <= max_age)
    best = F.max_by(F.struct(*[c for c in d.columns if c != "norad_id"]), F.struct((-F.col("age")).alias("a"), F.col("epoch")))
    return d.groupBy("norad_id").agg(best.alias("b")).select("norad_id", "b.*")
