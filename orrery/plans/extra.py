"""Further bindings: name index, manifests, crop reports, automatic stretch, sample times, result orders, text on Unicode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import astro, names
from ..operators import catalog, pixels, spatial, stats
from .catalog import _KEY
from .registry import query
from .sequences import FRAME, R, frames
from .views import cte, table, view


@query(cte("v_object") + f", n AS (SELECT id, name FROM v_object UNION ALL SELECT id, common_name FROM v_object WHERE common_name <> ''), c AS (SELECT id, upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS k FROM n), d AS (SELECT DISTINCT id, {_KEY.format(k='k')} AS key FROM c) SELECT key, count(*) AS n, min(id) AS first_id FROM d GROUP BY key")
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.name_rows(view(spark, sf_dir, "v_object"), ["name", "common_name"])
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(cte("v_object") + " SELECT source, count(*) AS objects FROM v_object GROUP BY source")
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.source_manifest(view(spark, sf_dir, "v_object")).select("source", "objects")


@query("WITH " + FRAME + ", b AS (SELECT f, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v_frame WHERE v > 0.05e0 GROUP BY f), c AS (SELECT *, (x0 + x1) / 2e0 AS cx, (y0 + y1) / 2e0 AS cy FROM b), m AS (SELECT median(cx) AS mx, median(cy) AS my FROM c) SELECT f, n, round(cx - mx, 6) AS dx, round(cy - my, 6) AS dy FROM c, m")
def crop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = frames(spark, sf_dir).withColumn("v", F.when(F.col("v") > 0.05, F.col("v")))
    return pixels.crop_report(masked, 8, 8).select("f", "n", R("dx"), R("dy"))


@query(
    "WITH " + FRAME + ", u AS (SELECT f, y, x, (v + 1e0) / 2e0 AS v FROM v_frame), s AS (SELECT f, list_sort(list(v)) AS s FROM u GROUP BY f), m AS (SELECT f, s, s[33] AS med FROM s), d AS (SELECT f, med, list_sort(list_transform(s, lambda q: abs(q - med)))[33] * 1.4826e0 AS d FROM m), "
    "k AS (SELECT f, d, CASE WHEN med > 0.5 THEN 0e0 ELSE greatest(med - 2.8e0 * d, 0e0) END AS sh, CASE WHEN med > 0.5 THEN med + 2.8e0 * d ELSE 1e0 END AS hi, CASE WHEN med > 0.5 THEN 1 - 2.8e0 * d ELSE med - greatest(med - 2.8e0 * d, 0e0) END AS t FROM d), "
    "c AS (SELECT *, CASE WHEN t <= 0 THEN 0 WHEN t >= 1 THEN 1 ELSE (0.2e0 - 1) * t / ((0.4e0 - 1) * t - 0.2e0) END AS mid FROM k), x AS (SELECT u.f, y, x, 1 - hi + (v - sh) AS z, mid FROM u JOIN c ON u.f = c.f) "
    "SELECT f, y, x, round(CASE WHEN z <= 0 THEN 0 WHEN z >= 1 THEN 1 ELSE (mid - 1) * z / ((2 * mid - 1) * z - mid) END, 6) AS v FROM x"
)
def stretch_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = frames(spark, sf_dir).select("f", "y", "x", F.lit(0).alias("c"), ((F.col("v") + 1.0) / 2.0).alias("v"))
    return pixels.stretch(u, "linked").select("f", "y", "x", R("v"))


@query("SELECT o_orderkey AS id, CAST(greatest(ceil((o_orderkey % 50) / 7e0), 1) + 1 AS BIGINT) AS n, round(CAST(1704067200 + o_orderkey AS DOUBLE) + (o_orderkey % 50) / greatest(ceil((o_orderkey % 50) / 7e0), 1), 3) AS second FROM orders")
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(1704067200 + o_orderkey AS DOUBLE) AS s", "CAST(1704067200 + o_orderkey + o_orderkey % 50 AS DOUBLE) AS e")
    o = o.withColumn("t", astro.sample_times(F.col("s"), F.col("e"), 7.0))
    return o.select("id", F.size("t").cast("long").alias("n"), F.round(F.col("t")[1], 3).alias("second"))


@query(cte("v_object") + " SELECT id, CAST(row_number() OVER (ORDER BY coalesce(major_arcmin, 0e0) DESC, id) AS INTEGER) AS by_size, CAST(row_number() OVER (ORDER BY mag ASC NULLS LAST, coalesce(major_arcmin, 0e0) DESC, id) AS INTEGER) AS by_magnitude FROM v_object WHERE dec BETWEEN -10e0 AND 10e0")
def result_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the equatorial objects by size and by magnitude (unknown last)."""
    size = [*spatial._SORTS["size"](), F.asc("id")]
    mag = [*spatial._SORTS["magnitude"](), F.desc(F.coalesce("major_arcmin", F.lit(0.0))), F.asc("id")]
    o = view(spark, sf_dir, "v_object").where(F.col("dec").between(-10.0, 10.0))
    o = stats.ranked(o, -F.floor(F.coalesce("major_arcmin", F.lit(0.0))), size, "by_size")
    return stats.ranked(o, F.coalesce(F.floor("mag"), F.lit(1_000)), mag, "by_magnitude").select("id", "by_size", "by_magnitude")


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN concat('Sh2-', CAST(c_custkey AS VARCHAR)) WHEN 1 THEN concat('Ced ', CAST(c_custkey AS VARCHAR)) ELSE concat('LBN ', CAST(c_custkey AS VARCHAR)) END AS alias, CASE c_custkey % 3 WHEN 0 THEN concat('vizier:VII/20:Sh2-', CAST(c_custkey AS VARCHAR)) WHEN 1 THEN concat('vizier:VII/231:Ced', CAST(c_custkey AS VARCHAR)) ELSE concat('vizier:VII/9:LBN', CAST(c_custkey AS VARCHAR)) END AS stable_id FROM customer")
def alias_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "concat(CASE c_custkey % 3 WHEN 0 THEN 'sh 2 ' WHEN 1 THEN 'CED00' ELSE ' lbn 000' END, CAST(c_custkey AS STRING))"
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{raw} AS raw").withColumn("alias", names.catalog_aliases(F.col("raw"))[0])
    return a.select("id", "alias", names.stable_id(F.col("alias")).alias("stable_id"))
