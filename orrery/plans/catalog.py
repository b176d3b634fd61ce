"""Catalog queries over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import spatial
from .registry import query
from .views import cte, table, view

CONE = spatial.Cone(10.0, 20.0, 20.0)
POLYGON = spatial.Polygon(((340.0, -20.0), (20.0, -20.0), (20.0, 20.0), (340.0, 20.0)))


def _dot(a: str, b: str, v) -> str:
    return f"(cos(radians({b})) * cos(radians({a})) * {v[0]!r} + cos(radians({b})) * sin(radians({a})) * {v[1]!r} + sin(radians({b})) * {v[2]!r})"


def _angle(d: str) -> str:
    return f"degrees(acos(greatest(least({d}, 1e0), -1e0)))"


def _prominence(inside: str, radius: float) -> str:
    return (
        f"greatest(least((0.65e0 * coalesce(1e0 - exp(-2e0 * major_arcmin / {radius * 120.0!r}), 0e0) + 0.30e0 * coalesce(greatest(least((16e0 - mag) / 16e0, 1e0), 0e0), 0e0) "
        f"+ 0.05e0 * CASE WHEN common_name <> '' THEN 1e0 ELSE 0e0 END) * CASE WHEN {inside} THEN 1e0 ELSE 0.7e0 END, 1e0), 0e0)"
    )


_D = _angle(_dot("ra", "dec", CONE.center()))
_HITS = "id, kind, name, round({d}, 6) AS distance_deg, round({p}, 6) AS prominence"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("id", "kind", "name", F.round("distance_deg", 6).alias("distance_deg"), F.round("prominence", 6).alias("prominence"))


@query(
    cte("v_object") + f", h AS (SELECT *, {_D} AS d FROM v_object), k AS (SELECT *, d <= {CONE.radius + 1e-10!r} AS ins FROM h WHERE d <= {CONE.radius + 1e-10!r} OR abs(d - {CONE.radius!r}) <= coalesce(major_arcmin, 0e0) / 120e0), "
    f"p AS (SELECT *, {_prominence('ins', CONE.radius)} AS p FROM k) SELECT {_HITS.format(d='d', p='p')} FROM p ORDER BY p.p DESC, coalesce(major_arcmin, 0e0) DESC, id LIMIT 20"
)
def region_query_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most prominent objects that a cone overlaps (its feature is the top 20)."""
    return _hits(spatial.region_query(view(spark, sf_dir, "v_object"), CONE, limit=20))


def _poly_sql() -> str:
    c = POLYGON.center()
    tests = []
    for n, _, _ in POLYGON._edges():
        s = 1.0 if sum(x * y for x, y in zip(n, c)) > 0 else -1.0
        tests.append(f"{_dot('ra', 'dec', n)} * {s!r} >= -1e-12")
    d = _angle(_dot("ra", "dec", c))
    return cte("v_object") + f", h AS (SELECT *, {d} AS d, {' AND '.join(tests)} AS ins FROM v_object), p AS (SELECT *, {_prominence('ins', POLYGON.radius)} AS p FROM h WHERE ins) SELECT {_HITS.format(d='d', p='p')} FROM p"


@query(_poly_sql())
def region_query_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygon query on a table laid out by tile: the tile list reaches the scan."""
    return _hits(spatial.region_query(spatial.with_tile(view(spark, sf_dir, "v_object")), POLYGON, extents=False))


@query(_poly_sql())
def region_query_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spatial.region_query(view(spark, sf_dir, "v_object"), POLYGON, extents=False, sort="size"))


@query(cte("v_object") + f" SELECT id, kind, name, round({_D}, 6) AS distance_deg, mag FROM v_object WHERE {_D} <= {CONE.radius + 1e-10!r} AND mag <= 13e0 AND major_arcmin >= 5e0 AND common_name <> ''")
def region_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spatial.region_query(view(spark, sf_dir, "v_object"), CONE, max_mag=13.0, min_major=5.0, named_only=True, extents=False, sort="magnitude")
    return df.select("id", "kind", "name", F.round("distance_deg", 6).alias("distance_deg"), "mag")


_PAIR = "(cos(radians(dec)) * cos(radians(ra)) * cos(radians(dec0)) * cos(radians(ra0)) + cos(radians(dec)) * sin(radians(ra)) * cos(radians(dec0)) * sin(radians(ra0)) + sin(radians(dec)) * sin(radians(dec0)))"


@query(cte("v_star", "v_center") + f", n AS (SELECT sid, id, mag, row_number() OVER (PARTITION BY sid ORDER BY mag, id) AS r FROM v_star, v_center WHERE {_PAIR} >= {math.cos(math.radians(10.0))!r}) SELECT sid, id, mag, CAST(r AS INTEGER) AS rank FROM n WHERE r <= 5")
def cone_topk_per_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.cone_topk(view(spark, sf_dir, "v_center"), view(spark, sf_dir, "v_star"), 10.0, 5).select("sid", "id", "mag", "rank")


@query(cte("v_star") + " SELECT id, ra, dec, mag FROM v_star WHERE mag <= 8e0")
def bright_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_star").where(F.col("mag") <= 8.0)


def _tile_sql(n: int = 45) -> str:
    g = spatial.GRID
    rows = ", ".join(f"({b}, {g.bins[b]}, {g.offsets[b]})" for b in range(n))
    return f", grid(band, bins, start) AS (VALUES {rows}), s AS (SELECT *, least(greatest(CAST(trunc((dec + 90e0) / 180e0 * {n}) AS INTEGER), 0), {n - 1}) AS b FROM v_star), t AS (SELECT s.*, start + least(CAST(trunc(ra / 360e0 * bins) AS INTEGER), bins - 1) AS tile FROM s JOIN grid ON b = band)"


@query(cte("v_star") + _tile_sql() + " SELECT CAST(tile AS INTEGER) AS tile, count(*) AS n, min(mag) AS brightest FROM t GROUP BY tile")
def tile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.with_tile(view(spark, sf_dir, "v_star")).groupBy("tile").agg(F.count("*").alias("n"), F.min("mag").alias("brightest"))


@query(cte("v_star") + _tile_sql() + ", o AS (SELECT *, lag(mag) OVER (PARTITION BY tile ORDER BY id) AS prev FROM t) SELECT count(*) AS n, count(*) FILTER (ra < 0 OR ra >= 360 OR abs(dec) > 90) AS out_of_range, count(*) FILTER (prev > mag) AS out_of_order, count(DISTINCT tile) AS tiles FROM o")
def validate_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.validate_tiles(view(spark, sf_dir, "v_star").withColumn("ord", F.col("id")))


@query(cte("v_object") + " SELECT 'negative_size' AS rule, count(*) AS n FROM v_object WHERE major_arcmin < 0 HAVING count(*) > 0 UNION ALL SELECT 'unknown_mag', count(*) FROM v_object WHERE mag IS NULL HAVING count(*) > 0 UNION ALL SELECT 'empty_name', count(*) FROM v_object WHERE trim(coalesce(name, '')) = '' HAVING count(*) > 0 UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT id FROM v_object GROUP BY id HAVING count(*) > 1) HAVING count(*) > 0")
def validate_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.validate_objects(view(spark, sf_dir, "v_object"))


_KEY = r"CASE WHEN {k} LIKE 'SH2%' THEN regexp_replace({k}, '^(SH2)0+([0-9])', '\1\2') ELSE regexp_replace({k}, '^([^0-9]*)0+([0-9])', '\1\2') END"
_NAMES = "SELECT 'supplier' AS src, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 'part', p_partkey, p_name FROM part"


def _all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("src"), F.col(f"{p}").alias("id"), F.col(n).alias("name")) for t, p, n in (("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH n AS ({_NAMES}), c AS (SELECT *, upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS k FROM n) SELECT src, id, {_KEY.format(k='k')} AS object_key, {_KEY.format(k='k')} AS merge_key FROM c")
def name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_names(spark, sf_dir).select("src", "id", names.object_key(F.col("name")).alias("object_key"), names.merge_key(F.col("name")).alias("merge_key"))


@query(f"WITH n AS ({_NAMES}), c AS (SELECT *, upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS k FROM n) SELECT src, id, name FROM c WHERE {_KEY.format(k='k')} = 'CUSTOMER42'")
def name_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = names.object_key(F.lit("customer # 000042"))
    return _all_names(spark, sf_dir).where(names.object_key(F.col("name")) == key).select("src", "id", "name")


@query(f"WITH n AS ({_NAMES}), c AS (SELECT *, upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS k FROM n), d AS (SELECT src, id, {_KEY.format(k='k')} AS key FROM c) SELECT src, id, key FROM d WHERE key LIKE 'SUPPLIER1%' ORDER BY key, src, id LIMIT 10")
def name_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _all_names(spark, sf_dir).select("src", "id", names.object_key(F.col("name")).alias("key"))
    return keyed.where(F.col("key").startswith("SUPPLIER1")).orderBy("key", "src", "id").limit(10)


_IDENT = "CASE c_custkey % 5 WHEN 0 THEN concat('HIP ', CAST(c_custkey AS VARCHAR(20))) WHEN 1 THEN concat('hd', CAST(c_custkey AS VARCHAR(20))) WHEN 2 THEN concat('TYC ', CAST(c_custkey % 9000 + 1 AS VARCHAR(20)), '-', CAST(c_custkey % 77 + 1 AS VARCHAR(20)), '-1') WHEN 3 THEN concat('Gaia DR3 ', CAST(c_custkey * 1000003 AS VARCHAR(20))) ELSE c_name END"


@query(f"WITH t AS (SELECT c_custkey AS id, {_IDENT} AS raw FROM customer) SELECT id, raw, CAST(CASE WHEN id = 0 THEN NULL ELSE CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 6 END END AS INTEGER) AS namespace, CASE id % 5 WHEN 0 THEN nullif(id, 0) WHEN 1 THEN id WHEN 2 THEN ((id % 9000 + 1) << 17) | ((id % 77 + 1) << 3) | 1 WHEN 3 THEN id * 1000003 END AS value FROM t")
def identifier_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{_IDENT} AS raw").withColumn("p", names.parse_identifier(F.col("raw")))
    return t.select("id", "raw", F.col("p.namespace").alias("namespace"), F.col("p.value").alias("value"))


_SEP = "degrees(atan2(sqrt(power(cos(radians(o.dec)) * sin(radians(o.ra - n.ra)), 2) + power(cos(radians(n.dec)) * sin(radians(o.dec)) - sin(radians(n.dec)) * cos(radians(o.dec)) * cos(radians(o.ra - n.ra)), 2)), sin(radians(n.dec)) * sin(radians(o.dec)) + cos(radians(n.dec)) * cos(radians(o.dec)) * cos(radians(o.ra - n.ra))))"


@query(cte("v_object", "v_star") + f" SELECT id, ra, dec FROM v_object n WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM v_star o WHERE o.id % 7 = 0 AND abs(o.dec - n.dec) <= 4e0 AND {_SEP} <= 3e0)")
def position_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even objects without one of every seventh star within three degrees (the sets are the operator's two inputs)."""
    new, old = view(spark, sf_dir, "v_object").where("id % 2 = 0"), view(spark, sf_dir, "v_star").where("id % 7 = 0")
    return spatial.position_dedup(new.select("id", "ra", "dec"), old, 3.0)


@query(cte("v_object", "v_star") + f" SELECT id, ra, dec FROM v_object n WHERE NOT EXISTS (SELECT 1 FROM v_star o WHERE abs(o.dec - n.dec) <= 4e0 AND {_SEP} <= 3e0)")
def position_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects without any star within three degrees."""
    return spatial.position_dedup(view(spark, sf_dir, "v_object").select("id", "ra", "dec"), view(spark, sf_dir, "v_star"), 3.0)



def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = view(spark, sf_dir, "v_star").selectExpr("id", "ra * 10e0 AS x", "(dec + 90e0) * 10e0 AS y")
    o = view(spark, sf_dir, "v_object").selectExpr("id", "ra * 10e0 + 3e0 AS x", "(dec + 90e0) * 10e0 - 2e0 AS y")
    return s, o


_POINTS = cte("v_star", "v_object") + ", l AS (SELECT id, ra * 10e0 AS x, (dec + 90e0) * 10e0 AS y FROM v_star), r AS (SELECT id, ra * 10e0 + 3e0 AS x, (dec + 90e0) * 10e0 - 2e0 AS y FROM v_object)"


@query(_POINTS + ", p AS (SELECT l.id AS lid, r.id AS rid, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS d FROM l JOIN r ON abs(l.x - r.x) <= 12e0 AND abs(l.y - r.y) <= 12e0), b AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY d, rid) AS q FROM p WHERE d <= 12e0), c AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, lid) AS z FROM b WHERE q = 1) SELECT lid AS left_id, rid AS right_id, round(d, 6) AS dist FROM c WHERE z = 1")
def star_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _points(spark, sf_dir)
    return spatial.nearest_match(left, right, 12.0).withColumn("dist", F.round("dist", 6))


@query(_POINTS + " SELECT id FROM l WHERE EXISTS (SELECT 1 FROM r WHERE (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) <= 64e0)")
def inlier_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _points(spark, sf_dir)
    return spatial.inlier_census(left, right, 8.0).select("id")


@query("WITH p AS (SELECT page_id, unnest(string_split(html, '<tr')) AS r FROM pages) SELECT page_id, count(*) - 1 AS n_rows FROM p GROUP BY page_id")
def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.catalogs import html_table_rows

    pages = table(spark, sf_dir, "pages")
    rows = html_table_rows(pages, "page_id", "html").groupBy("page_id").agg(F.count("*").alias("n_rows"))
    return pages.select("page_id").join(rows, "page_id", "left").select("page_id", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


@query(cte("v_star") + " SELECT id, round(((ra + (id % 2000 - 1000) / 1e0 * 16e0 / 3.6e6 / greatest(cos(radians(dec)), 1e-9)) % 360e0 + 360e0) % 360e0, 6) AS ra, round(least(greatest(dec + (id % 700 - 350) / 1e0 * 16e0 / 3.6e6, -90e0), 90e0), 6) AS dec FROM v_star")
def proper_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.astro import propagate

    s = view(spark, sf_dir, "v_star")
    ra, dec = propagate(F.col("ra"), F.col("dec"), (F.col("id") % 2000 - 1000).cast("double"), (F.col("id") % 700 - 350).cast("double"), 16.0)
    return s.select("id", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


@query(cte("v_star") + " SELECT CAST(floor((dec + 90e0) / 10e0) AS INTEGER) AS band, count(*) AS n, round(avg(mag), 6) AS mean_mag FROM v_star GROUP BY 1")
def sky_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "v_star")
    return s.groupBy(F.floor((F.col("dec") + 90.0) / 10.0).cast("int").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("mag"), 6).alias("mean_mag"))


