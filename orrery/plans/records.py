"""Bindings of names and formats, dates, directions, catalogue tables, manifests and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import astro, names, sky
from ..operators import admission, catalog, merge, pixels, solving, spatial, stats, tracks
from ..sources import elements, fits, manifests
from .registry import query
from .sequences import FRAME, R, frames
from .views import cte, table, view


def _rows(spark: SparkSession, sf_dir: str, name: str, *exprs: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*exprs)


# --- names and formats

_STAR = "concat('HD ', CAST(c_custkey AS VARCHAR(20)), '-', CAST(c_custkey % 7 AS VARCHAR(20)), CASE c_custkey % 3 WHEN 0 THEN ' A-b α' WHEN 1 THEN ' e-x.' ELSE '+c_-5é-' END)"


@query(
    f"WITH s AS (SELECT c_custkey AS id, string_split({_STAR}, '') AS c FROM customer) SELECT id, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN regexp_matches(c[i], '[\\p{{L}}\\p{{N}}+]') THEN upper(c[i]) "
    "WHEN c[i] = '-' AND i > 1 AND i < len(c) AND (regexp_matches(c[i - 1] || c[i + 1], '^[0-9][0-9]$') OR regexp_matches(c[i - 1] || c[i + 1], '^[A-Da-d][A-Da-d]$')) THEN '-' ELSE '' END), '') AS key FROM s"
)
def star_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "customer", "c_custkey AS id", f"{_STAR} AS s").select("id", names.star_key(F.col("s")).alias("key"))


_LIST = "concat(' ', p_name, ',', p_brand, ' ;  ', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END, '|', CAST(p_partkey AS VARCHAR(20)), '  x', ', ')"


@query(f"SELECT p_partkey AS id, array_to_string(list_filter(list_transform(regexp_split_to_array({_LIST}, '[,;|]'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> ''), '/') AS aliases FROM part")
def alias_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "part", "p_partkey AS id", f"{_LIST} AS s").select("id", F.array_join(names.aliases(F.col("s")), "/").alias("aliases"))


_ROLE = "concat(CASE s_suppkey % 8 WHEN 0 THEN 'Dark Flat ' WHEN 1 THEN 'FLAT-dark' WHEN 2 THEN 'bias_' WHEN 3 THEN 'Master Dark' WHEN 4 THEN 'flat field' WHEN 5 THEN 'LIGHT ' WHEN 6 THEN 'dark bias' ELSE 'object' END, CAST(s_suppkey AS VARCHAR(20)))"


@query(
    f"WITH t AS (SELECT s_suppkey AS id, lower(regexp_replace({_ROLE}, '[^A-Za-z0-9]', '', 'g')) AS t FROM supplier) SELECT id, CASE WHEN contains(t, 'darkflat') OR contains(t, 'flatdark') THEN 'dark-flat' WHEN contains(t, 'bias') THEN 'bias' "
    "WHEN contains(t, 'dark') THEN 'dark' WHEN contains(t, 'flat') THEN 'flat' WHEN contains(t, 'light') THEN 'light' END AS role FROM t"
)
def frame_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "supplier", "s_suppkey AS id", f"{_ROLE} AS s").select("id", names.frame_role(F.col("s")).alias("role"))


@query("SELECT c_custkey AS id, round((CASE WHEN c_custkey % 2 = 0 THEN -1e0 ELSE 1e0 END) * (c_custkey % 90 + (c_custkey % 60) / 60e0 + (CASE WHEN c_custkey % 3 = 0 THEN 0e0 ELSE (c_custkey % 59) + 0.5e0 END) / 3600e0), 9) AS degrees FROM customer")
def sexagesimal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat(CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE '+' END, CAST(c_custkey % 90 AS STRING), ':', CAST(c_custkey % 60 AS STRING), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(' ', CAST(c_custkey % 59 AS STRING), '.5') END)"
    return _rows(spark, sf_dir, "customer", "c_custkey AS id", f"{text} AS s").select("id", F.round(names.sexagesimal(F.col("s")), 9).alias("degrees"))


@query(
    cte("v_star")
    + ", s AS (SELECT id, CAST(round(ra * 2400e0) AS BIGINT) % 864000 AS h, CAST(round(abs(dec) * 3600e0) AS BIGINT) AS d, dec FROM v_star) SELECT id, printf('%02dh%02dm%04.1fs', h // 36000, h // 600 % 60, (h % 600) / 10e0) AS ra, "
    "concat(CASE WHEN dec < 0 THEN '-' ELSE '+' END, printf('%02d', d // 3600), '°', printf('%02d', d // 60 % 60), '''', printf('%02d', d % 60), '\"') AS dec FROM s"
)
def sexagesimal_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_star").select("id", names.hms(F.col("ra")).alias("ra"), names.dms(F.col("dec")).alias("dec"))


_CELL = "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ', x' WHEN 1 THEN ' \"q\"' WHEN 2 THEN chr(10) ELSE '' END)"


@query(f"WITH t AS (SELECT p_partkey AS id, {_CELL} AS s FROM part) SELECT id, CASE WHEN contains(s, ',') OR contains(s, '\"') OR contains(s, chr(10)) OR contains(s, chr(13)) THEN '\"' || replace(s, '\"', '\"\"') || '\"' ELSE s END AS cell FROM t")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "part", "p_partkey AS id", f"{_CELL} AS s").select("id", names.csv_field(F.col("s")).alias("cell"))


@query("SELECT s_suppkey AS id, array_to_string(list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'AB' END, CASE WHEN s_suppkey % 3 <> 0 THEN concat('sep=', s_suppkey % 90, '.5arcsec') END, CASE WHEN s_suppkey % 4 <> 0 THEN concat('pa=', s_suppkey % 360, 'deg') END, CASE WHEN s_suppkey % 70 < 62 THEN printf('mag2=%.2f', CAST(s_suppkey % 70 AS DOUBLE)) END], lambda x: x IS NOT NULL), '; ') AS detail FROM supplier")
def double_star_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir, "supplier", "s_suppkey AS id", "CASE WHEN s_suppkey % 2 = 0 THEN 'AB' END AS c", "CASE WHEN s_suppkey % 3 <> 0 THEN concat(s_suppkey % 90, '.5') ELSE '.' END AS s", "CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 360 AS STRING) ELSE '' END AS a", "CAST(s_suppkey % 70 AS STRING) AS m")
    return r.select("id", names.double_star_detail(F.col("c"), F.col("s"), F.col("a"), F.col("m")).alias("detail"))


_PLACE, _GREEK = "CASE s_suppkey % 3 WHEN 0 THEN 'Ori' WHEN 1 THEN 'UMa' ELSE '' END", "CASE s_suppkey % 4 WHEN 0 THEN 'Alp' WHEN 1 THEN 'Mu' WHEN 2 THEN 'Zet' ELSE '' END"


@query(
    f"WITH f AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CAST(s_suppkey % 100 AS VARCHAR) END AS n, {_GREEK} AS g, CASE WHEN s_suppkey % 7 = 0 THEN '2' ELSE '' END AS c, {_PLACE} AS p FROM supplier), "
    "k AS (SELECT *, CASE g WHEN 'Alp' THEN 'Alpha' WHEN 'Mu' THEN 'Mu' WHEN 'Zet' THEN 'Zeta' END AS w, CASE g WHEN 'Alp' THEN 'α' WHEN 'Mu' THEN 'μ' WHEN 'Zet' THEN 'ζ' END AS s FROM f) "
    "SELECT id, CASE WHEN p = '' THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter([CASE WHEN n <> '' THEN n || ' ' || p END, CASE WHEN g <> '' THEN g || c || ' ' || p END, CASE WHEN g <> '' THEN w || c || ' ' || p END, CASE WHEN g <> '' THEN s || c || ' ' || p END], lambda x: x IS NOT NULL))), '/') END AS names FROM k"
)
def bayer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"concat(lpad(CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CAST(s_suppkey % 100 AS STRING) END, 3, ' '), rpad({_GREEK}, 3, ' '), CASE WHEN s_suppkey % 7 = 0 THEN '2' ELSE ' ' END, {_PLACE}) AS s"
    return _rows(spark, sf_dir, "supplier", "s_suppkey AS id", text).select("id", F.array_join(names.bright_star_names(F.col("s")), "/").alias("names"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'cam-a' WHEN 1 THEN 'cam-b' WHEN 2 THEN 'cam-a' END AS camera FROM orders")
def header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = lambda k, v: f"named_struct('keyword', '{k}', 'kind', 'text', 'value', '{v}')"
    cards = f"CASE o_orderkey % 4 WHEN 0 THEN array({card('Camera', 'cam-x')}, {card('instrume', 'cam-a')}) WHEN 1 THEN array({card('GAIN', '7')}, {card('CAMERA', 'cam-b')}) WHEN 2 THEN array({card('INSTRUME', 'cam-a')}, {card('INSTRUME', 'cam-z')}) ELSE array({card('GAIN', '1')}) END AS cards"
    return _rows(spark, sf_dir, "orders", "o_orderkey AS id", cards).select("id", fits.card_value("cards", ["INSTRUME", "CAMERA"]).alias("camera"))


@query("SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN event_id WHEN 2 THEN 3 END AS tries, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'none' WHEN 2 THEN 'none' END AS mode FROM events")
def partial_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE event_id % 5 WHEN 0 THEN concat('{\"mode\": \"', event_type, '\"}') WHEN 1 THEN concat('{\"tries\": ', event_id, '}') WHEN 2 THEN '{}' WHEN 3 THEN '{\"other\": 1}' ELSE '[1]' END AS t"
    r = _rows(spark, sf_dir, "events", "event_id AS id", text).withColumn("d", names.checked_json(F.col("t"), {"tries": "bigint", "mode": "string"}, {"tries": 3, "mode": "none"}))
    return r.select("id", "d.tries", "d.mode")


@query("SELECT s_suppkey AS id, sha256(concat_ws('|', concat(length(s_name), ':', s_name), CASE WHEN s_suppkey % 3 = 0 THEN '-' ELSE concat(length(CAST(s_nationkey AS VARCHAR)), ':', s_nationkey) END, CASE WHEN s_suppkey % 2 = 0 THEN '0:' ELSE '1:x' END)) AS fingerprint FROM supplier")
def configuration_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir, "supplier", "s_suppkey AS id", "s_name AS a", "CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END AS b", "CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'x' END AS c")
    return r.select("id", names.fingerprint(F.col("a"), F.col("b"), F.col("c")).alias("fingerprint"))


# --- dates


@query("SELECT o_orderkey AS id, round(epoch(o_orderdate) / 86400e0 + 2440587.5e0, 6) AS jd FROM orders")
def julian_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = "day(o_orderdate) + (hour(o_orderdate) * 3600e0 + minute(o_orderdate) * 60e0 + second(o_orderdate)) / 86400e0 AS d"
    r = _rows(spark, sf_dir, "orders", "o_orderkey AS id", "year(o_orderdate) AS y", "month(o_orderdate) AS m", day)
    return r.select("id", F.round(astro.julian_date(F.col("y"), F.col("m"), F.col("d")), 6).alias("jd"))


_SECOND = "1704067200 + o_orderkey * 37"


@query(f"SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN round(floor(({_SECOND}) / 86400e0) * 86400e0, 3) WHEN 1 THEN ({_SECOND}) + 0.25e0 WHEN 2 THEN CAST({_SECOND} AS DOUBLE) END AS unix FROM orders")
def iso_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"timestamp_seconds({_SECOND})"
    text = f"CASE o_orderkey % 4 WHEN 0 THEN date_format({at}, ' yyyy-MM-dd') WHEN 1 THEN concat(date_format({at}, \"yyyy-MM-dd'T'HH:mm:ss\"), '.25Z') WHEN 2 THEN date_format({at}, \"yyyy-MM-dd'T'HH:mm:ss\") ELSE 'soon' END AS t"
    return _rows(spark, sf_dir, "orders", "o_orderkey AS id", text).select("id", astro.iso_to_unix(F.col("t")).alias("unix"))


@query(
    "WITH e AS (SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_orderkey % 3 = 0 THEN 1000e0 + l_orderkey END AS s, CASE WHEN l_orderkey % 2 = 0 THEN 1005e0 + l_orderkey END AS m, CASE WHEN l_orderkey % 5 <> 0 THEN 1020e0 + l_orderkey END AS e, l_quantity AS d FROM lineitem) "
    "SELECT o, n, round(CASE WHEN s IS NOT NULL THEN s WHEN m IS NOT NULL THEN m - d / 2 ELSE e - d END, 6) AS start, round(CASE WHEN s IS NOT NULL THEN s + d WHEN m IS NOT NULL THEN m + d / 2 ELSE e END, 6) AS stop FROM e"
)
def exposure_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir, "lineitem", "l_orderkey AS o", "l_linenumber AS n", "CASE WHEN l_orderkey % 3 = 0 THEN 1000e0 + l_orderkey END AS s", "CASE WHEN l_orderkey % 2 = 0 THEN 1005e0 + l_orderkey END AS m", "CASE WHEN l_orderkey % 5 <> 0 THEN 1020e0 + l_orderkey END AS e", "l_quantity AS d")
    r = r.withColumn("i", astro.exposure_interval(F.col("s"), F.col("m"), F.col("e"), F.col("d")))
    return r.select("o", "n", F.round("i.start", 6).alias("start"), F.round("i.end", 6).alias("stop"))


@query(cte("v_exposure") + ", a AS (SELECT id, 1704100000e0 - t AS a FROM v_exposure) SELECT id, CASE WHEN a >= 0 THEN a WHEN a >= -300 THEN 0e0 END AS age, a > 30000 AS historical FROM a")
def snapshot_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = astro.snapshot_age(F.col("t"), 1704100000.0)
    return view(spark, sf_dir, "v_exposure").select("id", F.when(age < float("inf"), age.cast("double")).alias("age"), astro.historical(F.col("t"), 1704100000.0, 30000.0).alias("historical"))


# --- directions and projections

_TO = "sin(radians(40e0 - ra)) * cos(radians(25e0)), cos(radians(dec)) * sin(radians(25e0)) - sin(radians(dec)) * cos(radians(25e0)) * cos(radians(40e0 - ra))"


@query(
    cte("v_star") + f", b AS (SELECT id, degrees(atan2({_TO})) AS b, ra * 3e0 - 540e0 AS l FROM v_star) SELECT id, round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) AS bearing, round(l + 180 - 360 * floor((l + 180) / 360) - 180, 6) AS longitude, "
    "round(least(l - 180 * floor(l / 180), 180 - (l - 180 * floor(l / 180))), 6) AS deviation FROM b"
)
def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "v_star").withColumn("l", F.col("ra") * 3.0 - 540.0)
    return s.select("id", F.round(sky.bearing("ra", "dec", 40.0, 25.0), 6).alias("bearing"), F.round(sky.wrap_longitude(F.col("l")), 6).alias("longitude"), F.round(admission.rotation_deviation(F.col("l")), 6).alias("deviation"))


SIP = sky.Wcs(150.0, 35.0, 400.0, 300.0, (-7e-4, 1e-4, 1e-4, 7e-4), (2, (1e-5, -2e-5, 3e-5), (2e-6, 1e-5, -1e-5), (0.0,) * 6, (0.0,) * 6))


@query(
    "WITH p AS (SELECT event_id AS id, CAST(event_id % 800 AS DOUBLE) - 400e0 AS u, CAST((event_id * 7) % 600 AS DOUBLE) - 300e0 AS v FROM events), s AS (SELECT id, u + 1e-5 * v * v - 2e-5 * u * v + 3e-5 * u * u AS u, v + 2e-6 * v * v + 1e-5 * u * v - 1e-5 * u * u AS v FROM p), "
    "t AS (SELECT id, radians(-7e-4 * u + 1e-4 * v) AS xi, radians(1e-4 * u + 7e-4 * v) AS eta FROM s), c AS (SELECT *, cos(radians(35e0)) - eta * sin(radians(35e0)) AS den FROM t) "
    "SELECT id, round(degrees(atan2(xi, den)) + 150e0, 7) AS ra, round(degrees(atan2(eta * cos(radians(35e0)) + sin(radians(35e0)), sqrt(xi * xi + den * den))), 7) AS dec FROM c"
)
def sip_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _rows(spark, sf_dir, "events", "event_id AS id", "CAST(event_id % 800 AS DOUBLE) AS x", "CAST((event_id * 7) % 600 AS DOUBLE) AS y")
    ra, dec = SIP.to_world(F.col("x"), F.col("y"))
    return p.select("id", F.round(ra, 7).alias("ra"), F.round(dec, 7).alias("dec"))


@query(
    "WITH " + FRAME + ", m AS (SELECT f, y, x, ((x - 3e0) * cos(radians(30e0)) + (y - 4e0) * sin(radians(30e0))) / 3.5e0 AS u, ((y - 4e0) * cos(radians(30e0)) - (x - 3e0) * sin(radians(30e0))) / 2e0 AS w FROM v_frame) "
    "SELECT f, y, x, u * u + w * w <= 1 OR (x >= 5 AND x < 7 AND y >= 1 AND y < 3) AS protected FROM m"
)
def protected_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pixels.protected(frames(spark, sf_dir), (3.0, 4.0, 3.0, 1.5, 30.0), None, 0.5).withColumnRenamed("protected", "e")
    m = pixels.protected(m, None, [(4.5, 0.5), (6.5, 0.5), (6.5, 2.5), (4.5, 2.5)])
    return m.select("f", "y", "x", (F.col("e") | F.col("protected")).alias("protected"))


# --- catalogue tables

@query("WITH r AS (SELECT l_partkey AS id, l_suppkey % 3 AS record_id, l_returnflag AS source, l_linestatus AS property FROM lineitem), g AS (SELECT id, record_id, source, count(*) AS n FROM r GROUP BY ALL) SELECT id, count(*) AS records, CAST(sum(n) AS BIGINT) AS properties, min(concat(record_id, source)) AS first FROM g GROUP BY id")
def detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir, "lineitem", "l_partkey AS id", "l_suppkey % 3 AS record_id", "l_returnflag AS source", "l_linestatus AS property", "CAST(l_quantity AS STRING) AS value", "'u' AS unit")
    d = catalog.details(r)
    s = F.col("source_records")
    return d.select("id", F.size(s).cast("long").alias("records"), F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + F.size(x["properties"])).alias("properties"), F.concat(s[0]["record_id"].cast("string"), s[0]["source"]).alias("first"))


_ALT = "[concat('a', CAST(p_partkey % 700 AS VARCHAR)), concat('b', CAST(p_partkey AS VARCHAR))]"


@query(
    f"WITH o AS (SELECT concat('p', CAST(p_partkey AS VARCHAR)) AS id, {_ALT} AS alt FROM part), a AS (SELECT alt, min(id) AS id FROM (SELECT id, unnest(alt) AS alt FROM o) GROUP BY alt HAVING count(DISTINCT id) = 1), "
    "r AS (SELECT DISTINCT concat(CASE l_partkey % 4 WHEN 0 THEN 'p' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'z' END, CAST(l_partkey AS VARCHAR)) AS rid FROM lineitem) SELECT rid AS record_id, coalesce(o.id, a.id) AS id FROM r LEFT JOIN o ON o.id = rid LEFT JOIN a ON a.alt = rid"
)
def record_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _rows(spark, sf_dir, "part", "concat('p', p_partkey) AS id", "array(concat('a', p_partkey % 700), concat('b', p_partkey)) AS alternate_ids")
    r = _rows(spark, sf_dir, "lineitem", "concat(CASE l_partkey % 4 WHEN 0 THEN 'p' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'z' END, l_partkey) AS record_id").distinct()
    return catalog.attach(r, o)


@query(
    "SELECT coalesce(p_partkey, o) AS id, coalesce(n, p_name) AS name, coalesce(b, p_brand) AS brand FROM part FULL JOIN (SELECT c_custkey * 3 AS o, c_custkey % 5 = 0 AS gone, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS n, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS b FROM customer) ON p_partkey = o WHERE NOT coalesce(gone, false)"
)
def curated_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _rows(spark, sf_dir, "customer", "c_custkey * 3 AS id", "c_custkey % 5 = 0 AS remove", "CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name", "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS brand")
    return catalog.curate(_rows(spark, sf_dir, "part", "p_partkey AS id", "p_name AS name", "p_brand AS brand"), o, ["name", "brand"])


@query("SELECT CAST(sum(2) AS BIGINT) AS aliases, CAST(sum(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS alternate_ids, count(*) FILTER (p_partkey * 2 NOT IN (SELECT p_partkey FROM part)) AS unresolved_parents FROM part")
def catalog_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _rows(spark, sf_dir, "part", "p_partkey AS id", "array(p_name, p_brand) AS a", "CASE WHEN p_partkey % 2 = 0 THEN array(p_type) ELSE array() END AS b", "array(p_partkey * 2) AS c")
    return catalog.audit(o, "a", "b", "c")


@query(
    "SELECT 'tile-without-object' AS rule, count(*) AS n FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'name-without-object', count(*) FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'object-without-name', count(*) FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 = 0"
)
def index_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of a damaged index: a tenth of the objects is gone, a seventh of the names."""
    o = _rows(spark, sf_dir, "part", "p_partkey AS id")
    return catalog.index_violations(o.where("id % 10 <> 0"), o.withColumn("tile", F.lit(1)), o.where("id % 7 <> 0 OR id % 10 = 0").withColumn("key", F.lit("k")))


@query("WITH r AS (SELECT DISTINCT c_nationkey % 4 AS namespace, CAST(c_custkey % 300 AS BIGINT) AS value, CAST(c_custkey % 300 AS DOUBLE) AS ra FROM customer) SELECT namespace, count(*) AS n, min(value) AS low, max(value) AS high FROM r GROUP BY namespace")
def identifier_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir, "customer", "c_nationkey % 4 AS namespace", "CAST(c_custkey % 300 AS BIGINT) AS value", "CAST(c_custkey % 300 AS DOUBLE) AS ra", "0e0 AS dec", "1e0 AS mag")
    return catalog.identifier_rows(r).groupBy("namespace").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("WITH o AS (SELECT event_id, event_id * 7919 % 1000 AS k, floor(event_id / 1000000) AS g FROM events), p AS (SELECT k, lag(k) OVER (PARTITION BY g ORDER BY event_id) AS b FROM o) SELECT count(*) FILTER (b > k) AS out_of_order FROM p")
def key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unsorted_keys(_rows(spark, sf_dir, "events", "event_id", "event_id * 7919 % 1000 AS k"), ["k"], "event_id")


@query(
    cte("v_orbit") + ", b AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'comet' ELSE 'asteroid' END AS kind, CASE WHEN id % 50 = 0 THEN '' ELSE 'n' END AS name, CASE WHEN id % 9 = 0 THEN 1e0 + e ELSE e END AS e, CASE WHEN id % 33 = 0 THEN 0e0 ELSE a END AS q, CASE WHEN id % 21 = 0 THEN NULL ELSE incl END AS i FROM v_orbit), "
    "r AS (SELECT 'empty_name' AS rule FROM b WHERE name = '' UNION ALL SELECT 'bad_shape' FROM b WHERE e < 0 OR q <= 0 UNION ALL SELECT 'open_asteroid' FROM b WHERE kind = 'asteroid' AND e >= 1 UNION ALL SELECT 'bad_angle' FROM b WHERE i IS NULL OR i < 0 OR i > 180) SELECT rule, count(*) AS n FROM r GROUP BY rule"
)
def body_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = view(spark, sf_dir, "v_orbit").selectExpr("CASE WHEN id % 4 = 0 THEN 'comet' ELSE 'asteroid' END AS kind", "CASE WHEN id % 50 = 0 THEN '' ELSE 'n' END AS name", "CASE WHEN id % 9 = 0 THEN 1e0 + e ELSE e END AS eccentricity", "CASE WHEN id % 33 = 0 THEN 0e0 ELSE a END AS q_or_a", "CASE WHEN id % 21 = 0 THEN NULL ELSE incl END AS inclination_deg")
    return catalog.body_violations(b)


_GRID = catalog.GRID


@query(cte("v_object") + f", b AS (SELECT id, ra, least(CAST(floor((dec + 90e0) / 180e0 * {_GRID.bands}) AS INTEGER), {_GRID.bands - 1}) AS band FROM v_object), t AS (SELECT id, {_GRID.offsets!r}[band + 1] + least(CAST(floor(ra / 360e0 * {_GRID.bins!r}[band + 1]) AS INTEGER), {_GRID.bins!r}[band + 1] - 1) AS tile FROM b) SELECT tile, count(*) AS n, min(id) AS first_id FROM t GROUP BY tile")
def object_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile table of objects without extent: their own tile only."""
    o = view(spark, sf_dir, "v_object")
    rows = catalog.tile_rows(o.withColumn("major_arcmin", F.lit(None).cast("double"))).join(o.select("id", "ra", "dec"), "id").where(F.col("tile") == _GRID.tile(F.col("ra"), F.col("dec")))
    return rows.groupBy("tile").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(cte("v_object") + ", k AS (SELECT id, source, unnest([upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')), CASE WHEN common_name <> '' THEN upper(regexp_replace(common_name, '[^A-Za-z0-9]', '', 'g')) END]) AS key FROM v_object) SELECT DISTINCT id, source, regexp_replace(key, '^([^0-9]*)0+([0-9])', '\\1\\2') AS key FROM k WHERE key IS NOT NULL")
def designation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.designations(view(spark, sf_dir, "v_object"), ["name", "common_name"])


# --- artifacts, runs


@query("SELECT array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS missing, count(DISTINCT p_brand) AS n FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey <= 12)")
def missing_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _rows(spark, sf_dir, "part", "p_partkey", "p_brand AS name")
    return merge.missing(p, p.where("p_partkey <= 12"), "name")


@query("SELECT event_id AS ord, CAST((event_id * 13) % 5000 AS DOUBLE) AS t FROM events WHERE abs((event_id * 13) % 5000 - 2500e0) <= 40 ORDER BY abs((event_id * 13) % 5000 - 2500e0), event_id DESC LIMIT 1")
def manifest_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.nearest_entry(_rows(spark, sf_dir, "events", "event_id AS ord", "CAST((event_id * 13) % 5000 AS DOUBLE) AS t"), 2500.0, 40.0).select("ord", "t")


_FILES = "concat('f', CAST(p_partkey % 1000 AS VARCHAR(9))) AS name, concat('k', CAST(p_partkey AS VARCHAR(9))) AS key, CAST(p_size AS BIGINT) - 1 AS bytes, CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE sha256(p_name) END AS sha256"


@query(
    f"WITH f AS (SELECT {_FILES} FROM part), r AS (SELECT 'bad-size' AS rule FROM f WHERE bytes <= 0 UNION ALL SELECT 'bad-hash' FROM f WHERE sha256 = 'x' UNION ALL SELECT 'repeated-name' FROM (SELECT name FROM f GROUP BY name HAVING count(*) > 1)) SELECT rule, count(*) AS n FROM r GROUP BY rule"
)
def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _rows(spark, sf_dir, "part", "concat('f', p_partkey % 1000) AS name", "concat('k', p_partkey) AS key", "CAST(p_size AS BIGINT) - 1 AS bytes", "CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE sha2(p_name, 256) END AS sha256")
    return manifests.violations(f)


@query("SELECT c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS key FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def manifest_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _rows(spark, sf_dir, "customer", "c_custkey AS name", "c_mktsegment AS key").where("name % 3 = 0")
    return manifests.roll_forward(old, _rows(spark, sf_dir, "customer", "c_custkey AS name", "c_name AS key").where("name % 2 = 0"))


@query(
    "WITH c AS (SELECT event_id AS id, ['offline', 'prefer-cached', 'force', 'refresh'][event_id % 4 + 1] AS p, event_id % 3 > 0 AS h, event_id % 100 AS a, event_id % 7 > 2 AS f FROM events) SELECT id, CASE WHEN p = 'offline' THEN CASE WHEN h THEN 'cached' ELSE 'error' END WHEN p = 'prefer-cached' AND h THEN 'cached' "
    "WHEN p = 'refresh' AND h AND a <= 40 THEN 'cached' WHEN f THEN 'fetched' WHEN p = 'refresh' AND h THEN 'stale' ELSE 'error' END AS done, CASE event_id % 5 WHEN 0 THEN '/arg' WHEN 1 THEN '/env' WHEN 2 THEN '/conf' ELSE '/deep' END AS path FROM c JOIN events ON event_id = id"
)
def cache_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _rows(spark, sf_dir, "events", "event_id AS id", "element_at(array('offline', 'prefer-cached', 'force', 'refresh'), CAST(event_id % 4 + 1 AS INT)) AS p", "event_id % 3 > 0 AS h", "event_id % 100 AS a", "event_id % 7 > 2 AS f", "event_id % 5 AS k", "array(named_struct('depth', 12, 'path', '/flat'), named_struct('depth', 17, 'path', '/deep')) AS found")
    done = manifests.cache_decision(F.col("p"), F.col("h"), F.col("a"), F.lit(40), F.col("f"))
    path = manifests.resolve_path(F.when(F.col("k") == 0, "/arg"), F.when(F.col("k") <= 1, " /env ").otherwise(" "), F.when(F.col("k") <= 2, "/conf"), F.col("found"))
    return e.select("id", done.alias("done"), path.alias("path"))


@query("WITH s AS (SELECT user_id AS provider, CAST(event_id AS DOUBLE) AS t FROM events), n AS (SELECT *, max(t) OVER (PARTITION BY provider) AS newest FROM s) SELECT provider, t, t = newest AND 10000e0 - t > 2000 AS due FROM n WHERE 10000e0 - t <= 5000 OR t = newest")
def rolling_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.rolling(_rows(spark, sf_dir, "events", "user_id AS provider", "CAST(event_id AS DOUBLE) AS t"), 10000.0, 5000.0, 2000.0)


@query("SELECT count(*) AS frames, count(*) FILTER (o_orderkey % 17 = 0) AS failed, count(*) FILTER (o_orderkey % 17 <> 0 AND o_orderkey % 5 = 0) AS rejected, count(*) FILTER (o_orderkey % 17 <> 0 AND o_orderkey % 5 <> 0) AS integrated FROM orders")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.report(_rows(spark, sf_dir, "orders", "CASE WHEN o_orderkey % 17 = 0 THEN 'unreadable' END AS error", "CASE WHEN o_orderkey % 5 = 0 THEN 'rms' END AS rejected_code"))


_GATES = {"channels": "CAST(CASE WHEN l_suppkey % 20 = 0 THEN 1 ELSE 3 END AS INT)", "expected_channels": "3", "matches": "CASE WHEN l_partkey % 15 = 0 THEN NULL ELSE 9 END", "rms": "l_discount * 25e0", "scale": "1e0 + l_tax - 0.02e0", "rotation": "CAST(l_orderkey % 360 AS DOUBLE) / 20e0 + 176e0", "overlap": "0.5e0 + l_quantity / 50e0", "gain": "CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_quantity / 10e0 END", "surviving": "0.3e0 + l_quantity / 60e0"}


@query(
    f"WITH g AS (SELECT l_orderkey AS o, l_linenumber AS n, {', '.join(f'{e} AS {c}' for c, e in _GATES.items())} FROM lineitem), r AS (SELECT *, least(rotation - 180 * floor(rotation / 180), 180 - (rotation - 180 * floor(rotation / 180))) AS turn FROM g) "
    "SELECT o, n, CASE WHEN channels <> expected_channels THEN 'channels' WHEN matches IS NULL THEN 'registration' WHEN rms > 2 THEN 'rms' WHEN abs(scale - 1) > 0.04e0 THEN 'scale' WHEN turn > 10 THEN 'rotation' WHEN overlap < 0.6e0 THEN 'overlap' WHEN gain IS NULL THEN 'normalization' WHEN gain < 0.25e0 OR gain > 4 THEN 'gain' WHEN surviving < 0.5e0 THEN 'surviving' END AS code FROM r"
)
def admission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _rows(spark, sf_dir, "lineitem", "l_orderkey AS o", "l_linenumber AS n", *[f"{e} AS {c}" for c, e in _GATES.items()])
    return g.withColumn("r", admission.reason()).select("o", "n", F.col("r.code").alias("code"))


@query("SELECT l_orderkey AS f, round(count(*) FILTER (l_quantity < 30) / count(*), 9) AS surviving, count(*) FILTER (l_quantity < 30) >= 0.5e0 * count(*) AS integrate FROM lineitem GROUP BY l_orderkey")
def surviving_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = admission.surviving(_rows(spark, sf_dir, "lineitem", "l_orderkey AS f", "l_quantity >= 30 AS rejected"))
    return s.select("f", F.round("surviving", 9).alias("surviving"), "integrate")


@query("SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) > 1 AS duplicate FROM orders")
def duplicate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _rows(spark, sf_dir, "orders", "o_orderkey AS id", "concat(o_custkey, '/', o_orderstatus) AS path")
    return admission.distinct_inputs(o, "path", "id").select("id", "duplicate")


@query(cte("v_exposure") + " SELECT count(*) FILTER (abs(t - 1704100000e0) <= 20000) AS fresh, count(*) FILTER (NOT abs(t - 1704100000e0) <= 20000) AS stale FROM v_exposure")
def fresh_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    young, old = tracks.fresh(view(spark, sf_dir, "v_exposure"), "t", 1704100000.0, 20000.0)
    return young.agg(F.count("*").alias("fresh")).crossJoin(old)  # one row each


# --- samples, fits, neighbours


@query("SELECT event_id AS id, value FROM events WHERE event_id % 4 = 0")
def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded sample is the operator's feature: every fourth position."""
    return stats.strided(_rows(spark, sf_dir, "events", "event_id AS id", "value"), "id", 4000, 1000)


@query(
    "WITH " + FRAME + ", s AS (SELECT y, x, count(*) AS n, avg(v) AS mean, var_pop(v) * count(*) AS m2 FROM v_frame GROUP BY y, x), j AS (SELECT f, v, n, (n * mean - v) / (n - 1) AS om, sqrt(greatest(m2 - (v - mean) * (v - (n * mean - v) / (n - 1)), 0) / (n - 2)) AS sg FROM v_frame JOIN s USING (y, x)) "
    "SELECT f, count(*) FILTER (NOT (v - om < -1.5e0 * sg OR v - om > 1.5e0 * sg)) AS accepted, count(*) FILTER (v - om < -1.5e0 * sg OR v - om > 1.5e0 * sg) AS rejected FROM j GROUP BY f"
)
def master_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return pixels.master_tallies(f, None, 1.5, 1.5)


_PAIR = "c_custkey % 40 AS g, CAST(c_custkey % 97 AS DOUBLE) AS x, CAST((c_custkey * 31) % 89 AS DOUBLE) AS y"


@query(
    f"WITH p AS (SELECT {_PAIR}, c_custkey FROM customer), q AS (SELECT g, x, y, 2e0 * x - 0.5e0 * y + 3 + (c_custkey % 5) / 10e0 AS u, 0.5e0 * x + 2e0 * y - 7 + (c_custkey % 3) / 10e0 AS v FROM p), c AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(x) + var_pop(y) AS d, covar_pop(x, u) + covar_pop(y, v) AS p, covar_pop(x, v) - covar_pop(y, u) AS q FROM q GROUP BY g), "
    "k AS (SELECT g, n, p / d AS a, q / d AS b, mu - p / d * mx + q / d * my AS tx, mv - q / d * mx - p / d * my AS ty FROM c WHERE d > 0) SELECT g, any_value(n) AS n, round(any_value(a), 6) AS a, round(any_value(b), 6) AS b, round(any_value(tx), 5) AS tx, round(any_value(ty), 5) AS ty, "
    "round(sqrt(avg((a * x - b * y + tx - u) * (a * x - b * y + tx - u) + (b * x + a * y + ty - v) * (b * x + a * y + ty - v))), 6) AS rms FROM q JOIN k USING (g) GROUP BY g"
)
def similarity_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey % 40 AS g", "CAST(c_custkey % 97 AS DOUBLE) AS x", "CAST((c_custkey * 31) % 89 AS DOUBLE) AS y", "c_custkey")
    p = p.selectExpr("g", "x", "y", "2e0 * x - 0.5e0 * y + 3 + (c_custkey % 5) / 10e0 AS u", "0.5e0 * x + 2e0 * y - 7 + (c_custkey % 3) / 10e0 AS v")
    f = solving.similarity_fit(p, ["g"])
    return f.select("g", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("tx", 5).alias("tx"), F.round("ty", 5).alias("ty"), F.round("rms", 6).alias("rms"))


@query(
    "WITH p AS (SELECT p_partkey % 7 AS g, p_partkey AS id, CAST((p_partkey * 37) % 1000 AS DOUBLE) AS x, CAST((p_partkey * 61) % 997 AS DOUBLE) AS y FROM part), j AS (SELECT a.g, a.id, b.id AS near, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY d, near) AS rank FROM j WHERE d <= 150) SELECT g, id, near, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4"
)
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _rows(spark, sf_dir, "part", "p_partkey % 7 AS g", "p_partkey AS id", "CAST((p_partkey * 37) % 1000 AS DOUBLE) AS x", "CAST((p_partkey * 61) % 997 AS DOUBLE) AS y")
    return spatial.nearest_neighbours(p, ["g"], 4, 150.0).withColumn("distance", F.round("distance", 6))


@query("WITH " + FRAME + " SELECT f, y, x, round(CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 4 THEN v / ((x + y) / 10e0) ELSE v END, 6) AS v FROM v_frame")
def residual_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.range(16).selectExpr("CAST(id DIV 4 AS INT) AS y", "CAST(id % 4 AS INT) AS x", "(id DIV 4 + id % 4 + 3) / 10e0 AS v")
    return pixels.apply_response(frames(spark, sf_dir), r, 2, 1).select("f", "y", "x", R("v"))


@query("WITH " + FRAME + " SELECT f, round(sum(v), 6) AS input_flux, round(max(v), 6) AS input_peak, round(sum(v * 2 - 0.1e0), 6) AS output_flux, round(max(v * 2 - 0.1e0), 6) AS output_peak FROM v_frame GROUP BY f")
def channel_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    d = pixels.channel_diagnostics(f, f.withColumn("v", F.col("v") * 2 - 0.1))
    return d.select("f", *[F.round(c, 6).alias(c) for c in ("input_flux", "input_peak", "output_flux", "output_peak")])


@query(
    "SELECT 'missing-pattern' AS rule, count(*) AS n FROM lineitem WHERE l_partkey % 13 = 0 HAVING count(*) > 0 UNION ALL SELECT 'repeated-candidate', count(*) FROM (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'invalid-geometry', count(*) FROM part WHERE p_partkey % 13 <> 0 AND (p_size = 1 OR p_partkey % 29 = 0)"
)
def pattern_index_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _rows(spark, sf_dir, "part", "p_partkey AS pattern_id", "CAST(p_size AS DOUBLE) - 1e0 AS max_edge_deg", "array(named_struct('x', CASE WHEN p_partkey % 29 = 0 THEN double('NaN') ELSE 1e0 END, 'y', 2e0)) AS points").where("pattern_id % 13 <> 0")
    return solving.index_violations(p, _rows(spark, sf_dir, "lineitem", "l_suppkey AS key", "l_partkey AS pattern_id"))


@query("SELECT (SELECT count(*) FROM part) AS patterns, (SELECT CAST(max(p_size) AS DOUBLE) FROM part) AS max_pattern_deg, count(DISTINCT l_suppkey) AS keys, count(*) AS candidates, count(*) > 2 * (SELECT count(*) FROM part) AS mismatch FROM lineitem")
def pattern_index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _rows(spark, sf_dir, "part", "p_partkey AS pattern_id", "CAST(p_size AS DOUBLE) AS max_edge_deg")
    s = solving.index_statistics(p, _rows(spark, sf_dir, "lineitem", "l_suppkey AS key", "l_partkey AS pattern_id"))
    return s.withColumn("mismatch", solving.catalog_mismatch(F.col("candidates"), F.col("patterns")))


# --- formats

_OMM = "concat('{{\"NORAD_CAT_ID\": ', {k}, ', \"OBJECT_NAME\": \"n', {k}, '\", \"EPOCH\": \"2024-01-0', {k} % 9 + 1, 'T06:00:00.5Z\", \"INCLINATION\": ', {k} % 90, '.25, \"MEAN_MOTION\": 15.5}}')"


@query("SELECT CAST(c_custkey AS INTEGER) AS norad_id, concat('n', c_custkey) AS name, 1704067200e0 + (c_custkey % 9) * 86400 + 21600.5e0 AS epoch, c_custkey % 90 + 0.25e0 AS inclination, 15.5e0 AS motion, 'json' AS format FROM customer WHERE c_custkey % 10 > 0")
def omm_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element sets of JSON texts: single objects and arrays; a tenth of them is broken."""
    one = _OMM.format(k="c_custkey")
    t = _rows(spark, sf_dir, "customer", f"CASE c_custkey % 10 WHEN 0 THEN '{{\"OBJECT_NAME\": \"x\"}}' WHEN 1 THEN concat('[', {one}, ']') ELSE {one} END AS value")
    return elements.omm(t.where(elements.sniff(F.col("value")) == "json")).select(F.col("norad_id").cast("int").alias("norad_id"), "name", "epoch", "inclination", "motion", F.lit("json").alias("format"))


def _fits_bytes(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        blobs = [fits.encode(np.array(v, np.float32).reshape(8, 8), [("OBJECT", f"frame {k}"), ("GAIN", int(k))]) for k, v in zip(*(batch.column(i).to_pylist() for i in range(2)))]
        yield pa.RecordBatch.from_pydict({"f": batch.column(0), "content": blobs})


def _fits_pixels(batches):
    import pyarrow as pa

    for batch in batches:
        rows = {"f": [], "object": [], "gain": [], "width": [], "data": []}
        for k, blob in zip(*(batch.column(i).to_pylist() for i in range(2))):
            image = fits.decode(blob)
            cards = {c: v for c, _, v in image["cards"]}
            for name, value in (("f", k), ("object", cards["OBJECT"]), ("gain", int(fits.first(image["cards"], "GAIN"))), ("width", image["width"]), ("data", image["data"].tolist())):
                rows[name].append(value)
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("f", pa.int64()), ("object", pa.string()), ("gain", pa.int64()), ("width", pa.int64()), ("data", pa.list_(pa.float32()))]))


@query("SELECT vec_id AS f, concat('frame ', vec_id) AS object, vec_id AS gain, CAST(8 AS BIGINT) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM embeddings")
def fits_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as FITS bytes with cards and read back."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    back = e.mapInArrow(_fits_bytes, "f long, content binary").mapInArrow(_fits_pixels, T.StructType.fromDDL("f long, object string, gain long, width long, data array<float>"))
    return back.select("f", "object", "gain", "width", F.round(F.col("data")[0].cast("double"), 6).alias("first"), F.round(F.col("data")[63].cast("double"), 6).alias("last"))
