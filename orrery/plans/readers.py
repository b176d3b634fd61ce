"""Bindings of the text readers: catalogue lines made from the driver's tables, read back, against the values they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels
from ..sources import catalogs
from .registry import query
from .sequences import FRAME, R, frames
from .views import table


def _lines(spark: SparkSession, sf_dir: str, name: str, line: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(f"{line} AS value")


@query(
    "WITH s AS (SELECT (c_custkey % 1400) * 0.25e0 AS ra, (c_custkey % 170) * 0.5e0 - 85e0 AS dec, CASE WHEN c_custkey % 3 = 0 THEN 0e0 ELSE (c_custkey % 7) * 100e0 END AS pa, (c_custkey % 5) * 100e0 - 200e0 AS pd, (c_custkey % 40) * 0.5e0 AS mag FROM customer WHERE c_custkey % 11 <> 0), "
    "m AS (SELECT ra + pa * 10e0 / 3.6e6 / cos(radians(dec)) AS ra, dec + pd * 10e0 / 3.6e6 AS dec, mag FROM s WHERE mag <= 16) SELECT round(ra, 8) AS ra, round(dec, 8) AS dec, mag FROM m"
)
def gaia_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat_ws(',', CASE WHEN c_custkey % 11 = 0 THEN 'ra' ELSE CAST((c_custkey % 1400) * 0.25e0 AS STRING) END, CAST((c_custkey % 170) * 0.5e0 - 85e0 AS STRING), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST((c_custkey % 7) * 100e0 AS STRING) END, CAST((c_custkey % 5) * 100e0 - 200e0 AS STRING), CAST((c_custkey % 40) * 0.5e0 AS STRING))"
    return catalogs.gaia_csv(_lines(spark, sf_dir, "customer", line), 2026.0, 16.0).select(F.round("ra", 8).alias("ra"), F.round("dec", 8).alias("dec"), "mag")


@query("SELECT CAST(p_partkey AS INTEGER) AS number, p_name AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_size + 0.5e0 END AS size FROM part WHERE p_partkey % 6 <> 0")
def tabbed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat_ws('\\t', CASE WHEN p_partkey % 6 = 0 THEN '#' ELSE '' END || CAST(p_partkey AS STRING) || ' ', p_name, CASE WHEN p_partkey % 4 = 0 THEN '---' ELSE CAST(p_size + 0.5e0 AS STRING) END)"
    return catalogs.vizier_tsv(_lines(spark, sf_dir, "part", line), [("number", "int"), ("name", "string"), ("size", "double")], ["number"])


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS kind, 1 + CASE WHEN p_partkey % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS n FROM part")
def property_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat(CAST(p_partkey AS STRING), ';', CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_brand END, CASE WHEN p_partkey % 2 = 0 THEN concat('; ', p_type) ELSE '' END)"
    p = F.col("properties")
    return catalogs.property_bag(_lines(spark, sf_dir, "part", line), ["Id", "Brand", "Type"]).select(p["Id"].alias("id"), p["Brand"].alias("brand"), p["Type"].alias("kind"), F.size(p).alias("n"))


@query("SELECT concat('Star ', CAST(c_custkey AS VARCHAR)) AS name, (c_custkey % 1400) * 0.25e0 AS ra, (c_custkey % 170) * 0.5e0 - 85e0 AS dec, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 40) * 0.5e0 END AS mag, concat('iau-csn:Star ', CAST(c_custkey AS VARCHAR)) AS id FROM customer WHERE c_custkey % 5 <> 0")
def star_name_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat(CASE WHEN c_custkey % 5 = 0 THEN '# ' ELSE '' END, rpad(concat('Star ', CAST(c_custkey AS STRING)), 18, ' '), ' HR 1 And ', CASE WHEN c_custkey % 4 = 0 THEN '_' ELSE CAST((c_custkey % 40) * 0.5e0 AS STRING) END, ' V 1 2 ', CAST((c_custkey % 1400) * 0.25e0 AS STRING), ' ', CAST((c_custkey % 170) * 0.5e0 - 85e0 AS STRING), ' 2016-07-20')"
    return catalogs.iau_names(_lines(spark, sf_dir, "customer", line))


@query(
    "SELECT concat('C/', CAST(c_custkey AS VARCHAR)) AS name, epoch(make_date(2020, CAST(c_custkey % 12 + 1 AS INTEGER), 10)) / 86400e0 + 2440588e0 AS epoch_jd, 0.5e0 + c_custkey % 9 AS q, (c_custkey % 20) * 0.0625e0 AS e, c_custkey % 180 + 0.25e0 AS incl, c_custkey % 360 + 0.5e0 AS node, c_custkey % 300 + 0.75e0 AS argp, "
    "CASE WHEN c_custkey % 6 = 0 THEN 12e0 ELSE c_custkey % 20 + 0.5e0 END AS h, 4e0 AS slope FROM customer"
)
def comet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda e, w: f"lpad(CAST({e} AS STRING), {w}, ' ')"
    line = (
        f"concat(repeat(' ', 14), '2020 ', lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0'), ' 10.5000 ', {n('0.5e0 + c_custkey % 9', 9)}, ' ', {n('(c_custkey % 20) * 0.0625e0', 9)}, '  ', {n('c_custkey % 300 + 0.75e0', 8)}, '  ', {n('c_custkey % 360 + 0.5e0', 8)}, '  ', {n('c_custkey % 180 + 0.25e0', 8)}, repeat(' ', 12), "
        f"CASE WHEN c_custkey % 6 = 0 THEN '    ' ELSE {n('c_custkey % 20 + 0.5e0', 4)} END, ' ', ' 4.0', '  ', 'C/', CAST(c_custkey AS STRING))"
    )
    c = catalogs.comets(_lines(spark, sf_dir, "customer", line))
    return c.select("name", "epoch_jd", F.col("q_or_a").alias("q"), F.col("eccentricity").alias("e"), F.col("inclination_deg").alias("incl"), F.col("node_deg").alias("node"), F.col("arg_perihelion_deg").alias("argp"), F.col("h_mag").alias("h"), "slope")


@query(
    "SELECT CASE c_custkey % 3 WHEN 0 THEN concat('(', c_custkey % 100000, ') Ceres') WHEN 1 THEN 'Vesta' ELSE concat('(', c_custkey % 100000, ')') END AS name, epoch(make_date(2024, 3, CAST(c_custkey % 28 + 1 AS INTEGER))) / 86400e0 + 2440587.5e0 AS epoch_jd, 2.5e0 + c_custkey % 9 AS a, (c_custkey % 15) * 0.0625e0 AS e, "
    "c_custkey % 90 + 0.25e0 AS incl, c_custkey % 20 + 0.5e0 AS h FROM customer WHERE c_custkey % 20 + 0.5e0 <= 15"
)
def asteroid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda e, w: f"lpad(CAST({e} AS STRING), {w}, ' ')"
    day = "substring('123456789ABCDEFGHIJKLMNOPQRSTUV', CAST(c_custkey % 28 + 1 AS INT), 1)"
    line = (
        f"concat(lpad(CAST(c_custkey % 100000 AS STRING), 5, '0'), '   ', {n('c_custkey % 20 + 0.5e0', 5)}, ' ', ' 0.15', ' ', 'K243', {day}, ' ', {n('c_custkey % 360 + 0.5e0', 9)}, '  ', {n('c_custkey % 300 + 0.75e0', 9)}, '  ', {n('c_custkey % 200 + 0.25e0', 9)}, '  ', {n('c_custkey % 90 + 0.25e0', 9)}, '  ', {n('(c_custkey % 15) * 0.0625e0', 9)}, repeat(' ', 13), {n('2.5e0 + c_custkey % 9', 11)}, repeat(' ', 63), "
        "CASE c_custkey % 3 WHEN 0 THEN concat(CAST(c_custkey % 100000 AS STRING), ' Ceres') WHEN 1 THEN 'Vesta' ELSE '' END)"
    )
    c = catalogs.asteroids(_lines(spark, sf_dir, "customer", line), 15.0)
    return c.select("name", "epoch_jd", F.col("q_or_a").alias("a"), F.col("eccentricity").alias("e"), F.col("inclination_deg").alias("incl"), F.col("h_mag").alias("h"))


@query("SELECT event_id AS id, CAST((event_id % 62) * 10000 + event_id % 10000 AS BIGINT) AS number, epoch(make_date(CAST(2000 + event_id % 100 AS INTEGER), CAST(event_id % 12 + 1 AS INTEGER), CAST(event_id % 28 + 1 AS INTEGER))) / 86400e0 + 2440587.5e0 AS jd FROM events")
def packed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = "substring('123456789ABCDEFGHIJKLMNOPQRSTUV', CAST(event_id % {n} + 1 AS INT), 1)"
    e = table(spark, sf_dir, "events").selectExpr("event_id AS id", f"concat(substring('{catalogs._ALPHABET}', CAST(event_id % 62 + 1 AS INT), 1), lpad(CAST(event_id % 10000 AS STRING), 4, '0')) AS n", f"concat('K', lpad(CAST(event_id % 100 AS STRING), 2, '0'), {code.format(n=12)}, {code.format(n=28)}) AS d")
    return e.select("id", catalogs.unpack_number(F.col("n")).cast("bigint").alias("number"), catalogs.unpack_epoch(F.col("d")).alias("jd"))


@query(
    "SELECT CASE WHEN s_suppkey % 2 = 0 THEN concat('AT2024x', s_suppkey) ELSE concat('SN 2024y', s_suppkey) END AS name, (s_suppkey % 24 + 0.5e0) * 15e0 AS ra, -(s_suppkey % 80 + 0.25e0) AS dec, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 20 + 0.5e0 END AS mag, "
    "array_to_string(list_filter([CASE WHEN s_suppkey % 3 <> 0 THEN 'type Ia' END, 'disc. 2024/01/02', CASE WHEN s_suppkey % 4 <> 0 THEN 'in NGC 1' END], lambda x: x IS NOT NULL), ', ') AS common_name FROM supplier WHERE s_suppkey % 7 <> 0"
)
def transient_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ["CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN concat('AT2024x', s_suppkey) ELSE concat('2024y', s_suppkey) END", "CASE WHEN s_suppkey % 4 = 0 THEN 'none' ELSE 'NGC 1' END", "concat(s_suppkey % 24, ':30:00')", "concat('-', s_suppkey % 80, ':15:00')", "'x'", "CASE WHEN s_suppkey % 5 = 0 THEN '?' ELSE concat(s_suppkey % 20, '.5*') END", "''", "CASE WHEN s_suppkey % 3 = 0 THEN 'unk' ELSE '<b>Ia</b>' END", "''", "''", "''", "'2024/01/02'"]
    html = "concat('<table><tr><th>Name</th></tr><tr class=a>', " + ", ".join(f"'<td>', {c}, '</td>'" for c in cells) + ", '</tr></table>') AS html"
    return catalogs.transients(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS page_id", html))


# --- luminance and depth


@query("WITH " + FRAME + " SELECT f, y, x, round(0.2126e0 * v + 0.7152e0 * v * v + 0.0722e0 * (v + 1), 6) AS rec709, round((v + 2 * v * v + v + 1) / 4e0, 6) AS bayer, round((v + v * v + v + 1) / 3e0, 6) AS mean FROM v_frame")
def luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frames(spark, sf_dir).select("f", "y", "x", F.col("v").alias("r"), (F.col("v") * F.col("v")).alias("g"), (F.col("v") + 1).alias("b"))
    return p.select("f", "y", "x", *[F.round(pixels.luma(k), 6).alias(k) for k in ("rec709", "bayer", "mean")])


@query("WITH " + FRAME + ", s AS (SELECT f, list_sort(list(v)) AS s, median(v) AS m FROM v_frame WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY f) SELECT f, round(m, 6) AS background, round(list_avg(s[least(CAST(trunc(len(s) * 0.99e0) AS INTEGER), len(s) - 1) + 1:]) - m, 6) AS signal FROM s")
def depth_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.depth_snr(frames(spark, sf_dir)).select("f", R("background"), R("signal"))
