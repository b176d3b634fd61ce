"""Bindings of what is written and read back: star tiles, the object catalogue, frame files, element sets; objects on an image."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sky import Wcs
from ..operators import catalog, placement, spatial
from ..sources import elements, xisf
from .catalog import CONE, _D, _KEY
from .registry import query
from .views import cte, table, view


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; in local mode one is made if none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not base:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{name}-{spark._jvm.java.util.UUID.randomUUID()}"


@query(cte("v_star") + f" SELECT id, mag FROM v_star WHERE mag <= 12e0 AND {_D} <= {CONE.radius + 1e-10!r}")
def tile_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star tiles written, then read for a cone and a brightness limit."""
    path = shared(spark, "tiles")
    spatial.write_tiles(view(spark, sf_dir, "v_star"), path)
    return spatial.read_tiles(spark, path, CONE, 12.0).select("id", "mag")


@query(cte("v_object") + f", k AS (SELECT *, {_D} AS d FROM v_object) SELECT id, name, round(d, 6) AS distance_deg FROM k WHERE d <= {CONE.radius + 1e-10!r}")
def catalog_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object catalogue written with its tiles and names, then read for a cap."""
    path = shared(spark, "catalog")
    catalog.write(view(spark, sf_dir, "v_object"), path)
    found = catalog.in_cap(spark, path, CONE.ra, CONE.dec, CONE.radius)
    return spatial.region_query(found, CONE, extents=False).select("id", "name", F.round("distance_deg", 6).alias("distance_deg"))


@query(cte("v_object") + f", n AS (SELECT id, unnest([name, CASE WHEN common_name <> '' THEN common_name END]) AS w FROM v_object), c AS (SELECT DISTINCT id, {_KEY.format(k='upper(regexp_replace(w, ' + repr('[^A-Za-z0-9]') + ', ' + repr('') + ', ' + repr('g') + '))')} AS key FROM n WHERE w IS NOT NULL) SELECT key, id FROM c WHERE key LIKE 'SMALLR%' ORDER BY key, id LIMIT 30")
def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty completions of a prefix from the written name table (its feature is the limit)."""
    path = shared(spark, "catalog")
    catalog.write(view(spark, sf_dir, "v_object"), path)
    return catalog.complete(spark, path, "small r", 30).select("key", "id")


def _xisf_bytes(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        kinds = (None, "zlib", "zstd+sh", "zlib+sh", "lz4")
        blobs = [xisf.encode(np.array(v, np.float32).reshape(8, 8), [("OBJECT", f"frame & {k}")], kinds[k % 5]) for k, v in zip(*(batch.column(i).to_pylist() for i in range(2)))]
        yield pa.RecordBatch.from_pydict({"f": batch.column(0), "content": blobs})


def _xisf_pixels(batches):
    import pyarrow as pa

    for batch in batches:
        found = [xisf.decode(blob) for blob in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_pydict({"f": batch.column(0), "object": [dict(tuple(c)[:2] for c in i["cards"])["OBJECT"] for i in found], "width": pa.array([i["width"] for i in found], pa.int64()), "data": pa.array([i["data"].tolist() for i in found], pa.list_(pa.float32()))})


@query("SELECT vec_id AS f, concat('frame & ', vec_id) AS object, CAST(8 AS BIGINT) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM embeddings")
def xisf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as XISF bytes under five compressions and read back."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    back = e.mapInArrow(_xisf_bytes, "f long, content binary").mapInArrow(_xisf_pixels, "f long, object string, width long, data array<float>")
    return back.select("f", "object", "width", F.round(F.col("data")[0].cast("double"), 6).alias("first"), F.round(F.col("data")[63].cast("double"), 6).alias("last"))


def _summed(line: str) -> str:
    """A line of an element set with its check digit."""
    digits = f"aggregate(filter(split(regexp_replace(regexp_replace({line}, '-', '1'), '[^0-9]', ''), ''), d -> d <> ''), 0, (s, d) -> s + CAST(d AS INT))"
    return f"concat({line}, CAST({digits} % 10 AS STRING))"


@query(
    "SELECT CAST(10000 + c_custkey % 80000 AS INTEGER) AS norad_id, concat('SAT ', CAST(c_custkey AS VARCHAR)) AS name, 1704067200e0 + (c_custkey % 300) * 86400e0 + 43200e0 AS epoch, c_custkey % 98 + 0.25e0 AS inclination, (c_custkey % 9000 + 1) / 1e7 AS eccentricity, 15e0 + (c_custkey % 40) * 0.015625e0 AS motion "
    "FROM customer WHERE c_custkey % 13 <> 0"
)
def tle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-line element sets in files of many; one in thirteen has a wrong check digit and goes."""
    number = "lpad(CAST(10000 + c_custkey % 80000 AS STRING), 5, '0')"
    one = f"concat('1 ', {number}, 'U 24001A   24', lpad(CAST(c_custkey % 300 + 1 AS STRING), 3, '0'), '.50000000  .00001000  00000-0  10000-4 0  999')"
    two = f"concat('2 ', {number}, ' ', lpad(CAST(CAST(c_custkey % 98 + 0.25e0 AS DECIMAL(8,4)) AS STRING), 8, ' '), ' 100.0000 ', lpad(CAST(c_custkey % 9000 + 1 AS STRING), 7, '0'), ' 200.0000 300.0000 ', CAST(CAST(15e0 + (c_custkey % 40) * 0.015625e0 AS DECIMAL(10,8)) AS STRING), '00001')"
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_summed(one)} AS a", f"{_summed(two)} AS b")
    c = c.selectExpr("c_custkey", "CASE WHEN c_custkey % 13 = 0 THEN concat(substring(a, 1, 68), CAST((CAST(substring(a, 69, 1) AS INT) + 1) % 10 AS STRING)) ELSE a END AS a", "b")
    files = c.groupBy(F.floor(F.col("c_custkey") / 50).alias("path")).agg(F.array_join(F.collect_list(F.concat_ws("\n", F.concat(F.lit("SAT "), F.col("c_custkey").cast("string")), "a", "b")), "\n").alias("value"))
    return elements.tle(files)[0].select("norad_id", "name", "epoch", "inclination", "eccentricity", "motion")


IMAGE = Wcs.simple(150.0, 35.0, 800.0, 600.0, 60.0, 20.0)
_I = IMAGE.inverse()


@query(
    cte("v_object") + ", c AS (SELECT *, sin(radians(dec)) * sin(radians(35e0)) + cos(radians(dec)) * cos(radians(ra - 150e0)) * cos(radians(35e0)) AS c FROM v_object), t AS (SELECT *, degrees(cos(radians(dec)) * sin(radians(ra - 150e0)) / c) AS xi, degrees((sin(radians(dec)) * cos(radians(35e0)) - cos(radians(dec)) * cos(radians(ra - 150e0)) * sin(radians(35e0))) / c) AS eta FROM c WHERE c > 0), "
    f"p AS (SELECT id, {_I[0]!r} * xi + {_I[1]!r} * eta + 800e0 AS x, {_I[2]!r} * xi + {_I[3]!r} * eta + 600e0 AS y, coalesce(major_arcmin, 0e0) * 0.5e0 AS m FROM t) SELECT id, round(x, 5) AS x, round(y, 5) AS y, round(m, 6) AS semi_major_px FROM p WHERE x >= 0 AND y >= 0 AND x <= 1599 AND y <= 1199"
)
def placed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose centres lie on an image, with their pixel ellipses."""
    o = view(spark, sf_dir, "v_object").withColumns({"minor_arcmin": F.col("major_arcmin") / 2, "position_angle_deg": F.lit(30.0)})
    p = placement.objects_in_footprint(o, IMAGE, 1600, 1200).where("center_inside")
    return p.select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round("semi_major_px", 6).alias("semi_major_px"))
