"""Bindings of the operators to the driver's tables: each view is a table and expressions valid in Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_POS = "CAST(({k} * {a}) % 360000 AS DOUBLE) / 1000e0"
_DEC = "CAST(({k} * {b}) % 180001 AS DOUBLE) / 1000e0 - 90e0"

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "v_star": ("customer", {"id": "c_custkey", "ra": _POS.format(k="c_custkey", a=137508), "dec": _DEC.format(k="c_custkey", b=61803), "mag": "round(16e0 - c_acctbal / 1000e0, 3)"}),
    "v_center": ("supplier", {"sid": "s_suppkey", "ra0": _POS.format(k="s_suppkey", a=222461), "dec0": _DEC.format(k="s_suppkey", b=75025)}),
    "v_object": (
        "part",
        {
            "id": "p_partkey", "kind": "p_type", "ra": _POS.format(k="p_partkey", a=137508), "dec": _DEC.format(k="p_partkey", b=61803),
            "mag": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(p_retailprice / 100e0, 2) END", "major_arcmin": "CAST(nullif(p_size % 40, 0) AS DOUBLE)",
            "name": "p_name", "common_name": "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END", "source": "p_brand",
        },
    ),
    "v_obs": ("events", {"seq": "event_id", "ts": "ts", "k": "user_id", "v": "value", "kind": "event_type"}),
    "v_exposure": ("orders", {"id": "o_orderkey", "target": "o_custkey % 97", "t": "1704067200 + o_orderkey * 37"}),
    "v_cand": (
        "part",
        {
            "id": "p_partkey", "role": "CASE p_partkey % 3 WHEN 0 THEN 'dark' WHEN 1 THEN 'flat' ELSE 'bias' END", "camera": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat('cam', CAST(p_partkey % 3 AS VARCHAR(10))) END",
            "width": "CAST(nullif(p_partkey % 5, 0) * 1000 AS BIGINT)", "gain": "CAST(nullif(p_partkey % 4, 0) AS BIGINT)", "binning": "CAST(nullif(p_partkey % 3, 0) AS BIGINT)",
            "filt": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('f', CAST(p_partkey % 2 AS VARCHAR(10))) END", "focal": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 500e0 + p_partkey % 4 END",
            "rotation": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST((p_partkey * 7) % 360 AS DOUBLE) END", "exposure": "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(p_size * 10 AS DOUBLE) END",
            "temp": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_partkey % 17 AS DOUBLE) - 10e0 END", "captured": "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 1704067200 + p_partkey * 3607 END",
        },
    ),
    "v_ref": (
        "supplier",
        {
            "rid": "s_suppkey", "camera": "CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE concat('CAM', CAST(s_suppkey % 3 AS VARCHAR(10))) END", "width": "CAST(nullif(s_suppkey % 5, 0) * 1000 AS BIGINT)",
            "gain": "CAST(nullif(s_suppkey % 4, 0) AS BIGINT)", "binning": "CAST(nullif(s_suppkey % 2, 0) AS BIGINT)", "filt": "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE concat('F', CAST(s_suppkey % 2 AS VARCHAR(10))) END",
            "focal": "CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE 500e0 + s_suppkey % 4 END", "rotation": "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST((s_suppkey * 11) % 360 AS DOUBLE) END",
            "exposure": "CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE CAST((s_suppkey % 50) * 10 AS DOUBLE) END", "temp": "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(s_suppkey % 17 AS DOUBLE) - 10e0 END", "captured": "1704067200 + s_suppkey * 80111",
        },
    ),
    "v_orbit": (
        "customer",
        {
            "id": "c_custkey", "a": "0.5e0 + CAST(c_custkey % 300 AS DOUBLE) / 10e0", "e": "CAST((c_custkey * 13) % 900 AS DOUBLE) / 1000e0", "incl": "CAST((c_custkey * 7) % 180 AS DOUBLE)", "node": "CAST((c_custkey * 11) % 360 AS DOUBLE)",
            "argp": "CAST((c_custkey * 17) % 360 AS DOUBLE)", "m0": "CAST((c_custkey * 29) % 360 AS DOUBLE)", "epoch": "2460000.5e0 + CAST(c_custkey % 1000 AS DOUBLE)", "h": "5e0 + CAST(c_custkey % 150 AS DOUBLE) / 10e0",
        },
    ),
    "v_curve": ("events", {"id": "event_id", "x": "least(greatest(value / 490.02e0, 0e0), 1e0)"}),
    "v_pix": ("embeddings", {"f": "vec_id", "label": "label", "data": "embedding"}),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the driver's tables."""
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cte(*names: str) -> str:
    """The same views as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in VIEWS[n][1].items())} FROM {VIEWS[n][0]})" for n in names)
