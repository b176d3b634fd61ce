"""The session factory: settings the operators expect, all overridable."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(name: str = "orrery", master: str | None = None, **conf: str) -> SparkSession:
    """A session; on a cluster ``master`` and the sizes come from the submit command."""
    builder = SparkSession.builder.appName(name)
    if master:
        cores = master[6:-1] if master.startswith("local[") else ""
        builder = builder.master(master).config("spark.sql.shuffle.partitions", cores if cores.isdigit() else str(os.cpu_count() or 4)).config("spark.driver.memory", "8g")
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
