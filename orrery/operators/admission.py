"""Frame admission: gates in a fixed order, the first that fails gives the reason; and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults of the gates.
LIMITS = {"rms": 2.0, "scale": 0.04, "rotation": 10.0, "overlap": 0.6, "gain_low": 0.25, "gain_high": 4.0, "integrated": 0.5}


def rotation_deviation(degrees: Column) -> Column:
    """Deviation modulo half a turn, so a flipped mount is no deviation."""
    r = F.pmod(degrees, F.lit(180.0))
    return F.least(r, F.lit(180.0) - r)


def reason(limits: dict[str, float] = LIMITS) -> Column:
    """struct<code, measured, limit> of the first failing gate over the columns channels, expected_channels, matches, rms, scale,
    rotation, overlap, gain and surviving; null if all pass."""
    c = F.col

    def fail(bad: Column, code: str, measured: Column, limit: float) -> tuple[Column, Column]:
        return bad, F.struct(F.lit(code).alias("code"), measured.cast("double").alias("measured"), F.lit(float(limit)).alias("limit"))

    gates = [
        fail(c("channels") != c("expected_channels"), "channels", c("channels"), 0), fail(c("matches").isNull(), "registration", F.lit(None), 0), fail(c("rms") > limits["rms"], "rms", c("rms"), limits["rms"]),
        fail(F.abs(c("scale") - 1) > limits["scale"], "scale", c("scale"), limits["scale"]), fail(rotation_deviation(c("rotation")) > limits["rotation"], "rotation", rotation_deviation(c("rotation")), limits["rotation"]),
        fail(c("overlap") < limits["overlap"], "overlap", c("overlap"), limits["overlap"]), fail(c("gain").isNull(), "normalization", c("gain"), 0),
        fail((c("gain") < limits["gain_low"]) | (c("gain") > limits["gain_high"]), "gain", c("gain"), limits["gain_high"]), fail(c("surviving") < limits["integrated"], "surviving", c("surviving"), limits["integrated"]),
    ]
    out = F.when(*gates[0])
    for g in gates[1:]:
        out = out.when(*g)
    return out


def report(frames: DataFrame) -> DataFrame:
    """Integrated, rejected and failed frames, from columns rejected_code and error."""
    return frames.agg(F.count("*").alias("frames"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("error").isNull() & F.col("rejected_code").isNotNull()).alias("rejected"), F.count_if(F.col("error").isNull() & F.col("rejected_code").isNull()).alias("integrated"))


def surviving(samples: DataFrame, key: str = "f") -> DataFrame:
    """The fraction of a frame's samples that the clip keeps (column ``rejected``), and whether the frame counts."""
    s = samples.groupBy(key).agg((F.count_if(~F.col("rejected")) / F.count("*")).alias("surviving"))
    return s.withColumn("integrate", F.col("surviving") >= LIMITS["integrated"])


def distinct_inputs(frames: DataFrame, identity: str, order: str) -> DataFrame:
    """Marks inputs whose identity came before."""
    from pyspark.sql.window import Window

    return frames.withColumn("duplicate", F.row_number().over(Window.partitionBy(identity).orderBy(order)) > 1)
