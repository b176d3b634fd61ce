"""Statistics, folds and time queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fold, stats
from .registry import query
from .views import cte, table, view

R = lambda c: F.round(c, 6).alias(c)

FRAME = "v_frame AS (SELECT vec_id AS f, label, CAST(p - 1 AS INTEGER) AS pos, CAST((p - 1) // 8 AS INTEGER) AS y, CAST((p - 1) % 8 AS INTEGER) AS x, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(p))"
U8 = FRAME + ", v_u8 AS (SELECT *, CAST(least(greatest(floor((v + 1e0) * 127.5e0), 0e0), 255e0) AS INTEGER) AS g FROM v_frame)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as frames of eight by eight pixels: f, label, pos, y, x, v."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("f"), "label", F.posexplode("embedding").alias("pos", "e"))
    return t.select("f", "label", "pos", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), F.col("e").cast("double").alias("v"))


def bytes_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).withColumn("g", F.least(F.greatest(F.floor((F.col("v") + 1.0) * 127.5), F.lit(0)), F.lit(255)).cast("int"))


@query("WITH m AS (SELECT event_type AS kind, count(*) AS n, median(value) AS median FROM events GROUP BY 1) SELECT kind, any_value(n) AS n, round(any_value(median), 6) AS median, round(median(abs(value - median)) * 1.4826e0, 6) AS sigma FROM events JOIN m ON kind = event_type GROUP BY kind")
def median_mad_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.median_mad(view(spark, sf_dir, "v_obs"), ["kind"]).select("kind", "n", R("median"), R("sigma"))


@query(
    "WITH " + U8 + ", h AS (SELECT label, g, count(*) AS c FROM v_u8 GROUP BY ALL), t AS (SELECT label, CAST(sum(c) AS BIGINT) AS n, min(g) AS lo, max(g) AS hi, sum(c * g) / sum(c) AS mean, sqrt(greatest(sum(c * g * g) / sum(c) - power(sum(c * g) / sum(c), 2), 0)) AS sigma FROM h GROUP BY label), "
    "q AS (SELECT h.label, g, sum(c) OVER (PARTITION BY h.label ORDER BY g) AS cum, n FROM h JOIN t ON h.label = t.label), m AS (SELECT label, min(g) AS median FROM q WHERE cum >= ceil(n / 2e0) GROUP BY label), "
    "d AS (SELECT h.label, abs(g - median) AS d, sum(c) AS c FROM h JOIN m ON h.label = m.label GROUP BY ALL), e AS (SELECT d.label, d, sum(c) OVER (PARTITION BY d.label ORDER BY d) AS cum, n FROM d JOIN t ON d.label = t.label), z AS (SELECT label, min(d) AS mad FROM e WHERE cum >= ceil(n / 2e0) GROUP BY label) "
    "SELECT t.label, n, lo AS min, hi AS max, round(mean, 6) AS mean, round(sigma, 6) AS sigma, median, mad FROM t JOIN m USING (label) JOIN z USING (label)"
)
def histogram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram_stats(bytes_(spark, sf_dir), ["label"]).select("label", "n", "min", "max", R("mean"), R("sigma"), "median", "mad")


@query("WITH " + FRAME + ", s AS (SELECT f, list_sort(list(v)) AS s, CAST(count(*) AS BIGINT) AS n FROM v_frame GROUP BY f) SELECT f, round(s[CAST(least(floor(n * 0.25e0), n - 1) AS BIGINT) + 1], 6) AS p_floor, round(s[CAST(round((n - 1) * 0.25e0) AS BIGINT) + 1], 6) AS p_round, round(s[CAST(least(trunc(n * 0.2e0), n - 1) AS BIGINT) + 1], 6) AS p_sky, round(s[n // 2 + 1], 6) AS upper_median FROM s")
def percentile_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.sorted_values(frames(spark, sf_dir), ["f"])
    c = F.col("samples")
    return s.select("f", F.round(stats.percentile_floor(c, 0.25), 6).alias("p_floor"), F.round(stats.percentile_round(c, 0.25), 6).alias("p_round"), F.round(stats.percentile_trunc(c, 0.2), 6).alias("p_sky"), F.round(stats.upper_median(c), 6).alias("upper_median"))


@query("WITH " + FRAME + ", s AS (SELECT f, list_sort(list(v)) AS s, CAST(count(*) AS BIGINT) AS n FROM v_frame GROUP BY f), m AS (SELECT *, s[n // 2 + 1] AS m FROM s) SELECT f, n, round(s[1], 6) AS min, round(s[n], 6) AS max, round(m, 6) AS median, round(list_sort(list_transform(s, lambda x: abs(x - m)))[n // 2 + 1], 6) AS mad FROM m")
def robust_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.robust_distribution(frames(spark, sf_dir), ["f"]).select("f", "n", R("min"), R("max"), R("median"), R("mad"))


@query("WITH " + U8 + ", h AS (SELECT f, g, count(*) AS c FROM v_u8 GROUP BY ALL), q AS (SELECT f, g, sum(c) OVER (PARTITION BY f ORDER BY g) AS n0, sum(c * g) OVER (PARTITION BY f ORDER BY g) AS s0, sum(c) OVER (PARTITION BY f) AS n, sum(c * g) OVER (PARTITION BY f) AS s FROM h), v AS (SELECT f, g, round(CAST(n0 * (n - n0) AS DOUBLE) * power(CAST(s0 AS DOUBLE) / n0 - CAST(s - s0 AS DOUBLE) / (n - n0), 2) / CAST(n * n AS DOUBLE), 9) AS var FROM q WHERE n0 < n), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY var DESC, g) AS r FROM v) SELECT f, g AS threshold FROM r WHERE r = 1")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.otsu(bytes_(spark, sf_dir), ["f"])


@query(
    "WITH RECURSIVE e AS (SELECT user_id AS k, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), "
    "s AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, 0e0 AS mean, 0e0 AS m2, CAST(0 AS BIGINT) AS rej FROM e UNION ALL "
    "SELECT k, i, CASE WHEN bad THEN n ELSE n + 1 END, CASE WHEN bad THEN mean ELSE mean + (v - mean) / (n + 1) END, CASE WHEN bad THEN m2 ELSE m2 + (v - mean) * (v - (mean + (v - mean) / (n + 1))) END, CASE WHEN bad THEN rej + 1 ELSE rej END FROM ("
    "SELECT s.k, e.i, s.n, s.mean, s.m2, s.rej, e.v, s.n >= 5 AND (v - mean < -3e0 * greatest(sqrt(m2 / greatest(n - 1, 1)), 1e-6) OR v - mean > 3e0 * greatest(sqrt(m2 / greatest(n - 1, 1)), 1e-6)) AS bad FROM s JOIN e ON e.k = s.k AND e.i = s.i + 1)) "
    "SELECT k, n, round(mean, 6) AS mean, round(CASE WHEN n > 1 THEN m2 / (n - 1) ELSE 0 END, 6) AS variance, rej AS rejected FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1"
)
def delta_sigma_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.delta_sigma(view(spark, sf_dir, "v_obs"), ["k"], "seq").select("k", "n", R("mean"), R("variance"), "rejected")


@query("WITH d AS (SELECT user_id AS k, row_number() OVER w AS depth, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS sd, count(*) OVER (PARTITION BY user_id) AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT k, depth, round(mean, 9) AS mean, round(sd, 9) AS sd FROM d WHERE (depth & (depth - 1)) = 0 OR depth = last")
def checkpoint_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.checkpoint_depths(view(spark, sf_dir, "v_obs"), ["k"], "seq").select("k", "depth", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@query("WITH o AS (SELECT user_id AS k, event_id, epoch_us(ts) / 1e6 AS t, value AS v FROM events), d AS (SELECT k, t - lag(t) OVER w AS dt, abs(v - lag(v) OVER w) AS dv FROM o WINDOW w AS (PARTITION BY k ORDER BY t, event_id)) SELECT k, round(max(dv / dt), 6) AS rate FROM d WHERE dt > 0 GROUP BY k")
def rate_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "v_obs").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return fold.max_rate(o, ["k"], "t").select("k", R("rate"))


_SNAP = "SELECT event_id AS rid, epoch_us(ts) / 1e6 AS rt, event_type AS provider, CAST(1000 + event_id % 977 AS BIGINT) AS bytes FROM events"


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("rt"), F.col("event_type").alias("provider"), (F.lit(1000) + F.col("event_id") % 977).cast("long").alias("bytes"))


@query("WITH s AS (" + _SNAP + "), x AS (SELECT o_orderkey AS id, CAST(1704067200 + o_orderkey * 37 AS DOUBLE) AS t FROM orders), p AS (SELECT id, t, rid, rt, abs(t - rt) AS d, row_number() OVER (PARTITION BY id ORDER BY abs(t - rt), rt DESC, rid DESC) AS r FROM x JOIN s ON rt BETWEEN t - 21600 AND t + 21600) SELECT id, rid, round(d, 6) AS dist FROM p WHERE r = 1")
def nearest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = view(spark, sf_dir, "v_exposure").select("id", F.col("t").cast("double").alias("t"))
    return fold.nearest_in_time(x, _snapshots(spark, sf_dir), 21600.0).select("id", "rid", R("dist"))


@query("WITH s AS (" + _SNAP + "), g AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY rt DESC, rid DESC) = 1 AS guarded, sum(bytes) OVER (PARTITION BY provider) AS total FROM s), f AS (SELECT *, coalesce(sum(CASE WHEN NOT guarded THEN bytes END) OVER (PARTITION BY provider ORDER BY rt, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM g) SELECT provider, rid AS id, NOT guarded AND total - freed > 500000 AS evict FROM f")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _snapshots(spark, sf_dir).select(F.col("rid").alias("id"), F.col("rt").alias("t"), "provider", "bytes")
    return fold.eviction(s, 500_000).select("provider", "id", "evict")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events"), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", R("total"))


@query("WITH o AS (SELECT user_id AS k, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT k, ts, sum(new) OVER (PARTITION BY k ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT k, min(ts) AS start, count(*) AS n FROM s GROUP BY k, s")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events"), "6 hours").select("k", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(cte("v_star") + " SELECT id, CAST(floor(id / 7) AS BIGINT) AS grp, CAST(row_number() OVER (PARTITION BY CAST(floor(id / 7) AS BIGINT) ORDER BY mag, id) AS INTEGER) AS rank FROM v_star QUALIFY rank <= 2")
def rank_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    s = view(spark, sf_dir, "v_star").withColumn("grp", F.floor(F.col("id") / 7))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy("mag", "id"))).where("rank <= 2").select("id", "grp", "rank")
