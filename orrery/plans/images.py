"""Image queries: embeddings read as frames of eight by eight pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves
from ..operators import compose, pixels
from .registry import query
from .sequences import FRAME, U8, R, bytes_, frames
from .views import cte, view

_LOO = (
    "s AS (SELECT label, y, x, count(*) AS n, avg(v) AS mean, var_pop(v) * count(*) AS m2 FROM v_frame GROUP BY ALL), j AS (SELECT v_frame.*, n, mean, (n * mean - v) / (n - 1) AS om, sqrt(greatest(m2 - (v - mean) * (v - (n * mean - v) / (n - 1)), 0) / (n - 2)) AS sg FROM v_frame JOIN s USING (label, y, x)), "
    "b AS (SELECT *, n >= 3 AND CASE WHEN sg <= 2.220446049250313e-16 THEN abs(v - om) > greatest(abs(om), 1e0) * 9.5367431640625e-7 ELSE v - om < -2e0 * sg OR v - om > 2e0 * sg END AS bad FROM j)"
)


@query("WITH " + FRAME + ", " + _LOO + " SELECT label, y, x, round(coalesce(avg(v) FILTER (NOT bad), any_value(mean)), 6) AS v, any_value(n) AS n, count(*) FILTER (bad) AS rejected FROM b GROUP BY label, y, x")
def master_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.master(frames(spark, sf_dir), 2.0, 2.0, ["label"]).select("label", "y", "x", R("v"), "n", "rejected")


_M = "m AS (SELECT y, x, avg(v) FILTER (label = 1) AS b, avg(v) FILTER (label = 2) AS d, avg(v) FILTER (label = 3) + 0.5e0 AS fl FROM v_frame GROUP BY y, x)"


def _masters(fr: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    one = lambda k, add=0.0: fr.where(F.col("label") == k).groupBy("y", "x").agg((F.avg("v") + add).alias("v"))
    return one(1), one(2).withColumn("exposure", F.lit(30.0)), one(3, 0.5)


@query("WITH " + FRAME + ", " + _M + " SELECT f, v_frame.y, v_frame.x, round(CASE WHEN fl > 1e-6 THEN (v - b - d * (60e0 / 30e0)) / fl END, 6) AS v FROM v_frame JOIN m ON v_frame.y = m.y AND v_frame.x = m.x WHERE label = 5")
def calibrate_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    lights = fr.where("label = 5").withColumn("exposure", F.lit(60.0))
    return pixels.apply_masters(lights, *_masters(fr)).select("f", "y", "x", R("v"))


@query("WITH " + FRAME + ", m AS (SELECT f, median(v) AS m FROM v_frame WHERE v > 0 GROUP BY f) SELECT f, y, x, round(CASE WHEN v > 0 THEN v / m END, 6) AS v FROM v_frame JOIN m USING (f)")
def flat_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.normalize_flat(frames(spark, sf_dir)).select("f", "y", "x", R("v"))


_REF = "r AS (SELECT y, x, v AS r FROM v_frame WHERE f = (SELECT min(f) FROM v_frame))"


def _reference(fr: DataFrame) -> DataFrame:
    return fr.join(fr.agg(F.min("f").alias("f")), "f").select("y", "x", "v")


@query("WITH " + FRAME + ", " + _REF + ", m AS (SELECT f, count(*) AS n, median(v) AS mv, median(r) AS mr FROM v_frame JOIN r USING (y, x) GROUP BY f), d AS (SELECT f, any_value(n) AS n, any_value(mv) AS mv, any_value(mr) AS mr, median(abs(v - mv)) * 1.4826e0 AS sv, median(abs(r - mr)) * 1.4826e0 AS sr FROM v_frame JOIN r USING (y, x) JOIN m USING (f) GROUP BY f) SELECT f, round(sr / sv, 6) AS gain, round(mr - sr / sv * mv, 6) AS \"offset\" FROM d WHERE n >= 32 AND sv > 0")
def global_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    return pixels.global_normalization(fr, _reference(fr)).select("f", R("gain"), R("offset"))


@query(
    "WITH " + FRAME + ", " + _REF + ", p AS (SELECT f, y, x, v, r, y // 4 AS ty, x // 4 AS tx FROM v_frame JOIN r USING (y, x)), m AS (SELECT f, ty, tx, median(v) AS mv, median(r) AS mr FROM p GROUP BY ALL), "
    "d AS (SELECT f, ty, tx, any_value(mv) AS mv, any_value(mr) AS mr, median(abs(v - mv)) * 1.4826e0 AS sv, median(abs(r - mr)) * 1.4826e0 AS sr FROM p JOIN m USING (f, ty, tx) GROUP BY ALL), g AS (SELECT f, ty, tx, sr / sv AS gain, mr - sr / sv * mv AS ofs FROM d WHERE sv > 0), "
    "q AS (SELECT f, y, x, v, least(greatest((y + 0.5e0) / 4 - 0.5e0, 0e0), 1e0) AS fy, least(greatest((x + 0.5e0) / 4 - 0.5e0, 0e0), 1e0) AS fx FROM p), "
    "c AS (SELECT q.*, i, j, least(floor(fy) + i, 1) AS ty, least(floor(fx) + j, 1) AS tx, (CASE WHEN i = 1 THEN fy - floor(fy) ELSE 1e0 - (fy - floor(fy)) END) * (CASE WHEN j = 1 THEN fx - floor(fx) ELSE 1e0 - (fx - floor(fx)) END) AS w FROM q, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j)) "
    "SELECT c.f, y, x, round(any_value(v) * sum(w * gain) + sum(w * ofs), 6) AS v FROM c JOIN g ON c.f = g.f AND c.ty = g.ty AND c.tx = g.tx GROUP BY c.f, y, x"
)
def local_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    return pixels.local_normalization(fr, _reference(fr), 4, 1).select("f", "y", "x", R("v"))


@query("WITH " + FRAME + ", m AS (SELECT f, median(v) AS m FROM v_frame GROUP BY f), d AS (SELECT f, any_value(m) AS m, median(abs(v - m)) * 1.4826e0 AS s FROM v_frame JOIN m USING (f) GROUP BY f) SELECT f, y, x, round(CASE WHEN v - m > 2e0 * greatest(s, 1e-6) THEN v - m ELSE 0 END, 6) AS excess FROM v_frame JOIN d USING (f)")
def threshold_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.threshold_excess(frames(spark, sf_dir), 64, 2.0).select("f", "y", "x", R("excess"))


def _near(op: str) -> str:
    return "WITH " + U8 + f" SELECT a.f, a.y, a.x, {op}(b.g) AS v FROM v_u8 a JOIN v_u8 b ON a.f = b.f AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.f, a.y, a.x"


def _g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytes_(spark, sf_dir).select("f", "y", "x", F.col("g").alias("v"))


@query(_near("min"))
def erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.erode(_g(spark, sf_dir))


@query(_near("max"))
def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.dilate(_g(spark, sf_dir))


@query("WITH " + U8 + ", o AS (SELECT * FROM (VALUES (-1), (0), (1)) AS a(dy), (VALUES (-1), (0), (1)) AS b(dx)), n AS (SELECT f, y, x, least(greatest(y + dy, 0), 7) AS ny, least(greatest(x + dx, 0), 7) AS nx FROM v_u8, o) SELECT n.f, n.y, n.x, list_sort(list(b.g))[5] AS v FROM n JOIN v_u8 b ON b.f = n.f AND b.y = ny AND b.x = nx GROUP BY n.f, n.y, n.x")
def median3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.median3(_g(spark, sf_dir))


_TAPS = pixels.kernel_q8(pixels.gaussian_kernel(1.0, 5))
_T = ", ".join(f"({i - 2}, {t})" for i, t in enumerate(_TAPS))
_MIRROR = "CASE WHEN abs({i}) < 8 THEN abs({i}) ELSE 14 - abs({i}) END"


@query("WITH " + U8 + f", k(d, w) AS (VALUES {_T}), h AS (SELECT a.f, a.y, a.x, sum(b.g * w) AS s FROM v_u8 a, k, v_u8 b WHERE b.f = a.f AND b.y = a.y AND b.x = {_MIRROR.format(i='(a.x + d)')} GROUP BY ALL) SELECT a.f, a.y, a.x, CAST(least(floor((sum(b.s * w) + 32768) / 65536e0), 255) AS INTEGER) AS v FROM h a, k, h b WHERE b.f = a.f AND b.x = a.x AND b.y = {_MIRROR.format(i='(a.y + d)')} GROUP BY a.f, a.y, a.x")
def gaussian_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.gaussian_u8(_g(spark, sf_dir), 1.0, 5)


_CH = "CASE WHEN {y} % 2 = 0 AND {x} % 2 = 0 THEN 0 WHEN {y} % 2 = 1 AND {x} % 2 = 1 THEN 2 ELSE 1 END"


@query("WITH " + FRAME + f", n AS (SELECT a.f, a.y, a.x, a.v AS own, {_CH.format(y='a.y', x='a.x')} AS oc, {_CH.format(y='b.y', x='b.x')} AS c, b.v FROM v_frame a JOIN v_frame b ON a.f = b.f AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1) SELECT f, y, x, round(CASE WHEN any_value(oc) = 0 THEN any_value(own) ELSE avg(v) FILTER (c = 0) END, 6) AS r, round(CASE WHEN any_value(oc) = 1 THEN any_value(own) ELSE avg(v) FILTER (c = 1) END, 6) AS g, round(CASE WHEN any_value(oc) = 2 THEN any_value(own) ELSE avg(v) FILTER (c = 2) END, 6) AS b FROM n GROUP BY f, y, x")
def debayer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.debayer(frames(spark, sf_dir)).select("f", "y", "x", R("r"), R("g"), R("b"))


@query("WITH " + FRAME + ", d AS (SELECT f, y, x, lag(v) OVER h - 2 * v + lead(v) OVER h AS dh, lag(v) OVER w - 2 * v + lead(v) OVER w AS dw FROM v_frame WINDOW h AS (PARTITION BY f, y ORDER BY x), w AS (PARTITION BY f, x ORDER BY y)), i AS (SELECT * FROM d WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6), m AS (SELECT f, median(dh) AS mh, median(dw) AS mw FROM i GROUP BY f) SELECT f, round(greatest(median(abs(dh - mh)), median(abs(dw - mw))) * 1.4826e0 / sqrt(6e0), 6) AS noise FROM i JOIN m USING (f) GROUP BY f")
def second_difference_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.second_difference_noise(frames(spark, sf_dir)).select("f", R("noise"))


@query("WITH " + FRAME + " SELECT f, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, count(*) AS n FROM v_frame WHERE v > 0e0 GROUP BY f")
def coverage_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.coverage(frames(spark, sf_dir).withColumn("v", F.when(F.col("v") > 0, F.col("v"))))


@query("WITH " + FRAME + ", n AS (SELECT a.f, a.y, a.x, median(b.v) AS m, list(b.v) AS s, any_value(a.v) AS v, count(*) AS c FROM v_frame a JOIN v_frame b ON a.f = b.f AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x) GROUP BY a.f, a.y, a.x), d AS (SELECT *, list_median(list_transform(s, lambda q: abs(q - m))) * 1.4826e0 AS dev FROM n) SELECT f, y, x, round(CASE WHEN c >= 5 AND abs(v - m) > 4e0 * greatest(dev, 1.2e-38) THEN m ELSE v END, 6) AS v FROM d".replace("list_median(", "list_aggregate(").replace(") * 1.4826e0 AS dev", ", 'median') * 1.4826e0 AS dev"))
def cosmetic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.suppress_impulses(frames(spark, sf_dir), 1, 4.0).select("f", "y", "x", R("v"))


@query(cte("v_curve") + " SELECT id, round(CASE WHEN x <= 0 THEN 0 WHEN x >= 1 THEN 1 ELSE (0.25e0 - 1) * x / ((2 * 0.25e0 - 1) * x - 0.25e0) END, 6) AS v FROM v_curve")
def stretch_mtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_curve").select("id", F.round(curves.mtf(0.25, F.col("x")), 6).alias("v"))


@query(cte("v_curve") + " SELECT id, round(least(greatest(asinh(greatest((x - 0.02e0) / 0.98e0, 0e0) * 50e0) / asinh(50e0), 0e0), 1e0), 6) AS v FROM v_curve")
def stretch_asinh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_curve").select("id", F.round(curves.asinh(F.col("x"), 0.02, 1.0, 50.0), 6).alias("v"))


@query(cte("v_curve") + ", r AS (SELECT id, CASE WHEN x < 0.3e0 THEN -(1 - exp(-5e0 * (0.3e0 - x))) ELSE 1 - exp(-5e0 * (x - 0.3e0)) END AS r FROM v_curve) SELECT id, round(least(greatest((r + 1 - exp(-1.5e0)) / (1 - exp(-3.5e0) + 1 - exp(-1.5e0)), 0e0), 1e0), 6) AS v FROM r")
def stretch_ghs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_curve").select("id", F.round(curves.ghs(F.col("x"), 5.0, 0.0, 0.3), 6).alias("v"))


_TRIO = "SELECT f // 4 AS s, CASE f % 4 WHEN 0 THEN 'r' WHEN 1 THEN 'g' WHEN 2 THEN 'b' ELSE 'l' END AS c, y, x, v FROM v_frame"
_PREP = "WITH " + FRAME + f", q AS ({_TRIO}), l AS (SELECT s, c, list_sort(list(v)) AS a FROM q GROUP BY s, c), p AS (SELECT q.s, q.c, y, x, least(greatest((v - a[1]) / (a[64] - a[1]), 0e0), 1e0) AS v FROM q JOIN l ON q.s = l.s AND q.c = l.c), w AS (SELECT s, y, x, max(v) FILTER (c = 'r') AS r, max(v) FILTER (c = 'g') AS g, max(v) FILTER (c = 'b') AS b, max(v) FILTER (c = 'l') AS l FROM p GROUP BY s, y, x)"


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    name = F.array(*map(F.lit, "rgbl"))[(F.col("f") % 4).cast("int")]
    return compose.prepared(fr.select(F.floor(F.col("f") / 4).alias("s"), name.alias("c"), "y", "x", "v"), ["s", "c"])


def _rgb(df: DataFrame) -> DataFrame:
    return df.select("s", "y", "x", R("r"), R("g"), R("b"))


@query(_PREP + " SELECT s, y, x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM w WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")
def compose_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(compose.channels_by_pixel(_channels(spark, sf_dir), "c", ["r", "g", "b"], ["s", "y", "x"]))


@query(_PREP + ", t AS (SELECT *, 0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b AS lum, 0.4e0 * (0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b) + 0.6e0 * l AS target FROM w WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL AND l IS NOT NULL) SELECT s, y, x, round(CASE WHEN lum > 1e-8 THEN r * (target / lum) ELSE target END, 6) AS r, round(CASE WHEN lum > 1e-8 THEN g * (target / lum) ELSE target END, 6) AS g, round(CASE WHEN lum > 1e-8 THEN b * (target / lum) ELSE target END, 6) AS b FROM t")
def compose_lrgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = compose.channels_by_pixel(_channels(spark, sf_dir), "c", ["r", "g", "b", "l"], ["s", "y", "x"])
    return _rgb(compose.lrgb(p, ["s", "y", "x"], 0.6))


@query(_PREP + ", t AS (SELECT *, 0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b AS lum, l + r + g + b AS target FROM w WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL AND l IS NOT NULL) SELECT s, y, x, round(CASE WHEN lum > 1e-8 THEN r * (target / lum) ELSE target END, 6) AS r, round(CASE WHEN lum > 1e-8 THEN g * (target / lum) ELSE target END, 6) AS g, round(CASE WHEN lum > 1e-8 THEN b * (target / lum) ELSE target END, 6) AS b FROM t")
def compose_super_lrgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = compose.channels_by_pixel(_channels(spark, sf_dir), "c", ["r", "g", "b", "l"], ["s", "y", "x"])
    return _rgb(compose.super_lrgb(p, ["s", "y", "x"]))


_NB = ", n AS (SELECT s, y, x, r AS s2, g AS h, b AS o FROM w WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL)"


def _nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = compose.channels_by_pixel(_channels(spark, sf_dir), "c", ["r", "g", "b"], ["s", "y", "x"])
    return p.select(F.col("s").alias("set"), "y", "x", F.col("r").alias("s"), F.col("g").alias("h"), F.col("b").alias("o"))


@query(_PREP + _NB + " SELECT s AS \"set\", y, x, round(h, 6) AS r, round(s2, 6) AS g, round(o, 6) AS b FROM n")
def compose_narrowband(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.narrowband(_nb(spark, sf_dir), ["set", "y", "x"], "hso").select("set", "y", "x", R("r"), R("g"), R("b"))


@query(_PREP + _NB + " SELECT s AS \"set\", y, x, round(power(o, 1 - o) * s2 + (1 - power(o, 1 - o)) * h, 6) AS r, round(power(o * h, 1 - o * h) * h + (1 - power(o * h, 1 - o * h)) * o, 6) AS g, round(o, 6) AS b FROM n")
def compose_foraxx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.foraxx(_nb(spark, sf_dir), ["set", "y", "x"]).select("set", "y", "x", R("r"), R("g"), R("b"))


@query("WITH " + FRAME + " SELECT f, y, x, round((v + 1e0) / 2e0, 6) AS unit, CAST(floor(least(greatest((v + 1e0) / 2e0, 0e0), 1e0) * 65535e0 + 0.5e0) AS INTEGER) AS u16, CAST(floor(least(greatest((v + 1e0) / 2e0, 0e0), 1e0) * 255e0 + 0.5e0) AS INTEGER) AS u8 FROM v_frame")
def sample_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = curves.linear(F.col("v"), -1.0, 1.0)
    return frames(spark, sf_dir).select("f", "y", "x", F.round(u, 6).alias("unit"), curves.to_u16(u).alias("u16"), curves.to_u8(u).alias("u8"))
