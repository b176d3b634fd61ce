"""Calibration, pattern-matching, projection and orbit queries over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import astro
from ..functions.sky import Wcs
from ..operators import matching, merge, solving, tracks
from .registry import query
from .sequences import FRAME, R, frames
from .views import cte, table, view

_FIELDS = ["camera", "width", "gain", "binning", "filt", "focal", "rotation", "exposure", "temp", "captured"]
RULES = matching.Rules(_FIELDS)


def _signatures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs, cands = view(spark, sf_dir, "v_ref"), view(spark, sf_dir, "v_cand")
    return refs.select("rid", F.struct(*_FIELDS).alias("r")), cands.select("id", F.struct("role", *_FIELDS).alias("c"))


_K = "coalesce(r.{f} = c.{f}, r.{f} IS NULL)"
_SENSOR = (
    "(coalesce(lower(trim(r.camera)) = lower(trim(c.camera)), false) OR coalesce(r.width = c.width, false)) AND coalesce(lower(trim(r.camera)) = lower(trim(c.camera)), r.camera IS NULL) AND "
    + " AND ".join(_K.format(f=f) for f in ("width", "gain", "binning"))
)
_EXPOSURE = "coalesce(abs({a}.exposure - {b}.exposure) <= greatest(0.05e0, greatest(coalesce(abs({a}.exposure), 0), coalesce(abs({b}.exposure), 0)) * 1e-3), {a}.exposure IS NULL)"
_ROTATION = "coalesce(least(((({a}.rotation - {b}.rotation) % 360e0) + 360e0) % 360e0, 360e0 - ((({a}.rotation - {b}.rotation) % 360e0) + 360e0) % 360e0) <= 2e0, true)"


@query(cte("v_ref", "v_cand") + f" SELECT rid, role, count(*) AS n, min(id) AS first_id FROM v_ref r JOIN v_cand c ON {_SENSOR} AND {_EXPOSURE.format(a='r', b='c')} AND coalesce(abs(r.temp - c.temp) <= 3e0, r.temp IS NULL) GROUP BY rid, role")
def calibration_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_counts(*_signatures(spark, sf_dir), RULES)


def _both(f: str) -> str:
    return f"coalesce(a.{f} = b.{f}, true)"


_CONSISTENT = "(coalesce(lower(trim(a.camera)) = lower(trim(b.camera)), false) OR coalesce(a.width = b.width, false)) AND coalesce(lower(trim(a.camera)) = lower(trim(b.camera)), true) AND " + " AND ".join(map(_both, ("width", "gain", "binning")))


def _plan_sql(kind: str, minimum: int) -> str:
    reason = (
        f"CASE WHEN NOT (coalesce(c.exposure > 0, false) AND coalesce(r.exposure > 0, false)) THEN 'missing-exposure' WHEN NOT {_EXPOSURE.format(a='r', b='c')} THEN 'exposure-mismatch' WHEN NOT coalesce(abs(r.temp - c.temp) <= 3e0, r.temp IS NULL) THEN 'temperature-mismatch' END"
        if kind == "dark"
        else f"CASE WHEN NOT (coalesce(lower(trim(r.filt)) = lower(trim(c.filt)), r.filt IS NULL) AND coalesce(abs(r.focal - c.focal) <= 1e0, r.focal IS NULL) AND {_ROTATION.format(a='r', b='c')}) THEN 'optics-mismatch' END"
    )
    extra = _EXPOSURE.format(a="a", b="b") if kind == "dark" else f"coalesce(lower(trim(a.filt)) = lower(trim(b.filt)), true) AND coalesce(abs(a.focal - b.focal) <= 1e0, true) AND {_ROTATION.format(a='a', b='b')}"
    coherent = "coalesce(abs(p.temp - q.temp) <= 1e0, true)" + ("" if kind == "dark" else f" AND coalesce(abs(p.captured - q.captured) <= 86400e0, true) AND {_ROTATION.format(a='p', b='q')}")
    return (
        cte("v_ref", "v_cand") + f", j AS (SELECT rid, c.*, {reason} AS reason, CASE WHEN r.captured IS NULL THEN 0 ELSE coalesce(abs(r.captured - c.captured), 4611686018427387904) END AS d FROM v_ref r JOIN v_cand c ON c.role = '{kind}' AND {_SENSOR}), "
        "s AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, id) AS o FROM j WHERE reason IS NULL), "
        f"g AS (SELECT a.rid, a.o AS anchor, b.o AS o FROM s a JOIN s b ON a.rid = b.rid AND {_CONSISTENT} AND {extra}), "
        f"k AS (SELECT gp.rid, gp.anchor, gp.o AS second, gq.o AS o FROM g gp JOIN g gq ON gp.rid = gq.rid AND gp.anchor = gq.anchor JOIN s p ON p.rid = gp.rid AND p.o = gp.o JOIN s q ON q.rid = gq.rid AND q.o = gq.o WHERE {coherent}), "
        "z AS (SELECT rid, anchor, second, count(*) AS n FROM k GROUP BY ALL), "
        f"c1 AS (SELECT rid, anchor, coalesce(min(second) FILTER (n >= {minimum}), min(second)) AS second FROM z GROUP BY ALL), c2 AS (SELECT c1.*, n FROM c1 JOIN z USING (rid, anchor, second)), "
        f"c3 AS (SELECT rid, coalesce(min(anchor) FILTER (n >= {minimum}), min(anchor)) AS anchor FROM c2 GROUP BY rid), c4 AS (SELECT c2.* FROM c2 JOIN c3 USING (rid, anchor)), "
        "sel AS (SELECT c4.rid, count(*) AS n_selected, string_agg(CAST(s.id AS VARCHAR), ',' ORDER BY k.o) AS selected FROM c4 JOIN k USING (rid, anchor, second) JOIN s ON s.rid = k.rid AND s.o = k.o GROUP BY c4.rid) "
        "SELECT j.rid, count(*) AS n_sensor, count(*) FILTER (reason IS NULL) AS n_matched, count(*) FILTER (reason = 'missing-exposure') AS n_missing, count(*) FILTER (reason = 'exposure-mismatch') AS n_exposure, count(*) FILTER (reason = 'temperature-mismatch') AS n_temperature, count(*) FILTER (reason = 'optics-mismatch') AS n_optics, "
        f"coalesce(any_value(n_selected), 0) AS n_selected, coalesce(any_value(n_selected), 0) >= {minimum} AS ready, coalesce(any_value(selected), '') AS selected FROM j LEFT JOIN sel USING (rid) GROUP BY j.rid"
    )


@query(_plan_sql("dark", 2))
def calibration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.plan(*_signatures(spark, sf_dir), "dark", 2, RULES)


@query(_plan_sql("flat", 3))
def coherent_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.plan(*_signatures(spark, sf_dir), "flat", 3, RULES)


def _said(f: str, shown: str) -> str:
    a, b = f"CAST(r.{f} AS VARCHAR)", f"CAST(c.{f} AS VARCHAR)"
    return f"CASE WHEN r.{f} IS NOT NULL AND c.{f} IS NOT NULL THEN concat('{shown} light=', {a}, ' master=', {b}) WHEN r.{f} IS NOT NULL THEN concat('{shown} light=', {a}, ', master did not record one') WHEN c.{f} IS NOT NULL THEN concat('{shown} master=', {b}, ', light did not record one') END"


@query(
    cte("v_ref", "v_cand") + f" SELECT rid, id, concat_ws('; ', CASE WHEN NOT coalesce(lower(trim(r.filt)) = lower(trim(c.filt)), r.filt IS NULL) THEN {_said('filt', 'filter')} END, CASE WHEN NOT coalesce(abs(r.focal - c.focal) <= 1e0, r.focal IS NULL) THEN {_said('focal', 'focal length')} END, CASE WHEN NOT {_ROTATION.format(a='r', b='c')} THEN {_said('rotation', 'rotation')} END) AS reason FROM v_ref r JOIN v_cand c ON c.role = 'flat' AND {_SENSOR}"
)
def mismatch_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, cands = _signatures(spark, sf_dir)
    return matching.mismatches(refs, cands.where("c.role = 'flat'"), RULES)


def _pedestal_sql() -> str:
    fit = lambda p: f"SELECT regr_slope(b, a) AS s, regr_intercept(b, a) AS c FROM {p}"
    sql = "WITH " + FRAME + ", t AS (SELECT f // 8 AS ty, x // 8 + y // 8 * 0 AS tx0, f, pos, v FROM v_frame), px AS (SELECT f // 8 AS ty, pos // 8 AS tx, v, 2e0 + v * 0.5e0 AS fl FROM v_frame), k AS (SELECT ty, tx, list_sort(list(v)) AS s, list_sort(list(fl)) AS q, CAST(count(*) AS BIGINT) AS n FROM px GROUP BY ty, tx), p0 AS (SELECT ty, tx, s[CAST(least(trunc(n * 0.2e0), n - 1) AS BIGINT) + 1] AS b, q[n // 2 + 1] AS a FROM k)"
    sql = sql.replace("t AS (SELECT f // 8 AS ty, x // 8 + y // 8 * 0 AS tx0, f, pos, v FROM v_frame), ", "")
    for i in range(3):
        sql += f", f{i} AS ({fit(f'p{i}')}), r{i} AS (SELECT p.*, b - (s * a + c) AS r FROM p{i} p, f{i}), g{i} AS (SELECT sqrt(avg(r * r)) AS g FROM r{i}), p{i + 1} AS (SELECT ty, tx, b, a FROM r{i}, g{i} WHERE abs(r) <= g * 2.5e0)"
    return sql + " SELECT round(CASE WHEN (SELECT count(*) FROM p0) >= 32 AND (SELECT count(*) FROM p3) >= 32 AND (SELECT max(a) - min(a) FROM p0) >= 0.02e0 AND s >= 0 THEN c END, 6) AS pedestal, (SELECT count(*) FROM p3) AS tiles FROM f2"


@query(_pedestal_sql())
def pedestal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    plate = frames(spark, sf_dir).select(F.col("f").alias("y"), F.col("pos").alias("x"), "v")
    return matching.pedestal_fit(plate, plate.withColumn("v", F.col("v") * 0.5 + 2.0), 8).select(R("pedestal"), "tiles")


# --- points


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = view(spark, sf_dir, "v_star").selectExpr("id", "CAST(floor(id / 6) AS BIGINT) AS grp", "mag", "ra * 10e0 AS x", "(dec + 90e0) * 10e0 AS y")
    o = view(spark, sf_dir, "v_object").selectExpr("id", "CAST(floor(id / 6) AS BIGINT) AS grp", "coalesce(mag, 99e0) AS mag", "ra * 10e0 + 3e0 AS x", "(dec + 90e0) * 10e0 - 2e0 AS y")
    return s, o


_PTS = cte("v_star", "v_object") + ", l AS (SELECT id, CAST(floor(id / 6) AS BIGINT) AS grp, mag, ra * 10e0 AS x, (dec + 90e0) * 10e0 AS y FROM v_star), r AS (SELECT id, CAST(floor(id / 6) AS BIGINT) AS grp, coalesce(mag, 99e0) AS mag, ra * 10e0 + 3e0 AS x, (dec + 90e0) * 10e0 - 2e0 AS y FROM v_object)"


@query(_PTS + ", p AS (SELECT r.x - l.x AS tx, r.y - l.y AS ty FROM l JOIN r ON abs(r.x - l.x) <= 30 AND abs(r.y - l.y) <= 30) SELECT CAST(round(tx / 5e0) AS INTEGER) AS bin_x, CAST(round(ty / 5e0) AS INTEGER) AS bin_y, count(*) AS votes, round(avg(tx), 6) AS dx, round(avg(ty), 6) AS dy FROM p WHERE sqrt(tx * tx + ty * ty) <= 30 GROUP BY 1, 2 HAVING count(*) >= 6 ORDER BY votes DESC, bin_x, bin_y LIMIT 64")
def translation_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 strongest offsets (its feature is the top 64)."""
    return solving.translation_votes(*_points(spark, sf_dir), 2.5, 30.0, 6).select("bin_x", "bin_y", "votes", R("dx"), R("dy"))


def _tri_sql(side: str) -> str:
    return (
        f"{side}k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY mag, id) - 1 AS o FROM {side}), {side}s AS (SELECT a.grp, a.o AS i, b.o AS j, c.o AS m, list_sort([sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)), sqrt((b.x-c.x)*(b.x-c.x)+(b.y-c.y)*(b.y-c.y))]) AS s "
        f"FROM {side}k a JOIN {side}k b ON a.grp = b.grp AND a.o < b.o JOIN {side}k c ON b.grp = c.grp AND b.o < c.o WHERE c.o < 5), {side}t AS (SELECT grp, i, j, m, s[2] / s[3] AS ba, s[1] / s[3] AS ca FROM {side}s WHERE s[3] > 0 AND s[1] / s[3] >= 0.12e0)"
    )


@query(_PTS + ", " + _tri_sql("l") + ", " + _tri_sql("r") + " SELECT lt.grp AS left_grp, rt.grp AS right_grp, count(*) AS n FROM lt JOIN rt ON abs(lt.ba - rt.ba) <= 0.002e0 AND abs(lt.ca - rt.ca) <= 0.002e0 GROUP BY 1, 2")
def triangle_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (solving.triangles(solving.top_points(p, "grp", 5), "grp", 5) for p in _points(spark, sf_dir))
    return solving.triangle_counts(a, b, "grp", 0.002).withColumnsRenamed({"l_grp": "left_grp", "r_grp": "right_grp"})


def _quad_sql(side: str) -> str:
    d = lambda p, q: f"sqrt(({p}.x-{q}.x)*({p}.x-{q}.x)+({p}.y-{q}.y)*({p}.y-{q}.y))"
    edges = ", ".join(d(p, q) for p, q in (("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")))
    key = " + ".join(f"least(CAST(trunc(s[{i + 1}] / greatest(s[6], 1e-12) * 128e0) AS BIGINT), 255) * {256 ** (4 - i)}" for i in range(5))
    return f"{side}k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY mag, id) - 1 AS o FROM {side}), {side}q AS (SELECT a.grp, a.o AS o1, b.o AS o2, c.o AS o3, d.o AS o4, list_sort([{edges}]) AS s FROM {side}k a JOIN {side}k b ON a.grp = b.grp AND a.o < b.o JOIN {side}k c ON b.grp = c.grp AND b.o < c.o JOIN {side}k d ON c.grp = d.grp AND c.o < d.o WHERE d.o < 5), {side}d AS (SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY o1, o2, o3, o4) - 1 AS INTEGER) AS quad, s, {key} AS key FROM {side}q)"


@query(_PTS + ", " + _quad_sql("l") + " SELECT grp, quad, key, round(s[1] / greatest(s[6], 1e-12), 6) AS first_ratio FROM ld")
def quad_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _points(spark, sf_dir)
    return solving.quads(solving.top_points(s, "grp", 5), "grp", 5).select("grp", "quad", "key", F.round(F.col("desc")[0], 6).alias("first_ratio"))


_PROBE = "list_transform(range(1, 6), lambda k: CASE WHEN s[k] / greatest(s[6], 1e-12) * 128e0 - trunc(s[k] / greatest(s[6], 1e-12) * 128e0) < 0.256e0 AND trunc(s[k] / greatest(s[6], 1e-12) * 128e0) > 0 THEN [least(CAST(trunc(s[k] / greatest(s[6], 1e-12) * 128e0) AS BIGINT), 255), CAST(trunc(s[k] / greatest(s[6], 1e-12) * 128e0) AS BIGINT) - 1] WHEN s[k] / greatest(s[6], 1e-12) * 128e0 - trunc(s[k] / greatest(s[6], 1e-12) * 128e0) > 0.744e0 THEN [CAST(trunc(s[k] / greatest(s[6], 1e-12) * 128e0) AS BIGINT), CAST(trunc(s[k] / greatest(s[6], 1e-12) * 128e0) AS BIGINT) + 1] ELSE [CAST(trunc(s[k] / greatest(s[6], 1e-12) * 128e0) AS BIGINT)] END)"


@query(_PTS + ", " + _quad_sql("l") + ", " + _quad_sql("r") + f", o AS (SELECT grp, quad, {_PROBE} AS z FROM ld), p AS (SELECT DISTINCT grp, quad, ((((a * 256 + b) * 256 + c) * 256 + d) * 256 + e) AS key FROM o, unnest(z[1]) AS u1(a), unnest(z[2]) AS u2(b), unnest(z[3]) AS u3(c), unnest(z[4]) AS u4(d), unnest(z[5]) AS u5(e)) SELECT p.grp AS image_grp, rd.grp AS index_grp, count(*) AS n FROM p JOIN rd ON p.key = rd.key GROUP BY 1, 2")
def quad_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (solving.quads(solving.top_points(p, "grp", 5), "grp", 5) for p in _points(spark, sf_dir))
    return solving.quad_counts(a, b, "grp").withColumnsRenamed({"l_grp": "image_grp", "r_grp": "index_grp"})


@query(cte("v_star") + ", v AS (SELECT CAST(floor(ra / 5e0) AS BIGINT) AS bx, CAST(floor((dec + 90e0) / 5e0) AS BIGINT) AS bz, count(*) AS votes, min(id) AS first FROM v_star GROUP BY 1, 2), s AS (SELECT a.bx, a.bz, any_value(a.votes) AS votes, any_value(a.first) AS first, CAST(sum(b.votes) AS BIGINT) AS smoothed FROM v a JOIN v b ON abs(a.bx - b.bx) <= 1 AND abs(a.bz - b.bz) <= 1 GROUP BY 1, 2) SELECT bx, bz, votes, first, smoothed FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE abs(a.bx - b.bx) <= 2 AND abs(a.bz - b.bz) <= 2 AND (b.smoothed, b.votes, -b.bx, -b.bz) > (a.smoothed, a.votes, -a.bx, -a.bz))")
def hypothesis_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = view(spark, sf_dir, "v_star").select("id", F.floor(F.col("ra") / 5.0).alias("bx"), F.floor((F.col("dec") + 90.0) / 5.0).alias("bz"))
    return solving.suppress(solving.votes(h, ["bx", "bz"], "id"), ["bx", "bz"]).select("bx", "bz", "votes", "first", "smoothed")


@query(cte("v_cand") + " SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN captured IS NULL THEN 4611686018427387904 ELSE abs(1705000000 - captured) END, id) AS INTEGER) AS place FROM v_cand")
def proximity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "v_cand").select("id", "captured", F.lit(1705000000).cast("bigint").alias("reference"))
    return matching.by_time(c, "captured", "reference").select("id", F.col("order").alias("place"))


# --- projections and orbits

WCS = Wcs.simple(150.0, 35.0, 800.0, 600.0, 2.5, 20.0)
_I = WCS.inverse()


@query(cte("v_star") + f", p AS (SELECT id, radians(ra - 150e0) AS a, radians(dec) AS d FROM v_star), q AS (SELECT *, sin(d) * {math.sin(math.radians(35.0))!r} + cos(d) * cos(a) * {math.cos(math.radians(35.0))!r} AS c FROM p), t AS (SELECT id, CASE WHEN c > 1e-12 THEN degrees(cos(d) * sin(a) / c) END AS xi, CASE WHEN c > 1e-12 THEN degrees((sin(d) * {math.cos(math.radians(35.0))!r} - cos(d) * cos(a) * {math.sin(math.radians(35.0))!r}) / c) END AS eta FROM q) SELECT id, round((xi * {_I[0]!r} + eta * {_I[1]!r} + 800e0) / 1000e0, 6) AS kx, round((xi * {_I[2]!r} + eta * {_I[3]!r} + 600e0) / 1000e0, 6) AS ky FROM t WHERE abs(xi) < 60 AND abs(eta) < 60")
def wcs_world_to_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilopixels of all stars within sixty degrees of the tangent point on both axes."""
    s = view(spark, sf_dir, "v_star")
    x, y = WCS.to_pixel(F.col("ra"), F.col("dec"))
    u, v = x - 800.0, y - 600.0
    s = s.withColumn("x", x).withColumn("y", y).withColumn("xi", u * WCS.cd[0] + v * WCS.cd[1]).withColumn("eta", u * WCS.cd[2] + v * WCS.cd[3])
    return s.where("abs(xi) < 60 and abs(eta) < 60").select("id", F.round(F.col("x") / 1000.0, 6).alias("kx"), F.round(F.col("y") / 1000.0, 6).alias("ky"))


@query(f"WITH p AS (SELECT event_id AS id, CAST(event_id % 1600 AS DOUBLE) - 800e0 AS u, CAST((event_id * 7) % 1200 AS DOUBLE) - 600e0 AS v FROM events), t AS (SELECT id, radians(u * {WCS.cd[0]!r} + v * {WCS.cd[1]!r}) AS xi, radians(u * {WCS.cd[2]!r} + v * {WCS.cd[3]!r}) AS eta FROM p), z AS (SELECT *, {math.cos(math.radians(35.0))!r} - eta * {math.sin(math.radians(35.0))!r} AS den FROM t) SELECT id, round(degrees(atan2(xi, den)) + 150e0, 6) AS ra, round(degrees(atan2(eta * {math.cos(math.radians(35.0))!r} + {math.sin(math.radians(35.0))!r}, sqrt(xi * xi + den * den))), 6) AS dec FROM z")
def wcs_pixel_to_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id AS id", "CAST(event_id % 1600 AS DOUBLE) AS x", "CAST((event_id * 7) % 1200 AS DOUBLE) AS y")
    ra, dec = WCS.to_world(F.col("x"), F.col("y"))
    return e.select("id", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


_JD = 2460500.5


def _kepler(rounds: int = 12) -> str:
    sql = cte("v_orbit") + f", k AS (SELECT *, radians(m0) + {astro.GAUSS!r} / power(a, 1.5e0) * ({_JD!r} - epoch) AS raw FROM v_orbit), k00 AS (SELECT *, raw + pi() - 2 * pi() * floor((raw + pi()) / (2 * pi())) - pi() AS m FROM k), k0 AS (SELECT *, m + e * sign(m) * 0.85e0 AS x FROM k00)"
    for i in range(rounds):
        sql += f", k{i + 1} AS (SELECT * REPLACE (x - (x - e * sin(x) - m) / (1e0 - e * cos(x)) AS x) FROM k{i})"
    return sql


@query(_kepler() + " SELECT id, round(x, 6) AS anomaly, round(abs(x - e * sin(x) - m), 9) AS residual FROM k12")
def kepler(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "v_orbit")
    m = F.radians("m0") + F.lit(astro.GAUSS) / F.pow("a", F.lit(1.5)) * (F.lit(_JD) - F.col("epoch"))
    o = o.withColumn("x", astro.eccentric_anomaly(m, F.col("e"))).withColumn("m", F.pmod(m + math.pi, F.lit(2 * math.pi)) - math.pi)
    return o.select("id", F.round("x", 6).alias("anomaly"), F.round(F.abs(F.col("x") - F.col("e") * F.sin("x") - F.col("m")), 9).alias("residual"))


def _body_sql() -> str:
    ex, ey, _ = astro.earth(_JD)
    c, s = math.cos(math.radians(astro.OBLIQUITY)), math.sin(math.radians(astro.OBLIQUITY))
    return _kepler() + (
        ", p AS (SELECT *, a * (cos(x) - e) AS px, a * sqrt(1 - e * e) * sin(x) AS py, radians(argp) AS w, radians(node) AS o, radians(incl) AS i FROM k12), q AS (SELECT *, px * cos(w) - py * sin(w) AS x1, px * sin(w) + py * cos(w) AS y1 FROM p), "
        "h AS (SELECT id, h, x1 * cos(o) - y1 * cos(i) * sin(o) AS hx, x1 * sin(o) + y1 * cos(i) * cos(o) AS hy, y1 * sin(i) AS hz FROM q), "
        f"g AS (SELECT *, hx - {ex!r} AS gx, (hy - {ey!r}) * {c!r} - hz * {s!r} AS gy, (hy - {ey!r}) * {s!r} + hz * {c!r} AS gz FROM h), r AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS dist FROM g) "
        "SELECT id, round(CASE WHEN degrees(atan2(gy, gx)) < 0 THEN degrees(atan2(gy, gx)) + 360 ELSE degrees(atan2(gy, gx)) END, 5) AS ra, round(degrees(asin(gz / dist)), 5) AS dec, round(h + 5 * log10(sqrt(hx * hx + hy * hy + hz * hz) * dist), 5) AS mag FROM r"
    )


@query(_body_sql())
def minor_body_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "v_orbit")
    x, y, z = astro.heliocentric(*(F.col(c) for c in ("a", "e", "incl", "node", "argp", "m0", "epoch")), _JD)
    o = o.withColumn("hx", x).withColumn("hy", y).withColumn("hz", z)
    ra, dec, dist = astro.geocentric((F.col("hx"), F.col("hy"), F.col("hz")), _JD)
    sun = F.sqrt(F.col("hx") * F.col("hx") + F.col("hy") * F.col("hy") + F.col("hz") * F.col("hz"))
    return o.select("id", F.round(ra, 5).alias("ra"), F.round(dec, 5).alias("dec"), F.round(astro.asteroid_magnitude(F.col("h"), sun, dist), 5).alias("mag"))


_TRK = "s AS (SELECT user_id AS k, event_id AS seq, value * 12e0 - 100e0 AS x, CAST((event_id * 37) % 1000 AS DOUBLE) - 100e0 AS y FROM events), n AS (SELECT *, lead(x) OVER (PARTITION BY k ORDER BY seq) AS nx, lead(y) OVER (PARTITION BY k ORDER BY seq) AS ny FROM s), d AS (SELECT *, nx - x AS dx, ny - y AS dy FROM n WHERE nx IS NOT NULL), c AS (SELECT *, greatest(0e0, CASE WHEN -dx < 0 THEN x / -dx ELSE 0 END, CASE WHEN dx < 0 THEN (799e0 - x) / dx ELSE 0 END, CASE WHEN -dy < 0 THEN y / -dy ELSE 0 END, CASE WHEN dy < 0 THEN (599e0 - y) / dy ELSE 0 END) AS lo, least(1e0, CASE WHEN -dx > 0 THEN x / -dx ELSE 1 END, CASE WHEN dx > 0 THEN (799e0 - x) / dx ELSE 1 END, CASE WHEN -dy > 0 THEN y / -dy ELSE 1 END, CASE WHEN dy > 0 THEN (599e0 - y) / dy ELSE 1 END) AS hi FROM d), z AS (SELECT * FROM c WHERE lo <= hi AND NOT (dx = 0 AND (x < 0 OR x > 799)) AND NOT (dy = 0 AND (y < 0 OR y > 599))), len AS (SELECT k, count(*) AS segments, sum(sqrt(power(dx * (hi - lo), 2) + power(dy * (hi - lo), 2))) AS length FROM z GROUP BY k)"


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("user_id AS k", "event_id AS seq", "value * 12e0 - 100e0 AS x", "CAST((event_id * 37) % 1000 AS DOUBLE) - 100e0 AS y")
    return tracks.path_lengths(tracks.segments(e, ["k"], "seq", 800, 600), ["k"])


@query("WITH " + _TRK + " SELECT k, segments, round(length, 5) AS length FROM len")
def track_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _track(spark, sf_dir).select("k", "segments", F.round("length", 5).alias("length"))


_U = "greatest(least({x}, 1e0), 0e0)"
_SUN, _RNG, _ELE, _LEN = "CAST(k % 11 AS DOUBLE) / 10e0", "400e0 + CAST((k * 131) % 12000 AS DOUBLE)", "CAST((k * 7) % 90 AS DOUBLE)", "length / 1000e0"
_SCORE = f"CASE WHEN {_SUN} > 0 THEN {_U.format(x=_SUN)} * ({_U.format(x=f'1 - ({_RNG} - 500e0) / 9500e0')} * 0.6e0 + {_U.format(x=f'{_ELE} / 60e0')} * 0.2e0 + {_U.format(x=f'{_LEN} / 100e0')} * 0.2e0) ELSE 0 END"


@query("WITH " + _TRK + f", r AS (SELECT k, length, {_SCORE} AS score FROM len) SELECT k, round(score, 6) AS score, CASE WHEN score >= 0.55e0 AND {_SUN} >= 0.5e0 AND {_RNG} <= 4000 AND {_LEN} >= 10 THEN 'high' WHEN {_SUN} >= 0.2e0 AND {_RNG} <= 10000 AND {_LEN} >= 2 THEN 'possible' ELSE 'low' END AS level FROM r")
def bright_trail_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _track(spark, sf_dir).withColumns({"sun": F.expr(_SUN), "rng": F.expr(_RNG), "ele": F.expr(_ELE), "px": F.expr(_LEN)})
    score = tracks.trail_score(F.col("sun"), F.col("rng"), F.col("ele"), F.col("px"))
    return t.select("k", F.round(score, 6).alias("score"), tracks.trail_level(score, F.col("sun"), F.col("rng"), F.col("px")).alias("level"))


@query("WITH s AS (SELECT s_nationkey AS k, s_suppkey AS pri, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS m, s_name AS nm FROM supplier UNION ALL SELECT c_nationkey, 1000000 + c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END, c_mktsegment FROM customer) SELECT k, count(*) AS n, arg_min(m, pri) FILTER (m IS NOT NULL) AS m, array_to_string(list_sort(list_distinct(list(nm))), ',') AS names FROM s GROUP BY k")
def identity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS k", "s_suppkey AS pri", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS m", "array(s_name) AS names")
    b = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS k", "1000000 + c_custkey AS pri", "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END AS m", "array(c_mktsegment) AS names")
    return merge.merge(a.unionByName(b), "k", "pri", ["m"], ["names"]).withColumn("names", F.array_join("names", ","))


@query(cte("v_object") + ", k AS (SELECT id, source, upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS key FROM v_object), h AS (SELECT a.id, count(DISTINCT b.id) AS n, min(b.id) AS cid FROM k a JOIN k b ON a.key = b.key AND a.source <> b.source GROUP BY a.id) SELECT k.id, CASE WHEN n = 1 THEN cid END AS target, CASE WHEN n = 1 THEN 'merged' WHEN n > 1 THEN 'ambiguous' ELSE 'added' END AS status FROM k LEFT JOIN h USING (id)")
def identity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "v_object")
    return merge.resolve(o, o, ["name"])


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def fallback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = d.select("doc_id", "lang")
    first = d.join(known, "doc_id", "left_semi").withColumn("first", F.lit(True))
    return merge.fallback(first, d.withColumn("first", F.lit(False)), "doc_id").where("not first").drop("first")


@query("WITH " + FRAME + " SELECT label, y, x, CAST(count(*) AS BIGINT) AS accepted FROM v_frame WHERE v > -1e0 GROUP BY label, y, x")
def consensus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where("v > -1").groupBy("label", "y", "x").agg(F.count("*").alias("accepted"))


