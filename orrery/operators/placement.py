"""Objects and bodies placed on an image; orientation of images to the sky; trail evidence in pixels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import astro
from ..functions.sky import Wcs, bearing
from .spatial import Polygon, region_query


def objects_in_footprint(objects: DataFrame, wcs: Wcs, width: int, height: int) -> DataFrame:
    """Objects that touch the image with their pixel ellipses, largest first; an unsymmetric extent without a position angle
    has no angle."""
    hits = region_query(objects, Polygon(tuple(wcs.footprint(width, height))))
    x, y = wcs.to_pixel(F.col("ra"), F.col("dec"))
    major = F.coalesce(F.col("major_arcmin"), F.lit(0.0)) * 30.0 / wcs.scale
    p = hits.withColumn("x", x).withColumn("y", y).withColumn("semi_major_px", major).withColumn("semi_minor_px", F.coalesce(F.col("minor_arcmin") * 30.0 / wcs.scale, major))
    m = F.greatest(F.col("semi_major_px"), F.lit(1.0))
    p = p.where((F.col("x") >= -m) & (F.col("y") >= -m) & (F.col("x") < m + width) & (F.col("y") < m + height))
    eps = 1 / 60
    nx, ny = wcs.to_pixel(F.col("ra"), F.least(F.col("dec") + eps, F.lit(90.0)))
    ex, ey = wcs.to_pixel(F.col("ra") + F.lit(eps) / F.greatest(F.cos(F.radians("dec")), F.lit(1e-6)), F.col("dec"))

    def unit(a, b):
        n = F.greatest(F.sqrt(a * a + b * b), F.lit(1e-12))
        return a / n, b / n

    n, e = unit(nx - F.col("x"), ny - F.col("y")), unit(ex - F.col("x"), ey - F.col("y"))
    pa = F.radians(F.coalesce(F.col("position_angle_deg"), F.lit(0.0)))
    angle = F.degrees(F.atan2(n[1] * F.cos(pa) + e[1] * F.sin(pa), n[0] * F.cos(pa) + e[0] * F.sin(pa)))
    oriented = F.col("position_angle_deg").isNotNull() | F.col("minor_arcmin").isNull() | (F.col("minor_arcmin") == F.col("major_arcmin"))
    return p.withColumn("angle_deg", F.when(F.coalesce(oriented, F.lit(False)), angle)).orderBy(F.desc("semi_major_px"), "id")


def _orbit(kind: np.ndarray, epoch: np.ndarray, size: np.ndarray, e: np.ndarray, incl: np.ndarray, node: np.ndarray, argp: np.ndarray, m0: np.ndarray, jd: np.ndarray) -> np.ndarray:
    """Heliocentric ecliptic positions (n, 3) of bodies on orbits of any shape; comets count from perihelion."""
    comet = kind == "comet"
    q = np.where(comet, size, size * (1 - e))
    with np.errstate(all="ignore"):
        a = q / np.abs(1 - e)
        n = astro.GAUSS / a**1.5
        days = jd - epoch + np.where(comet, 0, np.radians(m0) / n)
        mean = n * days
        m = np.mod(mean + np.pi, 2 * np.pi) - np.pi
        x = m + 0.85 * e * np.sign(m)
        h = np.sign(mean) * np.log(2 * np.abs(mean) / np.maximum(e, 1e-9) + 1.8)
        for _ in range(60):
            x = x - (x - e * np.sin(x) - m) / (1 - e * np.cos(x))
            h = h - (e * np.sinh(h) - h - mean) / (e * np.cosh(h) - 1)
        w = 3 * astro.GAUSS * days / (q**1.5 * 2**0.5)
        y = np.cbrt((w + np.sqrt(w * w + 4)) / 2)
        s = y - 1 / y
        flat, closed = np.abs(e - 1) < 1e-6, e < 1
        px = np.where(flat, q * (1 - s * s), np.where(closed, a * (np.cos(x) - e), a * (e - np.cosh(h))))
        py = np.where(flat, 2 * q * s, np.where(closed, a * np.sqrt(np.abs(1 - e * e)) * np.sin(x), a * np.sqrt(np.abs(e * e - 1)) * np.sinh(h)))
    w, o, i = np.radians(argp), np.radians(node), np.radians(incl)
    x1, y1 = px * np.cos(w) - py * np.sin(w), px * np.sin(w) + py * np.cos(w)
    return np.stack([x1 * np.cos(o) - y1 * np.cos(i) * np.sin(o), x1 * np.sin(o) + y1 * np.cos(i) * np.cos(o), y1 * np.sin(i)], -1)


def body_places(bodies: DataFrame, jd: float) -> DataFrame:
    """Geocentric places of bodies (the reader's columns) with one step of light-time: ra, dec, distance, mag beside their columns.
    A narrow map; bodies whose orbit gives no place go."""
    import pyarrow as pa

    from ..sources.catalogs import BODY

    def run(batches):
        ground = np.array(astro.earth(jd))
        c, s = math.cos(math.radians(astro.OBLIQUITY)), math.sin(math.radians(astro.OBLIQUITY))
        for batch in batches:
            col = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(BODY))]
            num = [np.asarray(v, np.float64) for v in col[2:9]]
            first = np.linalg.norm(_orbit(col[0], *num, jd) - ground, axis=1)
            sun = _orbit(col[0], *num, jd - first / astro.LIGHT_DAY)
            d = sun - ground
            x, y, z = d[:, 0], d[:, 1] * c - d[:, 2] * s, d[:, 1] * s + d[:, 2] * c
            far, r = np.linalg.norm(d, axis=1), np.linalg.norm(sun, axis=1)
            with np.errstate(all="ignore"):
                mag = col[9] + 5 * np.log10(far) + np.where(col[0] == "comet", 2.5 * col[10] * np.log10(r), 5 * np.log10(r))
                places = [np.degrees(np.arctan2(y, x)) % 360, np.degrees(np.arcsin(z / far)), far, mag]
            ok = pa.array(np.isfinite(far))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, places)], names=[*BODY, "ra", "dec", "distance", "mag"]).filter(ok)

    typed = bodies.select("kind", "name", *[F.col(k).cast("double").alias(k) for k in BODY[2:]])
    return typed.mapInArrow(run, "kind string, name string, " + ", ".join(f"{k} double" for k in (*BODY[2:], "ra", "dec", "distance", "mag")))


def bodies_in_footprint(bodies: DataFrame, jd: float, wcs: Wcs, width: int, height: int, max_mag: float | None = None) -> DataFrame:
    """Bodies on an image, brightest first, with their motion (arcsec an hour, over thirty minutes each way) and its direction."""
    half = 0.5 / 24
    now = body_places(bodies, jd)
    x, y = wcs.to_pixel(F.col("ra"), F.col("dec"))
    now = now.withColumn("x", x).withColumn("y", y).where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height))
    if max_mag is not None:
        now = now.where(F.col("mag") <= max_mag)
    before = body_places(bodies, jd - half).select("name", F.col("ra").alias("ra_a"), F.col("dec").alias("dec_a"))
    after = body_places(bodies, jd + half).select("name", F.col("ra").alias("ra_b"), F.col("dec").alias("dec_b"))
    from ..functions.sky import separation

    j = now.join(before, "name").join(after, "name")
    return j.withColumn("motion_arcsec_h", separation("ra_a", "dec_a", "ra_b", "dec_b") * 3600.0).withColumn("direction_deg", bearing("ra_a", "dec_a", "ra_b", "dec_b")).drop("ra_a", "dec_a", "ra_b", "dec_b").orderBy("mag", "name")


def sky_orientation(width: int, height: int, wcs: Wcs) -> dict:
    """The affine map that turns an image north up and east left: size, transform (2 by 3) and WCS of the result. Refuses SIP
    and results over four times the source's area."""
    if wcs.sip is not None:
        raise ValueError("an affine turn does not undo SIP distortion")
    s = wcs.scale / 3600
    m = np.array([[wcs.cd[0], wcs.cd[1]], [wcs.cd[2], wcs.cd[3]]]) / -s
    corners = np.array([[0, 0], [width - 1, 0], [0, height - 1], [width - 1, height - 1]], float) - [wcs.px, wcs.py]
    p = corners @ m.T
    low, high = p.min(0), p.max(0)
    w, h = (int(math.ceil(v - 1e-9)) + 1 for v in high - low)
    if w * h > 4 * width * height:
        raise ValueError("the turned image would be implausibly large")
    t = np.column_stack([m, -low - m @ [wcs.px, wcs.py]])
    return {"width": w, "height": h, "transform": t, "wcs": Wcs(wcs.ra0, wcs.dec0, float(-low[0]), float(-low[1]), (-s, 0.0, 0.0, -s))}


def align_trail(image: np.ndarray, path: np.ndarray, most: int = 2048, corridor: float = 30.0, points: tuple[int, int] = (80, 1200), tilt: float = 0.5, sigma: float = 2.0, continuity: float = 0.65) -> dict | None:
    """Evidence of a trail near a predicted path (points x, y): offsets at both ends searched over a corridor, coarse then fine;
    contrast of the line against its sides in noise units, and the share of it that shows. None below the gates."""
    step = max(1, math.ceil(max(image.shape) / most))
    if step > 1:
        h, w = (n // step * step for n in image.shape)
        image = image[:h, :w].reshape(h // step, step, w // step, step).mean((1, 3))
    p = np.asarray(path, float) / step
    length = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    if length[-1] < 8:
        return None
    n = int(np.clip(length[-1], *points))
    along = np.linspace(0, length[-1], n)
    at = np.column_stack([np.interp(along, length, p[:, 0]), np.interp(along, length, p[:, 1])])
    d = np.gradient(at, axis=0)
    d /= np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-12)[:, None]
    normal = np.column_stack([-d[:, 1], d[:, 0]])
    diff = np.diff(image, axis=1)
    noise = max(1.4826 * np.median(np.abs(diff - np.median(diff))) / math.sqrt(2), 1e-12)

    def sample(q: np.ndarray) -> np.ndarray:
        x, y = q[..., 0], q[..., 1]
        x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
        ok = (x0 >= 0) & (y0 >= 0) & (x0 + 1 < image.shape[1]) & (y0 + 1 < image.shape[0])
        x0, y0 = np.where(ok, x0, 0), np.where(ok, y0, 0)
        fx, fy = x - x0, y - y0
        v = image[y0, x0] * (1 - fx) * (1 - fy) + image[y0, x0 + 1] * fx * (1 - fy) + image[y0 + 1, x0] * (1 - fx) * fy + image[y0 + 1, x0 + 1] * fx * fy
        return np.where(ok, v, np.nan)

    part = along / length[-1]

    def score(a: float, b: float) -> tuple[float, dict] | None:
        q = at + normal * (a + (b - a) * part)[:, None]
        across = np.stack([sample(q + normal * o) for o in (-0.45, 0.0, 0.45, -5.0, -3.0, 3.0, 5.0)])
        ok = np.isfinite(across).all(0)
        if ok.sum() < n // 2:
            return None
        c = across[:3, ok].mean(0) - np.median(across[3:, ok], 0)
        shown = float((c > 0.75 * noise).mean())
        s = max(float(np.quantile(c, 0.6)), 0.0) / noise
        return s * (0.5 + 0.5 * shown), {"contrast_sigma": s, "continuity": shown, "start_offset": a * step, "end_offset": b * step}

    reach = corridor / step
    best = None
    for span, width in ((np.arange(-reach, reach + 1e-9, 1.0), 3.0), (None, 0.25)):
        if span is not None:
            trials = [(m - t, m + t) for m in span for t in np.arange(-tilt * reach, tilt * reach + 1e-9, 2.0)]
        elif best is None:
            return None
        else:
            a0, b0 = best[1]["start_offset"] / step, best[1]["end_offset"] / step
            trials = [(a0 + i * width, b0 + j * width) for i in range(-6, 7) for j in range(-6, 7)]
        for a, b in trials:
            s = score(a, b)
            if s and (best is None or s[0] > best[0]):
                best = s
    return best[1] if best and best[1]["contrast_sigma"] >= sigma and best[1]["continuity"] >= continuity else None
