"""Satellite positions and tracks: near-Earth SGP4 as published (1980 report, 2006 revision, its WGS-72 constants), a mean-sidereal-time
frame and a low-precision Sun. Positions are good to about a kilometre near the epoch; the frame adds some arcseconds.
Objects with periods of 225 minutes or more need the deep-space terms, which are not here: they give no samples and are
counted apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sky import Wcs
from .tracks import path_lengths, segments

MU, RADIUS, J2, J3, J4 = 398600.8, 6378.135, 0.001082616, -0.00000253881, -0.00000165597
XKE = 60.0 / np.sqrt(RADIUS**3 / MU)


def sgp4(e: dict[str, np.ndarray], minutes: np.ndarray) -> np.ndarray:
    """Positions (n, m, 3) in km, true equator and mean equinox of date, of n element sets at m times each (minutes from epoch).

    ``e``: inclination, node, eccentricity, perigee, anomaly (degrees), motion (revolutions a day), bstar."""
    inc, node, peri, anom = (np.radians(e[k])[:, None] for k in ("inclination", "node", "perigee", "anomaly"))
    ecc, b, n0 = e["eccentricity"][:, None], e["bstar"][:, None], (e["motion"] * 2 * np.pi / 1440)[:, None]
    t = minutes
    ci, si = np.cos(inc), np.sin(inc)
    c2, beta2 = ci * ci, 1 - ecc * ecc
    beta = np.sqrt(beta2)
    con41, con42, sin2, x7 = 3 * c2 - 1, 1 - 5 * c2, 1 - c2, 7 * c2 - 1
    a = (XKE / n0) ** (2 / 3)
    d1 = 0.75 * J2 * con41 / (beta * beta2)
    d = d1 / (a * a)
    a = a * (1 - d * d - d * (1 / 3 + 134 * d * d / 81))
    n0 = n0 / (1 + d1 / (a * a))
    a = (XKE / n0) ** (2 / 3)
    p2 = (a * beta2) ** -2
    low = a * (1 - ecc)
    perigee = (low - 1) * RADIUS
    s = np.where(perigee < 156, np.where(perigee < 98, 20.0, perigee - 78), 78.0)
    q4 = ((120 - s) / RADIUS) ** 4
    s = s / RADIUS + 1
    xi = 1 / (a - s)
    eta = a * ecc * xi
    eta2, ee = eta * eta, ecc * eta
    psi = np.abs(1 - eta2)
    coef = q4 * xi**4
    coef1 = coef / psi**3.5
    k2 = coef1 * n0 * (a * (1 + 1.5 * eta2 + ee * (4 + eta2)) + 0.375 * J2 * xi / psi * con41 * (8 + 3 * eta2 * (8 + eta2)))
    k1 = b * k2
    round_ = ecc > 1e-4
    k3 = np.where(round_, -2 * coef * xi * (J3 / J2) * n0 * si / np.where(round_, ecc, 1), 0)
    k4 = 2 * n0 * coef1 * a * beta2 * (eta * (2 + 0.5 * eta2) + ecc * (0.5 + 2 * eta2) - J2 * xi / (a * psi) * (-3 * con41 * (1 - 2 * ee + eta2 * (1.5 - 0.5 * ee)) + 0.75 * sin2 * (2 * eta2 - ee * (1 + eta2)) * np.cos(2 * peri)))
    k5 = 2 * coef1 * a * beta2 * (1 + 2.75 * (eta2 + ee) + ee * eta2)
    t1 = 1.5 * J2 * p2 * n0
    t2 = 0.5 * t1 * J2 * p2
    t3 = -0.46875 * J4 * p2 * p2 * n0
    m_dot = n0 + 0.5 * t1 * beta * con41 + 0.0625 * t2 * beta * (13 - 78 * c2 + 137 * c2 * c2)
    w_dot = -0.5 * t1 * con42 + 0.0625 * t2 * (7 - 114 * c2 + 395 * c2 * c2) + t3 * (3 - 36 * c2 + 49 * c2 * c2)
    h_dot = -t1 * ci
    o_dot = h_dot + (0.5 * t2 * (4 - 19 * c2) + 2 * t3 * (3 - 7 * c2)) * ci
    w_cof, m_cof = b * k3 * np.cos(peri), np.where(round_, -2 / 3 * coef * b / np.where(round_, ee, 1), 0)
    simple = low < 220 / RADIUS + 1
    d2 = 4 * a * xi * k1 * k1
    u = d2 * xi * k1 / 3
    d3, d4 = (17 * a + s) * u, 0.5 * u * a * xi * (221 * a + 31 * s) * k1
    l3, l4 = d2 + 2 * k1 * k1, 0.25 * (3 * d3 + k1 * (12 * d2 + 10 * k1 * k1))
    l5 = 0.2 * (3 * d4 + 12 * k1 * d3 + 6 * d2 * d2 + 15 * k1 * k1 * (2 * d2 + k1 * k1))
    m, w, o = anom + m_dot * t, peri + w_dot * t, node + o_dot * t + 3.5 * beta2 * h_dot * k1 * t * t
    shift = np.where(simple, 0, w_cof * t + m_cof * ((1 + eta * np.cos(m)) ** 3 - (1 + eta * np.cos(anom)) ** 3))
    mm, w = m + shift, w - shift
    shrink = 1 - k1 * t - np.where(simple, 0, d2 * t**2 + d3 * t**3 + d4 * t**4)
    drag = b * k4 * t + np.where(simple, 0, b * k5 * (np.sin(mm) - np.sin(anom)))
    long = 1.5 * k1 * t * t + np.where(simple, 0, l3 * t**3 + t**4 * (l4 + t * l5))
    a = (XKE / n0) ** (2 / 3) * shrink**2
    ecc = np.maximum(ecc - drag, 1e-6)
    mm = mm + n0 * long
    ax = ecc * np.cos(w)
    inv = 1 / (a * (1 - ecc * ecc))
    ay = ecc * np.sin(w) - 0.5 * inv * (J3 / J2) * si
    den = np.where(np.abs(1 + ci) > 1.5e-12, 1 + ci, 1.5e-12)
    lon = np.mod(mm + w - 0.25 * inv * (J3 / J2) * si * (3 + 5 * ci) / den * ax, 2 * np.pi)
    x = lon.copy()
    for _ in range(10):
        x = x + np.clip((lon - ay * np.cos(x) + ax * np.sin(x) - x) / (1 - np.cos(x) * ax - np.sin(x) * ay), -0.95, 0.95)
    ec, es = ax * np.cos(x) + ay * np.sin(x), ax * np.sin(x) - ay * np.cos(x)
    l2 = ax * ax + ay * ay
    p, r, bl = a * (1 - l2), a * (1 - ec), np.sqrt(1 - l2)
    f = es / (1 + bl)
    su, cu = a / r * (np.sin(x) - ay - ax * f), a / r * (np.cos(x) - ax + ay * f)
    arg, s2, cc = np.arctan2(su, cu), 2 * su * cu, 1 - 2 * su * su
    j, jj = 0.5 * J2 / p, 0.5 * J2 / (p * p)
    r = r * (1 - 1.5 * jj * bl * con41) + 0.5 * j * sin2 * cc
    arg, o, i = arg - 0.25 * jj * x7 * s2, o + 1.5 * jj * ci * s2, inc + 1.5 * jj * ci * si * cc
    ux = -np.sin(o) * np.cos(i) * np.sin(arg) + np.cos(o) * np.cos(arg)
    uy = np.cos(o) * np.cos(i) * np.sin(arg) + np.sin(o) * np.cos(arg)
    return np.stack([ux, uy, np.sin(i) * np.sin(arg)], -1) * (r * RADIUS)[..., None]


def sidereal(unix: np.ndarray) -> np.ndarray:
    """Mean sidereal time at Greenwich, radians."""
    d = unix / 86400.0 + 2440587.5 - 2451545.0
    t = d / 36525.0
    return np.radians((280.46061837 + 360.98564736629 * d + 0.000387933 * t * t) % 360)


def sun_direction(unix: np.ndarray) -> np.ndarray:
    d = unix / 86400.0 + 2440587.5 - 2451545.0
    g = np.radians(357.529 + 0.98560028 * d)
    lon = np.radians(280.459 + 0.98564736 * d + 1.915 * np.sin(g) + 0.020 * np.sin(2 * g))
    eps = np.radians(23.439 - 0.00000036 * d)
    return np.stack([np.cos(lon), np.cos(eps) * np.sin(lon), np.sin(eps) * np.sin(lon)], -1)


def site(lat: float, lon: float, alt: float, unix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An observer's position (km) and zenith in the satellites' frame."""
    f, a = 1 / 298.257223563, 6378.137
    la, th = np.radians(lat), sidereal(unix) + np.radians(lon)
    c = a / np.sqrt(1 - f * (2 - f) * np.sin(la) ** 2)
    h = alt / 1000.0
    up = np.stack([np.cos(la) * np.cos(th), np.cos(la) * np.sin(th), np.full_like(th, np.sin(la))], -1)
    return up * np.array([c + h, c + h, c * (1 - f) ** 2 + h]), up


def samples(elements: DataFrame, times: list[float], observer: tuple[float, float, float]) -> DataFrame:
    """Apparent places of element sets (norad_id, epoch, inclination, node, eccentricity, perigee, anomaly, motion, bstar) at
    given instants: norad_id, i, t, ra, dec, range_km, elevation_deg, sunlit. A narrow map: elements stay where they are."""
    names = ["inclination", "node", "eccentricity", "perigee", "anomaly", "motion", "bstar"]
    at = np.asarray(times, np.float64)
    schema = "norad_id int, i int, t double, ra double, dec double, range_km double, elevation_deg double, sunlit double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ground, up = site(*observer, at)
        sun = sun_direction(at)
        for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            e = {k: batch.column(2 + n).to_numpy(zero_copy_only=False).astype(float) for n, k in enumerate(names)}
            epoch = batch.column(1).to_numpy(zero_copy_only=False)
            with np.errstate(all="ignore"):
                pos = sgp4(e, (at[None] - epoch[:, None]) / 60)
            d = pos - ground
            dist = np.linalg.norm(d, axis=-1)
            u = d / dist[..., None]
            ra, dec = np.degrees(np.arctan2(u[..., 1], u[..., 0])) % 360, np.degrees(np.arcsin(np.clip(u[..., 2], -1, 1)))
            elevation = np.degrees(np.arcsin(np.clip((u * up).sum(-1), -1, 1)))
            along = (pos * sun).sum(-1)
            off = np.linalg.norm(pos - along[..., None] * sun, axis=-1)
            lit = np.where((along > 0) | (off > RADIUS), 1.0, 0.0)
            ok = np.isfinite(dist)
            n, m = np.nonzero(ok)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"norad_id": ids[n].astype(np.int32), "i": m.astype(np.int32), "t": at[m], "ra": ra[ok], "dec": dec[ok], "range_km": dist[ok], "elevation_deg": elevation[ok], "sunlit": lit[ok]})

    return elements.where(F.col("motion") > 6.4).select(F.col("norad_id").cast("int"), F.col("epoch").cast("double"), *[F.col(k).cast("double") for k in names]).mapInArrow(run, schema)


def tracks_in_footprint(elements: DataFrame, start: float, end: float, observer: tuple[float, float, float], wcs: Wcs, width: int, height: int, step: float = 1.0, coarse: float = 10.0, min_elevation: float = 0.0, max_age: float = 7 * 86400.0) -> DataFrame:
    """Satellites that cross an image during an exposure: norad_id, segments, length, max_elevation_deg, min_range_km,
    sunlight, by falling elevation, then id. Stale sets go, a coarse pass over a padded field spares the fine one."""
    fresh = elements.where(F.abs(F.col("epoch") - (start + end) / 2) <= max_age)

    def grid(every: float) -> list[float]:
        n = max(1, int(np.ceil((end - start) / every)))
        return [start + (end - start) * i / n for i in range(n + 1)]

    def placed(s: DataFrame) -> DataFrame:
        x, y = wcs.to_pixel(F.col("ra"), F.col("dec"))
        return s.where(F.col("elevation_deg") >= min_elevation).withColumn("x", x).withColumn("y", y)

    pad = 0.1 * max(width, height)
    wide = placed(samples(fresh, grid(coarse), observer)).where("x is not null")
    shifted = wide.withColumn("x", F.col("x") + pad).withColumn("y", F.col("y") + pad)
    near = segments(shifted, ["norad_id"], "i", int(width + 2 * pad), int(height + 2 * pad)).select("norad_id").distinct()
    fine = placed(samples(fresh.join(near, "norad_id", "left_semi"), grid(step), observer))
    parts = path_lengths(segments(fine.where("x is not null"), ["norad_id"], "i", width, height), ["norad_id"])
    seen = fine.groupBy("norad_id").agg(F.max("elevation_deg").alias("max_elevation_deg"), F.min("range_km").alias("min_range_km"), F.max("sunlit").alias("sunlight"))
    return parts.join(seen, "norad_id").orderBy(F.desc("max_elevation_deg"), "norad_id")
