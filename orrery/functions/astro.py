"""Dates, proper motion, Kepler's equation and positions of bodies as column expressions; angles in degrees unless said."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gaussian constant, obliquity of J2000, astronomical units a light day, Julian date of the Unix epoch.
GAUSS, OBLIQUITY, LIGHT_DAY, UNIX_JD = 0.01720209895, 23.43929111, 173.14463267, 2440587.5


def julian_date(y: Column, m: Column, d: Column) -> Column:
    """Julian date of a Gregorian date; ``d`` may hold a fraction."""
    late = (m <= 2).cast("int")
    yy, mm = y - late, m + late * 12
    century = F.floor(yy / 100)
    return F.floor((yy + 4716) * 365.25) + F.floor((mm + 1) * 30.6001) + d + (F.lit(2) - century + F.floor(century / 4)) - 1524.5


def unix_to_jd(t: Column) -> Column:
    return t / 86400.0 + UNIX_JD


def jd_to_unix(jd: Column) -> Column:
    return (jd - UNIX_JD) * 86400.0


def iso_to_unix(text: Column) -> Column:
    """Seconds of an ISO 8601 instant; a missing clock is midnight."""
    t = F.regexp_replace(F.trim(text), "Z$", "")
    t = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00"))).otherwise(t)
    return F.unix_micros(F.try_to_timestamp(t)) / 1e6


def exposure_interval(start: Column, middle: Column, end: Column, duration: Column) -> Column:
    """struct<start, end> from whichever of start, middle and end is known, in that order, with the duration."""
    lo = F.coalesce(start, middle - duration / 2.0, end - duration)
    return F.struct(lo.alias("start"), F.coalesce(F.when(start.isNotNull(), start + duration), middle + duration / 2.0, end).alias("end"))


def sample_times(start: Column, end: Column, step: float) -> Column:
    """Evenly spaced instants from start to end: ceil(duration / step) equal parts, a million at most."""
    n = F.least(F.greatest(F.ceil((end - start) / step), F.lit(1)), F.lit(1_000_000)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: start + (end - start) * i / n)


def propagate(ra: Column, dec: Column, pm_ra: Column, pm_dec: Column, years: float) -> tuple[Column, Column]:
    """Position after proper motion (mas a year, in right ascension times cos dec)."""
    a = ra + pm_ra * years / 3.6e6 / F.greatest(F.cos(F.radians(dec)), F.lit(1e-9))
    return F.pmod(a, F.lit(360.0)), F.least(F.greatest(dec + pm_dec * years / 3.6e6, F.lit(-90.0)), F.lit(90.0))


def eccentric_anomaly(m: Column, e: Column, rounds: int = 12) -> Column:
    """Kepler's equation for an ellipse by Newton's method, radians; a fixed number of rounds, enough for e below 0.95."""
    m = F.pmod(m + math.pi, F.lit(2 * math.pi)) - math.pi
    start = m + e * F.signum(m) * 0.85
    state = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(start.alias("x"), m.alias("m"), e.alias("e")), lambda s, _: F.struct((s["x"] - (s["x"] - s["e"] * F.sin(s["x"]) - s["m"]) / (F.lit(1.0) - s["e"] * F.cos(s["x"]))).alias("x"), s["m"].alias("m"), s["e"].alias("e")))
    return state["x"]


def heliocentric(a: Column, e: Column, incl: Column, node: Column, argp: Column, m0: Column, epoch: Column, jd: Column | float) -> tuple[Column, Column, Column]:
    """Ecliptic x, y, z in astronomical units of a body on an ellipse."""
    n = F.lit(GAUSS) / F.pow(a, F.lit(1.5))
    mean = F.radians(m0) + n * (F.lit(jd) - epoch if not isinstance(jd, Column) else jd - epoch)
    ecc = eccentric_anomaly(mean, e)
    px, py = a * (F.cos(ecc) - e), a * F.sqrt(F.lit(1.0) - e * e) * F.sin(ecc)
    w, o, i = F.radians(argp), F.radians(node), F.radians(incl)
    x1, y1 = px * F.cos(w) - py * F.sin(w), px * F.sin(w) + py * F.cos(w)
    return x1 * F.cos(o) - y1 * F.cos(i) * F.sin(o), x1 * F.sin(o) + y1 * F.cos(i) * F.cos(o), y1 * F.sin(i)


def earth(jd: float) -> tuple[float, float, float]:
    """The Earth's ecliptic position from its mean elements (published low-precision values), on the driver."""
    t = (jd - 2451545.0) / 36525.0
    a, e = 1.00000261 + 0.00000562 * t, 0.01671123 - 0.00004392 * t
    length, peri = math.radians(100.46457166 + 35999.37244981 * t), math.radians(102.93768193 + 0.32327364 * t)
    m = math.remainder(length - peri, 2 * math.pi)
    x = m
    for _ in range(20):
        x -= (x - e * math.sin(x) - m) / (1 - e * math.cos(x))
    px, py = a * (math.cos(x) - e), a * math.sqrt(1 - e * e) * math.sin(x)
    return px * math.cos(peri) - py * math.sin(peri), px * math.sin(peri) + py * math.cos(peri), 0.0


def geocentric(xyz: tuple[Column, Column, Column], jd: float) -> tuple[Column, Column, Column]:
    """Right ascension, declination and distance from the Earth (ecliptic turned to the equator)."""
    ex, ey, ez = earth(jd)
    x, y, z = xyz[0] - ex, xyz[1] - ey, xyz[2] - ez
    c, s = math.cos(math.radians(OBLIQUITY)), math.sin(math.radians(OBLIQUITY))
    yq, zq = y * c - z * s, y * s + z * c
    r = F.sqrt(x * x + yq * yq + zq * zq)
    return F.pmod(F.degrees(F.atan2(yq, x)), F.lit(360.0)), F.degrees(F.asin(zq / r)), r


def asteroid_magnitude(h: Column, sun: Column, earth_distance: Column) -> Column:
    """Apparent magnitude without the phase slope."""
    return h + F.log10(sun * earth_distance) * 5.0


def hyperbolic_anomaly(m: Column, e: Column, rounds: int = 30) -> Column:
    """Kepler's equation for a hyperbola by Newton's method, a fixed number of rounds."""
    start = F.signum(m) * F.log(F.abs(m) * 2.0 / e + 1.8)
    sinh, cosh = (lambda x: F.sinh(x)), (lambda x: F.cosh(x))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(start.alias("x"), m.alias("m"), e.alias("e")), lambda s, _: F.struct((s["x"] - (s["e"] * sinh(s["x"]) - s["x"] - s["m"]) / (s["e"] * cosh(s["x"]) - 1.0)).alias("x"), s["m"].alias("m"), s["e"].alias("e")))
    return state["x"]


def barker(w: Column) -> Column:
    """The root s of s^3 / 3 + s = w, for parabolas."""
    y = F.cbrt((w * 3.0 + F.sqrt(w * w * 9.0 + 4.0)) / 2.0)
    return y - F.lit(1.0) / y


def comet_plane(q: Column, e: Column, days: Column) -> tuple[Column, Column]:
    """Position in the orbit's plane (x toward perihelion) ``days`` after perihelion, for any eccentricity."""
    a = q / F.abs(F.lit(1.0) - e)
    mean = F.lit(GAUSS) * days / F.pow(a, F.lit(1.5))
    x = eccentric_anomaly(mean, e)
    h = hyperbolic_anomaly(mean, e)
    s = barker(F.lit(GAUSS) * days / (F.pow(q, F.lit(1.5)) * 2**0.5) * 1.0)
    para = F.abs(e - 1.0) < 1e-6
    px = F.when(para, q * (F.lit(1.0) - s * s)).when(e < 1, a * (F.cos(x) - e)).otherwise(a * (e - F.cosh(h)))
    py = F.when(para, q * s * 2.0).when(e < 1, a * F.sqrt(F.lit(1.0) - e * e) * F.sin(x)).otherwise(a * F.sqrt(e * e - 1.0) * F.sinh(h))
    return px, py


def turned(px: Column, py: Column, incl: Column, node: Column, argp: Column) -> tuple[Column, Column, Column]:
    """From the orbit's plane to the ecliptic."""
    w, o, i = F.radians(argp), F.radians(node), F.radians(incl)
    x1, y1 = px * F.cos(w) - py * F.sin(w), px * F.sin(w) + py * F.cos(w)
    return x1 * F.cos(o) - y1 * F.cos(i) * F.sin(o), x1 * F.sin(o) + y1 * F.cos(i) * F.cos(o), y1 * F.sin(i)


def comet_magnitude(h: Column, slope: Column, sun: Column, earth_distance: Column) -> Column:
    return h + F.log10(earth_distance) * 5.0 + slope * 2.5 * F.log10(sun)


def sun_place(jd: float) -> tuple[float, float]:
    """The Sun's right ascension and declination, on the driver."""
    x, y, z = (-c for c in earth(jd))
    c, s = math.cos(math.radians(OBLIQUITY)), math.sin(math.radians(OBLIQUITY))
    yq, zq = y * c - z * s, y * s + z * c
    return math.degrees(math.atan2(yq, x)) % 360, math.degrees(math.asin(zq / math.sqrt(x * x + yq * yq + zq * zq)))


def snapshot_age(instant: Column, now: float, tolerance: float = 300.0) -> Column:
    """Seconds since a snapshot; 0 up to ``tolerance`` in the future, infinite beyond it or if unknown."""
    age = F.lit(float(now)) - instant
    return F.when(age >= 0, age).when(age >= -tolerance, 0.0).otherwise(float("inf"))


def historical(midpoint: Column, now: float, current: float) -> Column:
    """Whether an exposure is too old for the current catalogue."""
    return F.lit(float(now)) - midpoint > current
