"""Spherical geometry and tangent-plane projections as column expressions; angles in degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | float | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def unit_vector(ra: Column | float | str, dec: Column | float | str) -> tuple[Column, Column, Column]:
    a, d = F.radians(_c(ra)), F.radians(_c(dec))
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def vector(ra: float, dec: float) -> tuple[float, float, float]:
    """A unit vector computed on the driver, for literals."""
    a, d = math.radians(ra), math.radians(dec)
    return math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)


def dot(u, v) -> Column | float:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u, v):
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def angle(cosine: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))


def separation(ra1, dec1, ra2, dec2) -> Column:
    """Angular separation by the formula that stays exact at all distances."""
    d1, d2, da = F.radians(_c(dec1)), F.radians(_c(dec2)), F.radians(_c(ra2) - _c(ra1))
    x = F.cos(d2) * F.sin(da)
    y = F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(da)
    return F.degrees(F.atan2(F.sqrt(x * x + y * y), F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(da)))


def bearing(ra1, dec1, ra2, dec2) -> Column:
    """Position angle of the second point from the first, north through east, 0 to 360."""
    d1, d2, da = F.radians(_c(dec1)), F.radians(_c(dec2)), F.radians(_c(ra2) - _c(ra1))
    return F.pmod(F.degrees(F.atan2(F.sin(da) * F.cos(d2), F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(da))), F.lit(360.0))


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


class TileGrid:
    """Declination bands of equal height, cut in right ascension into bins of about that width."""

    def __init__(self, bands: int = 45) -> None:
        self.bands, self.height = bands, 180.0 / bands
        middle = [-90.0 + (b + 0.5) * self.height for b in range(bands)]
        self.bins = [max(1, math.ceil(360.0 * max(math.cos(math.radians(m)), 1e-6) / self.height)) for m in middle]
        self.offsets = [sum(self.bins[:b]) for b in range(bands)]
        self.tiles = sum(self.bins)

    def band(self, dec: Column) -> Column:
        return F.least(F.greatest(((dec + 90.0) / 180.0 * self.bands).cast("int"), F.lit(0)), F.lit(self.bands - 1))

    def tile(self, ra: Column, dec: Column) -> Column:
        band = self.band(dec)
        bins, offsets = F.array(*map(F.lit, self.bins)), F.array(*map(F.lit, self.offsets))
        n = bins[band]
        return (offsets[band] + F.least((F.pmod(ra, F.lit(360.0)) / 360.0 * n).cast("int"), n - 1)).cast("int")

    def reach(self, dec: Column, radius: Column | float) -> Column:
        """How far in right ascension a cap reaches: the exact tangent longitude, 180 if it holds a pole."""
        r = _c(radius)
        s = F.sin(F.radians(r)) / F.cos(F.radians(dec))
        return F.when(F.abs(dec) + r >= 90.0, 180.0).otherwise(F.degrees(F.abs(F.asin(F.greatest(F.least(s, F.lit(1.0)), F.lit(-1.0))))))

    def cover(self, ra: Column, dec: Column, radius: Column | float) -> Column:
        """The tiles that a cap may touch, as an array: a superset, without duplicates."""
        r = _c(radius)
        wide = self.reach(dec, r)
        lo, hi = self.band(F.greatest(dec - r, F.lit(-90.0))), self.band(F.least(dec + r, F.lit(90.0)))
        bins, offsets = F.array(*map(F.lit, self.bins)), F.array(*map(F.lit, self.offsets))

        def of_band(b: Column) -> Column:
            n = bins[b]
            width = F.lit(360.0) / n
            start = F.floor(F.pmod(ra - wide, F.lit(360.0)) / width)
            span = F.least(F.when(wide >= 180.0, n).otherwise(F.ceil(wide * 2.0 / width) + 1), n).cast("int")
            return F.transform(F.sequence(F.lit(0), span - 1), lambda i: (offsets[b] + F.pmod(start + i, n)).cast("int"))

        return F.flatten(F.transform(F.sequence(lo, hi), of_band))

    def cover_literal(self, ra: float, dec: float, radius: float) -> list[int]:
        """The same for one cap, on the driver: for partition pruning with ``tile IN (...)``."""
        if radius >= 180:
            return list(range(self.tiles))
        band = lambda d: min(max(int((d + 90.0) / 180.0 * self.bands), 0), self.bands - 1)
        full = abs(dec) + radius >= 90
        wide = 180.0 if full else math.degrees(math.asin(min(1.0, math.sin(math.radians(radius)) / math.cos(math.radians(dec)))))
        out = []
        for b in range(band(max(dec - radius, -90.0)), band(min(dec + radius, 90.0)) + 1):
            n = self.bins[b]
            start = int(((ra - wide) % 360.0) / (360.0 / n))
            span = n if full else min(n, math.ceil(2 * wide / (360.0 / n)) + 1)
            out += [self.offsets[b] + (start + i) % n for i in range(span)]
        return sorted(set(out))


@dataclass(frozen=True)
class Wcs:
    """A tangent-plane projection: reference point, reference pixel, CD matrix in degrees a pixel, and SIP terms if any."""

    ra0: float
    dec0: float
    px: float
    py: float
    cd: tuple[float, float, float, float]
    sip: tuple[int, tuple, tuple, tuple, tuple] | None = None

    @classmethod
    def simple(cls, ra0: float, dec0: float, px: float, py: float, scale_arcsec: float, rotation_deg: float = 0.0) -> Wcs:
        s, t = scale_arcsec / 3600.0, math.radians(rotation_deg)
        return cls(ra0, dec0, px, py, (-s * math.cos(t), s * math.sin(t), s * math.sin(t), s * math.cos(t)))

    @property
    def scale(self) -> float:
        """Arcseconds a pixel."""
        return math.sqrt(abs(self.cd[0] * self.cd[3] - self.cd[1] * self.cd[2])) * 3600.0

    def inverse(self) -> tuple[float, float, float, float]:
        a, b, c, d = self.cd
        det = a * d - b * c
        return d / det, -b / det, -c / det, a / det

    @staticmethod
    def terms(order: int, constant: bool = False) -> list[tuple[int, int]]:
        """Exponents (p, q), p before q, of total degree 2 (0 with ``constant``) to ``order``."""
        return [(p, q) for p in range(order + 1) for q in range(order + 1 - p) if constant or p + q >= 2]

    def _sip(self, u: Column, v: Column, forward: bool) -> tuple[Column, Column]:
        if self.sip is None:
            return u, v
        order, a, b, ap, bp = self.sip
        first, second = (a, b) if forward else (ap, bp)
        mono = [F.pow(u, F.lit(p)) * F.pow(v, F.lit(q)) for p, q in self.terms(order, not forward)]
        add = lambda k: sum((m * float(c) for m, c in zip(mono, k)), F.lit(0.0))
        return u + add(first), v + add(second)

    def to_pixel(self, ra: Column, dec: Column) -> tuple[Column, Column]:
        """Pixel coordinates; null behind the horizon."""
        a, d, d0 = F.radians(ra - self.ra0), F.radians(dec), math.radians(self.dec0)
        c = F.sin(d) * math.sin(d0) + F.cos(d) * F.cos(a) * math.cos(d0)
        ahead = c > 1e-12
        xi = F.when(ahead, F.degrees(F.cos(d) * F.sin(a) / c))
        eta = F.when(ahead, F.degrees((F.sin(d) * math.cos(d0) - F.cos(d) * F.cos(a) * math.sin(d0)) / c))
        i, j, k, m = self.inverse()
        u, v = self._sip(xi * i + eta * j, xi * k + eta * m, False)
        return u + self.px, v + self.py

    def to_world(self, x: Column, y: Column) -> tuple[Column, Column]:
        u, v = self._sip(x - self.px, y - self.py, True)
        xi, eta = F.radians(u * self.cd[0] + v * self.cd[1]), F.radians(u * self.cd[2] + v * self.cd[3])
        d0 = math.radians(self.dec0)
        den = F.lit(math.cos(d0)) - eta * math.sin(d0)
        ra = F.pmod(F.degrees(F.atan2(xi, den)) + self.ra0, F.lit(360.0))
        dec = F.degrees(F.atan2(eta * math.cos(d0) + math.sin(d0), F.sqrt(xi * xi + den * den)))
        return ra, dec

    def footprint(self, width: int, height: int) -> list[tuple[float, float]]:
        """The sky positions of the image's corners, computed on the driver."""
        return [self.world(x, y) for x, y in ((0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1))]

    def world(self, x: float, y: float) -> tuple[float, float]:
        u, v = x - self.px, y - self.py
        if self.sip is not None:
            t = self.terms(self.sip[0])
            u, v = u + sum(c * u**p * v**q for c, (p, q) in zip(self.sip[1], t)), v + sum(c * u**p * v**q for c, (p, q) in zip(self.sip[2], t))
        xi, eta = math.radians(u * self.cd[0] + v * self.cd[1]), math.radians(u * self.cd[2] + v * self.cd[3])
        d0 = math.radians(self.dec0)
        den = math.cos(d0) - eta * math.sin(d0)
        return (math.degrees(math.atan2(xi, den)) + self.ra0) % 360, math.degrees(math.atan2(eta * math.cos(d0) + math.sin(d0), math.hypot(xi, den)))

    def cards(self) -> dict[str, object]:
        """Header cards, pixels counted from 1."""
        out: dict[str, object] = {"CTYPE1": "RA---TAN" + "-SIP" * (self.sip is not None), "CTYPE2": "DEC--TAN" + "-SIP" * (self.sip is not None), "CRVAL1": self.ra0, "CRVAL2": self.dec0, "CRPIX1": self.px + 1, "CRPIX2": self.py + 1}
        out |= dict(zip(("CD1_1", "CD1_2", "CD2_1", "CD2_2"), self.cd))
        if self.sip is not None:
            order, *sets = self.sip
            for letter, values, terms in zip(("A", "B", "AP", "BP"), sets, (self.terms(order), self.terms(order), self.terms(order, True), self.terms(order, True))):
                out[f"{letter}_ORDER"] = order
                out |= {f"{letter}_{p}_{q}": c for (p, q), c in zip(terms, values)}
        return out
