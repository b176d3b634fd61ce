"""Region queries and catalog joins on the sphere, pruned by tiles."""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, asin, atan2, cos, degrees, radians, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sky import TileGrid, angle, cross, dot, separation, unit_vector, vector

GRID = TileGrid(45)
#: Rows of a side at most for a broadcast; beyond it both sides are dealt by tile.
BROADCAST_ROWS = 100_000
#: Half extents, in degrees, that a region's tiles are widened by.
WIDE = 1.0


@dataclass(frozen=True)
class Cone:
    ra: float
    dec: float
    radius: float

    def center(self) -> tuple[float, float, float]:
        return vector(self.ra, self.dec)

    def inside(self, u) -> Column:
        return angle(dot(u, self.center())) <= self.radius + 1e-10

    def boundary_distance(self, u) -> Column:
        return F.abs(angle(dot(u, self.center())) - self.radius)


@dataclass(frozen=True)
class Polygon:
    """A convex spherical polygon with its vertices in boundary order, validated when made."""

    corners: tuple[tuple[float, float], ...]

    def __post_init__(self) -> None:
        if len(self.corners) < 3:
            raise ValueError("a polygon needs three vertices")
        c = self.center()
        sides = [dot(n, c) for n, _, _ in self._edges()]
        if any(abs(s) < 1e-12 for s in sides) or len({s > 0 for s in sides}) > 1:
            raise ValueError("the polygon is not convex, or its vertices are out of order")
        vertices = [vector(*p) for p in self.corners]
        if any(dot(n, v) * sides[0] < -1e-12 for n, _, _ in self._edges() for v in vertices):
            raise ValueError("the polygon is not convex, or its vertices are out of order")
        if not 0 < self.radius < 90:
            raise ValueError("the polygon's radius must lie between 0 and 90 degrees")

    def center(self) -> tuple[float, float, float]:
        v = [vector(*p) for p in self.corners]
        s = [sum(x[i] for x in v) for i in range(3)]
        n = sqrt(sum(x * x for x in s))
        if n < 1e-12:
            raise ValueError("the polygon has no centre")
        return s[0] / n, s[1] / n, s[2] / n

    @property
    def radius(self) -> float:
        c = self.center()
        return max(degrees(acos(max(-1.0, min(1.0, dot(vector(*p), c))))) for p in self.corners)

    def _edges(self):
        v = [vector(*p) for p in self.corners]
        return [(cross(a, b), a, b) for a, b in zip(v, [*v[1:], v[0]])]

    def inside(self, u) -> Column:
        c = self.center()
        tests = [dot(u, n) * (1.0 if dot(n, c) > 0 else -1.0) >= -1e-12 for n, _, _ in self._edges()]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def boundary_distance(self, u) -> Column:
        """To the nearest arc: the foot of the perpendicular where it lies on the arc, else the nearer end."""
        parts = []
        for n, a, b in self._edges():
            size = sqrt(dot(n, n))
            m = (n[0] / size, n[1] / size, n[2] / size)
            height = F.abs(F.degrees(F.asin(F.greatest(F.least(dot(u, m), F.lit(1.0)), F.lit(-1.0)))))
            on = (dot(u, cross(m, a)) >= 0) & (dot(u, cross(b, m)) >= 0)
            parts.append(F.when(on, height).otherwise(F.least(angle(dot(u, a)), angle(dot(u, b)))))
        return F.least(*parts) if len(parts) > 1 else parts[0]


def prominence(inside: Column, radius: float) -> Column:
    """Predicted prominence from size, magnitude, a common name and placement."""
    size = F.coalesce(F.lit(1.0) - F.exp(F.col("major_arcmin") * -2.0 / max(radius * 120.0, 1e-9)), F.lit(0.0))
    mag = F.coalesce(F.greatest(F.least((F.lit(16.0) - F.col("mag")) / 16.0, F.lit(1.0)), F.lit(0.0)), F.lit(0.0))
    named = F.when(F.col("common_name") != "", 1.0).otherwise(0.0)
    placed = F.when(inside, 1.0).otherwise(0.7)
    return F.greatest(F.least((size * 0.65 + mag * 0.30 + named * 0.05) * placed, F.lit(1.0)), F.lit(0.0))


_SORTS = {
    "prominence": lambda: [F.desc("prominence")],
    "size": lambda: [F.desc(F.coalesce("major_arcmin", F.lit(0.0)))],
    "magnitude": lambda: [F.asc_nulls_last("mag")],
    "distance": lambda: [F.asc("distance_deg")],
    "name": lambda: [F.asc("name")],
}


def region_query(objects: DataFrame, region: Cone | Polygon, kinds: list[str] | None = None, max_mag: float | None = None, min_major: float | None = None, named_only: bool = False, extents: bool = True, sort: str = "prominence", limit: int | None = None) -> DataFrame:
    """Objects in or (with ``extents``) overlapping a region, ranked. Cheap filters come first; unknown measures fail them.

    ``objects``: id, kind, ra, dec, mag, major_arcmin, name, common_name. Ties go to size, then id. Where the table has
    a column ``tile`` (as the sink lays it out), the tiles that the region may touch, and with ``extents`` the objects over
    ``WIDE`` degrees wherever they are, are folded into the plan as a filter that reaches the scan.
    """
    df = objects
    if "tile" in objects.columns:
        x, y, z = region.center()
        near = F.col("tile").isin(GRID.cover_literal(degrees(atan2(y, x)) % 360, degrees(asin(max(-1.0, min(1.0, z)))), region.radius + (WIDE if extents else 0.0) + 1e-6))
        df = df.where(near | (F.col("major_arcmin") > WIDE * 120.0) if extents else near)
    if kinds:
        df = df.where(F.col("kind").isin(kinds))
    if max_mag is not None:
        df = df.where(F.col("mag") <= max_mag)
    if min_major is not None:
        df = df.where(F.col("major_arcmin") >= min_major)
    if named_only:
        df = df.where(F.coalesce(F.col("common_name"), F.lit("")) != "")
    c = region.center()
    u = unit_vector("ra", "dec")
    center_distance = angle(dot(u, c))
    extent = F.coalesce(F.col("major_arcmin"), F.lit(0.0)) / 120.0 if extents else F.lit(0.0)
    df = df.withColumn("distance_deg", center_distance).where(F.col("distance_deg") <= F.lit(region.radius + 1e-9) + extent)
    df = df.withColumn("center_inside", region.inside(u))
    keep = F.col("center_inside")
    if extents:
        keep = keep | (region.boundary_distance(u) <= extent)
    df = df.where(keep).withColumn("prominence", prominence(F.col("center_inside"), region.radius))
    order = [*_SORTS[sort](), F.desc(F.coalesce("major_arcmin", F.lit(0.0))), F.asc("id")]
    out = df.orderBy(*order)
    return out.limit(limit) if limit else out


def with_tile(df: DataFrame, ra: str = "ra", dec: str = "dec", grid: TileGrid = GRID) -> DataFrame:
    return df.withColumn("tile", grid.tile(F.col(ra), F.col(dec)))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")  # the planner takes exploded tiles for small


def cone_join(centers: DataFrame, stars: DataFrame, radius: float, grid: TileGrid = GRID) -> DataFrame:
    """Stars (ra, dec) within ``radius`` of centres (ra0, dec0): an equality join on tiles with the exact test behind it."""
    c = centers.withColumn("tile", F.explode(grid.cover(F.col("ra0"), F.col("dec0"), radius)))
    u, v = unit_vector("ra", "dec"), unit_vector("ra0", "dec0")
    return with_tile(stars, grid=grid).join(_bounded(c), "tile").where(dot(u, v) >= cos(radians(radius))).drop("tile")


def cone_topk(centers: DataFrame, stars: DataFrame, radius: float, k: int) -> DataFrame:
    """The ``k`` brightest stars of each cone, rank by magnitude, then id.

    Where cones hold many more, the brightest stars of the sky are tried first: a cone with ``k`` of them is done, the others go on
    with eight times as many, at last with all. The magnitudes at which the sky is cut only decide how long it takes."""
    expected = stars.count() * (1 - cos(radians(radius))) / 2 / (8 * k)
    shares = [8**i / expected for i in range(20) if 8**i < expected / 2]
    cuts = stars.agg(F.percentile_approx("mag", shares, 10_000)).first()[0] if shares else None
    w = Window.partitionBy("sid").orderBy("mag", "id")
    rest, out = centers, None
    for cut in [*(cuts or []), None]:
        pool = stars if cut is None else stars.where(F.col("mag").isNull() | (F.col("mag") <= cut))
        found = cone_join(rest, pool, radius).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if cut is not None:
            done = found.where(F.col("rank") == k).select("sid")
            rest, found = rest.join(done, "sid", "left_anti"), found.join(done, "sid", "left_semi")
        out = found if out is None else out.unionByName(found)
    return out


def nearest_match(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Greedy one-to-one matching of points (id, x, y): each left point proposes its nearest right point within the
    tolerance, each right point takes its closest proposal; ties go to the lower id. Points meet by grid cell."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.select(F.col("id").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.explode(around).alias("n"))
    a = a.select("lid", "lx", "ly", (F.floor(F.col("lx") / tolerance) + F.col("n.i")).alias("cx"), (F.floor(F.col("ly") / tolerance) + F.col("n.j")).alias("cy"))
    b = right.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt((F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")) + (F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry")))
    pairs = a.join(b, ["cx", "cy"]).withColumn("dist", d).where(F.col("dist") <= tolerance)
    best = pairs.groupBy("lid").agg(F.min(F.struct("dist", "rid")).alias("m")).select("lid", "m.dist", "m.rid")
    return best.groupBy("rid").agg(F.min(F.struct("dist", "lid")).alias("m")).select(F.col("m.lid").alias("left_id"), F.col("rid").alias("right_id"), F.col("m.dist").alias("dist"))


def inlier_census(candidates: DataFrame, stars: DataFrame, tolerance: float) -> DataFrame:
    """Candidate points (x, y) with any star within the tolerance: a semi-join by cell. Each star is there nine times, which the
    planner's size of its table does not tell, so the stars are never broadcast: both sides are dealt by cell."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    s = stars.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(around).alias("n"))
    s = s.select("sx", "sy", (F.floor(F.col("sx") / tolerance) + F.col("n.i")).alias("cx"), (F.floor(F.col("sy") / tolerance) + F.col("n.j")).alias("cy"))
    c = candidates.withColumn("__cx", F.floor(F.col("x") / tolerance)).withColumn("__cy", F.floor(F.col("y") / tolerance))
    near = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy")) <= tolerance * tolerance
    return c.join(s.hint("merge"), (F.col("__cx") == F.col("cx")) & (F.col("__cy") == F.col("cy")) & near, "left_semi").drop("__cx", "__cy")


def position_dedup(new: DataFrame, old: DataFrame, radius: float, grid: TileGrid = GRID) -> DataFrame:
    """Rows of ``new`` (ra, dec) with no row of ``old`` within ``radius``: an anti-join by tile."""
    o = old.select(F.col("ra").alias("ra0"), F.col("dec").alias("dec0"), F.explode(grid.cover(F.col("ra"), F.col("dec"), radius)).alias("tile0"))
    n = with_tile(new, grid=grid)
    close = separation(F.col("ra"), F.col("dec"), F.col("ra0"), F.col("dec0")) <= radius
    return n.join(o, (F.col("tile") == F.col("tile0")) & close, "left_anti").drop("tile")


def validate_tiles(stars: DataFrame, grid: TileGrid = GRID) -> DataFrame:
    """Counts of violations: coordinates out of range, and within tiles rows fainter than their successor by row order ``ord``."""
    w = Window.partitionBy("tile").orderBy("ord")
    t = with_tile(stars, grid=grid).withColumn("prev", F.lag("mag").over(w))
    return t.agg(
        F.count("*").alias("n"), F.count_if((F.col("ra") < 0) | (F.col("ra") >= 360) | (F.abs("dec") > 90)).alias("out_of_range"),
        F.count_if(F.col("prev") > F.col("mag")).alias("out_of_order"), F.countDistinct("tile").alias("tiles"),
    )


def validate_objects(objects: DataFrame) -> DataFrame:
    """One row per broken rule: rule, n."""
    bad = [
        ("empty_name", F.coalesce(F.trim("name"), F.lit("")) == ""), ("bad_position", F.col("ra").isNull() | F.col("dec").isNull() | (F.abs("dec") > 90)),
        ("negative_size", F.coalesce(F.col("major_arcmin") < 0, F.lit(False))), ("unknown_mag", F.col("mag").isNull()),
    ]
    flat = objects.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in bad]))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    again = objects.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_id").alias("rule"), "n").where("n > 0")
    return flat.union(again)


def write_tiles(stars: DataFrame, path: str, grid: TileGrid = GRID) -> None:
    """The tile sink: files by declination band, rows by tile and magnitude, so scans prune by band, tile and brightness."""
    t = with_tile(stars, grid=grid).withColumn("band", grid.band(F.col("dec")))
    t.repartition("band", F.floor(F.col("tile") / 8)).sortWithinPartitions("band", "tile", "mag").write.partitionBy("band").parquet(path)


def read_tiles(spark, path: str, cone: Cone | None = None, max_mag: float | None = None, grid: TileGrid = GRID) -> DataFrame:
    """Reads a tile sink; a cone prunes bands and tiles, a limit prunes row groups."""
    df = spark.read.parquet(path)
    if max_mag is not None:
        df = df.where(F.col("mag") <= max_mag)
    if cone is not None:
        tiles = grid.cover_literal(cone.ra, cone.dec, cone.radius)
        bands = sorted({max(b for b in range(grid.bands) if grid.offsets[b] <= t) for t in tiles})
        df = df.where(F.col("band").isin(bands) & F.col("tile").isin(tiles)).where(cone.inside(unit_vector("ra", "dec")))
    return df


#: Cell pairs for each point at most, where cells are still made finer, and how often they are made a fourth as wide.
CELL_PAIRS, FINER = 8, 8


def nearest_neighbours(points: DataFrame, keys: list[str], k: int, reach: float) -> DataFrame:
    """The ``k`` nearest points of each point (id, x, y) in its group, within ``reach``: keys, id, near, distance, rank.
    Equal distances go by id.

    Points meet by cells, nine for each anchor. Where cells as wide as the reach hold many points, the search begins with finer
    ones: an anchor with ``k`` points within a cell's width is done, the others go on with cells four times as wide, up to
    the reach. Of points in one place only the first ``k`` + 1 by id can be among an anchor's nearest."""
    place = Window.partitionBy(*keys, "x", "y").orderBy("id")
    near = points.select(*keys, "id", "x", "y").withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= k + 1).drop("__r")
    cell = lambda c, h: F.floor(F.col(c) / (h * (1 + 1e-9)))  # noqa: E731  the margin covers the division's rounding
    widths = [reach / 4**i for i in range(FINER)]
    crowd = near.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), cell("x", h).alias("cx"), cell("y", h).alias("cy")) for i, h in enumerate(widths)])).alias("c"), *keys)
    crowd = crowd.groupBy("c", *keys).agg(F.count("*").alias("n")).groupBy("c.i").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"), F.sum("n").alias("n"))
    fits = [r["i"] for r in crowd.collect() if r["pairs"] <= CELL_PAIRS * r["n"]]  # a row a width
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    d = F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))
    w = Window.partitionBy(*keys, "id").orderBy("distance", "near")
    rest, out = points.select(*keys, "id", "x", "y"), None
    for h in widths[min(fits, default=FINER - 1) :: -1]:
        a = rest.select("*", F.explode(around).alias("n")).select(*keys, "id", "x", "y", (cell("x", h) + F.col("n.i")).alias("cx"), (cell("y", h) + F.col("n.j")).alias("cy"))
        b = near.select(*keys, F.col("id").alias("near"), F.col("x").alias("nx"), F.col("y").alias("ny"), cell("x", h).alias("cx"), cell("y", h).alias("cy"))
        j = a.hint("merge").join(b, [*keys, "cx", "cy"]).where("id <> near").withColumn("distance", d).where(F.col("distance") <= h)
        found = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "id", "near", "distance", "rank")
        if h < reach:
            done = found.where(F.col("rank") == k).select(*keys, "id")
            rest = rest.join(done, [*keys, "id"], "left_anti")
            found = found.join(done, [*keys, "id"], "left_semi")
        out = found if out is None else out.unionByName(found)
    return out
