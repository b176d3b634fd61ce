"""Image operators over pixel rows (f, y, x, v): one row a pixel, null where masked. Neighbourhoods are windows along one
axis at a time where the kernel separates, so nothing is gathered but a line of a frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import MAD_SCALE, median_mad

KEYS = ["f"]


def _mad(df: DataFrame, keys: list[str], value: str = "v", prefix: str = "") -> DataFrame:
    m = median_mad(df, keys, value)
    return m.select(*keys, *[F.col(c).alias(prefix + c) for c in ("n", "median", "sigma")])


# --- calibration by pixel


def apply_masters(lights: DataFrame, bias: DataFrame | None = None, dark: DataFrame | None = None, flat: DataFrame | None = None) -> DataFrame:
    """Calibrates lights (f, y, x, v, exposure): less bias, less dark scaled by exposure, over flat.

    Masters: (y, x, v), the dark also with ``exposure``. A flat at or below 1e-6, or masked, masks the pixel. A timed dark
    with a light of unknown exposure is an error the caller sees as null.
    """
    out = lights
    v = F.col("v")
    if bias is not None:
        out = out.join(bias.select("y", "x", F.col("v").alias("__b")), ["y", "x"], "left")
        v = v - F.col("__b")
    if dark is not None:
        out = out.join(dark.select("y", "x", F.col("v").alias("__d"), F.col("exposure").alias("__t")), ["y", "x"], "left")
        v = v - F.col("__d") * F.when(F.col("__t").isNull(), 1.0).otherwise(F.col("exposure") / F.col("__t"))
    if flat is not None:
        out = out.join(flat.select("y", "x", F.col("v").alias("__f")), ["y", "x"], "left")
        v = F.when(F.col("__f") > 1e-6, v / F.col("__f"))
    return out.withColumn("v", v).drop("__b", "__d", "__t", "__f")


def normalize_flat(flat: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A flat over the median of its positive samples, by channel; what is not positive is masked."""
    m = flat.where("v > 0").groupBy(*keys).agg(F.median("v").alias("m"))
    return flat.join(m, keys).withColumn("v", F.when(F.col("v") > 0, F.col("v") / F.col("m"))).drop("m")


def master(frames: DataFrame, low: float = 3.0, high: float = 3.0, by: list[str] | None = None) -> DataFrame:
    """Integrates frames by pixel with a leave-one-out sigma clip: each sample is judged against the mean and deviation of
    the others, in closed form from n, mean and second moment. Where all are rejected the plain mean stands.

    Returns by, y, x, v, n, rejected."""
    keys = [*(by or []), "y", "x"]
    s = frames.where("v is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("m2"))
    j = frames.where("v is not null").join(s, keys)
    other = (F.col("n") * F.col("mean") - F.col("v")) / (F.col("n") - 1)
    m2 = F.greatest(F.col("m2") - (F.col("v") - F.col("mean")) * (F.col("v") - other), F.lit(0.0))
    sigma = F.sqrt(m2 / (F.col("n") - 2))
    residual = F.col("v") - other
    tight = F.abs(residual) > F.greatest(F.abs(other), F.lit(1.0)) * (8 * 2.0**-23)
    bad = F.when(F.col("n") < 3, False).when(sigma <= 2.0**-52, tight).otherwise((residual < sigma * -low) | (residual > sigma * high))
    j = j.withColumn("bad", bad)
    return j.groupBy(*keys).agg(F.coalesce(F.avg(F.when(~F.col("bad"), F.col("v"))), F.first("mean")).alias("v"), F.first("n").alias("n"), F.count_if("bad").alias("rejected"))


def master_tallies(frames: DataFrame, masters: DataFrame, low: float = 3.0, high: float = 3.0) -> DataFrame:
    """Accepted and rejected samples by input frame, judged as ``master`` does."""
    keys = ["y", "x"]
    s = frames.where("v is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("m2"))
    other = (F.col("n") * F.col("mean") - F.col("v")) / (F.col("n") - 1)
    sigma = F.sqrt(F.greatest(F.col("m2") - (F.col("v") - F.col("mean")) * (F.col("v") - other), F.lit(0.0)) / (F.col("n") - 2))
    bad = F.when(F.col("n") < 3, False).otherwise((F.col("v") - other < sigma * -low) | (F.col("v") - other > sigma * high))
    return frames.where("v is not null").join(s, keys).groupBy("f").agg(F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"))


def suppress_impulses(frames: DataFrame, step: int = 1, sigma: float = 16.0) -> DataFrame:
    """Replaces samples farther than ``sigma`` local deviations from the median of their eight neighbours (``step`` 2: of the
    same colour plane), five neighbours at least; originals only are read."""
    n = neighbours(frames, [(dy * step, dx * step) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    s = F.array_sort(F.array_compact(F.col("near")))
    mid = lambda a: (a[F.floor((F.size(a) - 1) / 2).cast("int")] + a[F.floor(F.size(a) / 2).cast("int")]) / 2.0
    n = n.withColumn("s", s).withColumn("m", F.when(F.size("s") > 0, mid(F.col("s"))))
    n = n.withColumn("d", F.array_sort(F.transform("s", lambda x: F.abs(x - F.col("m"))))).withColumn("dev", F.greatest(F.when(F.size("d") > 0, mid(F.col("d"))) * MAD_SCALE, F.lit(1.2e-38)))
    hit = (F.size("s") >= 5) & (F.abs(F.col("v") - F.col("m")) > F.col("dev") * sigma)
    return n.withColumn("v", F.when(hit, F.col("m")).otherwise(F.col("v"))).drop("near", "s", "m", "d", "dev")


# --- neighbourhoods


def rows_of(frames: DataFrame, value: str = "v") -> DataFrame:
    """One array a line: f, y, line (in x order)."""
    return frames.groupBy("f", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("v")))), lambda s: s["v"]).alias("line"))


def neighbours(frames: DataFrame, offsets: list[tuple[int, int]], border: str | None = None) -> DataFrame:
    """Adds ``near``: the samples at the given (dy, dx), null outside the frame (``border`` replicate: the edge's). Lines of a
    frame meet by window, so a pixel is never exploded."""
    lines = rows_of(frames)
    w = Window.partitionBy("f").orderBy("y")
    ys = sorted({dy for dy, _ in offsets})
    for dy in ys:
        moved = F.col("line") if dy == 0 else F.lead("line", dy).over(w) if dy > 0 else F.lag("line", -dy).over(w)
        lines = lines.withColumn(f"l{dy + 100}", moved)
    if border:
        for dy in sorted(ys, key=abs):
            nearer = f"l{dy + 100 + (1 if dy < 0 else -1)}" if dy else "line"
            lines = lines.withColumn(f"l{dy + 100}", F.coalesce(f"l{dy + 100}", nearer if nearer in lines.columns else "line"))
    at = lambda i: F.least(F.greatest(i, F.lit(0)), F.size("line") - 1) if border else i

    def take(dy: int, dx: int, i: Column) -> Column:
        j = at(i + dx)
        inside = (j >= 0) & (j < F.size("line"))
        return F.when(inside, F.get(F.col(f"l{dy + 100}"), j))

    near = F.transform(F.sequence(F.lit(0), F.size("line") - 1), lambda i: F.struct(i.alias("x"), F.get("line", i).alias("v"), F.array(*[take(dy, dx, i) for dy, dx in offsets]).alias("near")))
    return lines.select("f", "y", F.explode(near).alias("p")).select("f", "y", F.col("p.x").cast("int").alias("x"), "p.v", "p.near")


def square(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def element(shape: str, size: int) -> list[tuple[int, int]]:
    """Structuring elements: rect, cross, ellipse."""
    r = size // 2
    if shape == "rect":
        return square(r)
    if shape == "cross":
        return [(d, 0) for d in range(-r, r + 1)] + [(0, d) for d in range(-r, r + 1) if d]
    out = []
    for dy in range(-r, r + 1):
        half = round(r * math.sqrt(max(0.0, r * r - dy * dy)) / r) if r else 0
        out += [(dy, dx) for dx in range(-half, half + 1)]
    return out


def erode(frames: DataFrame, size: int = 3, shape: str = "rect") -> DataFrame:
    n = neighbours(frames, element(shape, size))
    return n.select("f", "y", "x", F.array_min("near").alias("v"))


def dilate(frames: DataFrame, size: int = 3, shape: str = "rect") -> DataFrame:
    n = neighbours(frames, element(shape, size))
    return n.select("f", "y", "x", F.array_max("near").alias("v"))


def median3(frames: DataFrame) -> DataFrame:
    n = neighbours(frames, square(1), "replicate")
    return n.select("f", "y", "x", F.array_sort("near")[4].alias("v"))


def gaussian_kernel(sigma: float, size: int) -> list[float]:
    r = size // 2
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [x / sum(k) for x in k]


def auto_size(sigma: float, eight_bit: bool) -> int:
    return int(round(sigma * (3 if eight_bit else 4) * 2 + 1)) | 1


def kernel_q8(kernel: list[float]) -> list[int]:
    """Fixed-point taps: differences of the running sum, rounded half to even; they add to 256."""
    out, total, last = [], 0.0, 0
    for k in kernel:
        total += k * 256
        out.append(max(0, round(total) - last))
        last = round(total)
    return out


def _reflect101(i: Column, n: Column) -> Column:
    period = F.greatest((n - 1) * 2, F.lit(1))
    m = F.pmod(i, period)
    return F.when(m < n, m).otherwise(period - m)


def _along_lines(frames: DataFrame, taps: list, add: Column, first: str, second: str) -> DataFrame:
    """Convolves along ``second`` within each line of ``first``; mirrored borders."""
    r = len(taps) // 2
    lines = frames.groupBy("f", first).agg(F.transform(F.array_sort(F.collect_list(F.struct(second, "v"))), lambda s: s["v"]).alias("line"))
    size = F.size("line")

    def at(i: Column) -> Column:
        total = add
        for k, tap in enumerate(taps):
            total = total + F.get("line", _reflect101(i + (k - r), size).cast("int")) * tap
        return F.struct(i.alias(second), total.alias("v"))

    return lines.select("f", first, F.explode(F.transform(F.sequence(F.lit(0), size - 1), at)).alias("p")).select("f", first, F.col(f"p.{second}").cast("int").alias(second), "p.v")


def gaussian_u8(frames: DataFrame, sigma: float, size: int = 0) -> DataFrame:
    """Blur of 8-bit samples in fixed point: Q8 taps along both axes, one rounding (half up) at the end."""
    taps = kernel_q8(gaussian_kernel(sigma, size or auto_size(sigma, True)))
    g = _along_lines(frames, taps, F.lit(0).cast("long"), "y", "x")
    g = _along_lines(g, taps, F.lit(0).cast("long"), "x", "y")
    return g.select("f", "y", "x", F.least(F.floor((F.col("v") + 32768) / 65536), F.lit(255)).cast("int").alias("v"))


def gaussian(frames: DataFrame, sigma: float, size: int = 0) -> DataFrame:
    taps = gaussian_kernel(sigma, size or auto_size(sigma, False))
    g = _along_lines(frames, taps, F.lit(0.0), "y", "x")
    return _along_lines(g, taps, F.lit(0.0), "x", "y").select("f", "y", "x", "v")


def atrous(frames: DataFrame, level: int) -> DataFrame:
    """One smoothing by the B3 spline with holes of 2^level."""
    gap = 2**level
    taps = [0.0] * (4 * gap + 1)
    for k, t in enumerate((1 / 16, 1 / 4, 3 / 8, 1 / 4, 1 / 16)):
        taps[k * gap] = t
    g = _along_lines(frames, taps, F.lit(0.0), "y", "x")
    return _along_lines(g, taps, F.lit(0.0), "x", "y").select("f", "y", "x", "v")


def structure_removal(frames: DataFrame, levels: int) -> DataFrame:
    """What is left of an image once ``levels`` layers of structure are smoothed away, and the residual: v, residual."""
    out = frames.select("f", "y", "x", "v")
    for level in range(levels):
        out = atrous(out, level)
    return frames.select("f", "y", "x", F.col("v").alias("raw")).join(out, ["f", "y", "x"]).select("f", "y", "x", "v", (F.col("raw") - F.col("v")).alias("residual"))


def channel_at(y: Column, x: Column, pattern: str = "RGGB", dy: int = 0, dx: int = 0) -> Column:
    """The colour (0, 1, 2) of a mosaic's pixel."""
    index = ((y + dy) % 2) * 2 + (x + dx) % 2
    return F.array(*[F.lit("RGB".index(c)) for c in pattern])[index.cast("int")]


def debayer(frames: DataFrame, pattern: str = "RGGB", dy: int = 0, dx: int = 0, integer: bool = False) -> DataFrame:
    """Bilinear: each colour is the mean of its samples among the nine around; a pixel's own sample stays. Columns r, g, b."""
    n = neighbours(frames, square(1))
    sums = []
    for c in range(3):
        terms = [F.when(channel_at(F.col("y") + oy, F.col("x") + ox, pattern, dy + 2, dx + 2) == c, F.col("near")[k]) for k, (oy, ox) in enumerate(square(1))]
        samples = F.array_compact(F.array(*terms))
        total = F.aggregate(samples, F.lit(0.0), lambda s, v: s + v)
        mean = total / F.size(samples)
        mean = F.floor(mean).cast("double") if integer else mean
        sums.append(F.when(channel_at(F.col("y"), F.col("x"), pattern, dy, dx) == c, F.col("v").cast("double")).otherwise(mean).alias("rgb"[c]))
    return n.select("f", "y", "x", *sums)


def luma(kind: str = "rec709") -> Column:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return {"rec709": r * 0.2126 + g * 0.7152 + b * 0.0722, "bayer": (r + g * 2.0 + b) / 4.0, "mean": (r + g + b) / 3.0}[kind]


def sobel(frames: DataFrame) -> DataFrame:
    """Gradients and their L1 magnitude, edges replicated."""
    n = neighbours(frames, square(1), "replicate")
    p = [F.col("near")[i] for i in range(9)]
    gx = (p[2] + p[5] * 2 + p[8]) - (p[0] + p[3] * 2 + p[6])
    gy = (p[6] + p[7] * 2 + p[8]) - (p[0] + p[1] * 2 + p[2])
    return n.select("f", "y", "x", gx.alias("gx"), gy.alias("gy"), (F.abs(gx) + F.abs(gy)).alias("magnitude"))


# --- statistics over frames


def threshold_excess(frames: DataFrame, tile: int = 64, sigma: float = 4.0, floor: float = 1e-6) -> DataFrame:
    """v less its tile's median where that exceeds ``sigma`` deviations, else 0."""
    t = frames.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    m = _mad(t, ["f", "ty", "tx"])
    e = F.col("v") - F.col("median")
    return t.join(m, ["f", "ty", "tx"]).select("f", "y", "x", F.when(e > F.greatest(F.col("sigma"), F.lit(floor)) * sigma, e).otherwise(0.0).alias("excess"))


def global_normalization(source: DataFrame, reference: DataFrame, least: int = 32) -> DataFrame:
    """Gain and offset that give each frame of ``source`` (f, y, x, v) the median and deviation of ``reference`` (y, x, v)."""
    both = source.join(reference.select("y", "x", F.col("v").alias("r")), ["y", "x"]).where("v is not null and r is not null")
    a, b = _mad(both, ["f"], "v", "s_"), _mad(both, ["f"], "r", "r_")
    gain = F.col("r_sigma") / F.col("s_sigma")
    out = a.join(b, "f").where((F.col("s_n") >= least) & (F.col("s_sigma") > 0))
    return out.select("f", gain.alias("gain"), (F.col("r_median") - gain * F.col("s_median")).alias("offset"))


def local_normalization(source: DataFrame, reference: DataFrame, tile: int, least: int = 32) -> DataFrame:
    """As the global form by tile, applied with gain and offset interpolated between tile centres: f, y, x, v."""
    both = source.join(reference.select("y", "x", F.col("v").alias("r")), ["y", "x"]).where("v is not null and r is not null")
    both = both.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    k = ["f", "ty", "tx"]
    m = _mad(both, k, "v", "s_").join(_mad(both, k, "r", "r_"), k).where((F.col("s_n") >= least) & (F.col("s_sigma") > 0))
    m = m.withColumn("gain", F.col("r_sigma") / F.col("s_sigma")).select("f", "ty", "tx", "gain", (F.col("r_median") - F.col("gain") * F.col("s_median")).alias("offset"))
    # the tiles of a frame as one array, line by line: each pixel reads its four corners in place
    size = m.groupBy("f").agg(F.max("ty").alias("my"), F.max("tx").alias("mx"), F.map_from_entries(F.collect_list(F.struct(F.struct("ty", "tx"), F.struct("gain", "offset")))).alias("tiles"))
    at = lambda i: F.struct(F.floor(i / (F.col("mx") + 1)).alias("ty"), (i % (F.col("mx") + 1)).alias("tx"))
    size = size.select("f", "my", "mx", F.transform(F.sequence(F.lit(0).cast("long"), (F.col("my") + 1) * (F.col("mx") + 1) - 1), lambda i: F.try_element_at("tiles", at(i))).alias("grid"))
    p = source.join(size, "f")
    fy = F.least(F.greatest((F.col("y") + 0.5) / tile - 0.5, F.lit(0.0)), F.col("my").cast("double"))
    fx = F.least(F.greatest((F.col("x") + 0.5) / tile - 0.5, F.lit(0.0)), F.col("mx").cast("double"))
    p = p.select("f", "y", "x", "v", "my", "mx", "grid", fy.alias("fy"), fx.alias("fx"))
    gain, offset, known = F.lit(0.0), F.lit(0.0), F.lit(False)
    for i in (0, 1):
        for j in (0, 1):
            wy, wx = (c - F.floor(c) if k else F.lit(1.0) - (c - F.floor(c)) for c, k in ((F.col("fy"), i), (F.col("fx"), j)))
            place = F.least(F.floor("fy") + i, F.col("my")) * (F.col("mx") + 1) + F.least(F.floor("fx") + j, F.col("mx"))
            corner = F.get(F.col("grid"), place.cast("int"))
            gain, offset, known = gain + F.coalesce(wy * wx * corner["gain"], F.lit(0.0)), offset + F.coalesce(wy * wx * corner["offset"], F.lit(0.0)), known | corner.isNotNull()
    return p.where(known).select("f", "y", "x", (F.col("v") * gain + offset).alias("v"))


def second_difference_noise(frames: DataFrame) -> DataFrame:
    """Noise from second differences (the larger of the two axes), background, and signal of the brightest hundredth."""
    inner = frames.join(frames.groupBy("f").agg(F.max("y").alias("my"), F.max("x").alias("mx")), "f")

    def axis(along: str, across: str) -> DataFrame:
        w = Window.partitionBy("f", across).orderBy(along)
        d = inner.withColumn("d", F.lag("v").over(w) - F.col("v") * 2.0 + F.lead("v").over(w))
        d = d.where((F.col("y") > 0) & (F.col("x") > 0) & (F.col("y") < F.col("my")) & (F.col("x") < F.col("mx")) & F.col("d").isNotNull())
        return _mad(d, ["f"], "d", along + "_")

    return axis("x", "y").join(axis("y", "x"), "f").select("f", (F.greatest("x_sigma", "y_sigma") / math.sqrt(6.0)).alias("noise"))


def depth_snr(frames: DataFrame) -> DataFrame:
    inner = frames.join(frames.groupBy("f").agg(F.max("y").alias("my"), F.max("x").alias("mx")), "f").where("y > 0 and x > 0 and y < my and x < mx and v is not null")
    s = inner.groupBy("f").agg(F.array_sort(F.collect_list("v")).alias("s"), F.median("v").alias("background"))
    cut = F.least((F.size("s") * 0.99).cast("int"), F.size("s") - 1)
    top = F.slice("s", cut + 1, F.size("s"))
    s = s.select("f", "background", (F.aggregate(top, F.lit(0.0), lambda a, b: a + b) / F.size(top) - F.col("background")).alias("signal"))
    return second_difference_noise(frames).join(s, "f")


def coverage(frames: DataFrame) -> DataFrame:
    """Per frame the box of unmasked pixels and their number, and whether the box's centre lies off the consensus."""
    b = frames.where("v is not null").groupBy("f").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"))
    return b


def crop(frames: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    inside = (F.col("y") >= y0) & (F.col("y") < y0 + height) & (F.col("x") >= x0) & (F.col("x") < x0 + width)
    return frames.where(inside).withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)


def components(mask: DataFrame, eight: bool = True) -> DataFrame:
    """Labels of connected components of mask rows (f, y, x), numbered by their first pixel. A frame meets in one task, where
    each line's runs are linked with the runs they touch in the line before and settle by the smallest label with pointer
    jumping, all as arrays over runs."""
    import pandas as pd

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        order = np.lexsort((x, y))
        y, x = y[order], x[order]
        first = np.flatnonzero(np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)]))
        last = np.append(first[1:], len(y)) - 1
        touch, width = int(eight), int(x.max() - x.min()) + 4
        line, left, right = y[first], x[first] - x.min(), x[last] - x.min()
        lo = np.searchsorted(line * width + right, (line - 1) * width + np.maximum(left - touch, 0))
        hi = np.searchsorted(line * width + left, (line - 1) * width + right + touch, "right")
        count = np.maximum(hi - lo, 0)
        a = np.repeat(np.arange(len(first)), count)
        b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        root = np.arange(len(first))
        while len(a):
            p, q = root[a], root[b]
            apart = p != q
            if not apart.any():
                break
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (root[root] != root).any():
                root = root[root]
        _, number = np.unique(root, return_inverse=True)
        out = pd.DataFrame({"f": pdf["f"].iloc[0], "y": y, "x": x, "component": np.repeat(number, last - first + 1)})
        return out.astype({"y": "int32", "x": "int32", "component": "int32"})

    return mask.select("f", "y", "x").groupBy("f").applyInPandas(label, "f long, y int, x int, component int")


def component_stats(labelled: DataFrame) -> DataFrame:
    """Box, area, flux centroid, elongation and fill by component of labelled rows (f, y, x, component, v)."""
    w, x, y = F.col("v"), F.col("x"), F.col("y")
    s = labelled.groupBy("f", "component").agg(
        F.count("*").alias("area"), F.sum(w).alias("flux"), F.max(w).alias("peak"), (F.sum(w * x) / F.sum(w)).alias("cx"), (F.sum(w * y) / F.sum(w)).alias("cy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"),
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"),
    )
    a, c = F.col("sxx") / F.col("flux") - F.col("cx") * F.col("cx"), F.col("syy") / F.col("flux") - F.col("cy") * F.col("cy")
    b = F.col("sxy") / F.col("flux") - F.col("cx") * F.col("cy")
    root = F.sqrt(F.greatest((a - c) * (a - c) / 4.0 + b * b, F.lit(0.0)))
    major, minor = (a + c) / 2.0 + root, F.greatest((a + c) / 2.0 - root, F.lit(1.0 / 12))
    fill = F.col("area") / ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1))
    return s.select("f", "component", "area", "flux", "peak", "cx", "cy", "x0", "x1", "y0", "y1", F.sqrt(F.greatest(major, F.lit(1.0 / 12)) / minor).alias("elongation"), fill.alias("fill"))


def detect(frames: DataFrame, tile: int = 64, sigma: float = 4.0, area: tuple[int, int] = (3, 20_000), elongation: float = 2.5, most: int = 500) -> DataFrame:
    """Stars by frame: excess over the tiles' background, components, gates on area and shape, by falling flux."""
    e = threshold_excess(frames, tile, sigma).where("excess > 0").withColumnRenamed("excess", "v")
    labelled = components(e).join(e, ["f", "y", "x"])
    s = component_stats(labelled).where(F.col("area").between(*area) & (F.col("elongation") <= elongation))
    w = Window.partitionBy("f").orderBy(F.desc("flux"), "component")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("f", "rank", F.col("cx").alias("x"), F.col("cy").alias("y"), "flux", "peak", "area")


def crop_report(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Coverage by channel (f), its offset from the consensus centre, and whether it is off centre (three channels at least)."""
    b = coverage(frames).withColumn("cx", (F.col("x0") + F.col("x1")) / 2.0).withColumn("cy", (F.col("y0") + F.col("y1")) / 2.0)
    c = b.agg(F.median("cx").alias("mx"), F.median("cy").alias("my"), F.count("*").alias("channels"))
    limit = max(32.0, 0.02 * max(width, height))
    j = b.crossJoin(F.broadcast(c))  # one row
    dx, dy = F.col("cx") - F.col("mx"), F.col("cy") - F.col("my")
    return j.select("f", "n", "x0", "x1", "y0", "y1", dx.alias("dx"), dy.alias("dy"), ((F.col("channels") >= 3) & (F.sqrt(dx * dx + dy * dy) > limit)).alias("off_center"))


def protected(frames: DataFrame, ellipse: tuple[float, float, float, float, float] | None = None, polygon: list[tuple[float, float]] | None = None, padding: float = 0.0) -> DataFrame:
    """Marks pixels inside a region (centre x and y, semi axes, angle in degrees; or corners), grown by a padding."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    inside = F.lit(False)
    if ellipse:
        cx, cy, a, b, angle = ellipse
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        u, v = ((x - cx) * c + (y - cy) * s) / (a + padding), ((y - cy) * c - (x - cx) * s) / (b + padding)
        inside = u * u + v * v <= 1
    if polygon:
        odd, near = F.lit(False), F.lit(float("inf"))
        for (x0, y0), (x1, y1) in zip(polygon, [*polygon[1:], polygon[0]]):
            if y0 != y1:
                crosses = ((y > y0) != (y > y1)) & (x < (y - y0) * ((x1 - x0) / (y1 - y0)) + x0)
                odd = odd != crosses
            size = (x1 - x0) ** 2 + (y1 - y0) ** 2
            t = F.greatest(F.least(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / max(size, 1e-12), F.lit(1.0)), F.lit(0.0))
            dx, dy = x - (t * (x1 - x0) + x0), y - (t * (y1 - y0) + y0)
            near = F.least(near, F.sqrt(dx * dx + dy * dy))
        inside = inside | odd | (near <= padding if padding else F.lit(False))
    return frames.withColumn("protected", inside)


def stretch(images: DataFrame, strategy: str = "linked", target: float = 0.2, clip: float = -2.8) -> DataFrame:
    """Analyse, resolve, apply: images (f, y, x, c, v) through automatic midtone curves, one for all channels (``linked``), one for
    each (``unlinked``), or one of the luminance with colours scaled to it (``luminance``). Masked samples become 0."""
    from ..functions.curves import auto_mtf, mtf_curve, unit
    from .stats import robust_distribution

    keys = ["f", "c"] if strategy == "unlinked" else ["f"]
    base = images
    if strategy == "luminance":
        base = images.groupBy("f", "y", "x").agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(n) for i, n in enumerate("rgb")]).withColumn("v", luma("rec709"))
    curve = robust_distribution(base, keys).select(*keys, auto_mtf(F.col("median"), F.col("mad"), target, clip).alias("k"))

    def mapped(v: Column) -> Column:
        return F.when(F.col("k.identity"), unit(v)).otherwise(mtf_curve(v, F.col("k.shadows"), F.col("k.midtone"), F.col("k.highlights")))

    if strategy != "luminance":
        return images.join(curve, keys).select("f", "y", "x", "c", F.coalesce(mapped(F.col("v")), F.lit(0.0)).alias("v"))
    p = base.join(curve, "f").withColumn("to", mapped(F.col("v")))
    scale = F.least(F.col("to") / F.col("v"), F.lit(1.0) / F.greatest("r", "g", "b"))
    out = [F.when(F.col("v") > 1e-8, unit(F.col(n) * scale)).otherwise(F.col("to")) for n in "rgb"]
    whole = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    e = p.select("f", "y", "x", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.when(whole, o).otherwise(0.0).alias("v")) for i, o in enumerate(out)])).alias("s"))
    return e.select("f", "y", "x", "s.c", "s.v")


def response_violations(response: DataFrame) -> DataFrame:
    """One row: samples of a residual response that are not in (0, 1]."""
    good = F.coalesce((F.col("v") > 0) & (F.col("v") <= 1), F.lit(False))
    return response.agg(F.count_if(~good).alias("bad"))


def apply_response(frames: DataFrame, response: DataFrame, x: int = 0, y: int = 0) -> DataFrame:
    """Divides a residual response (y, x, v, all in (0, 1]) out of frames, its corner at the given place; pixels beside it stay."""
    r = response.select((F.col("y") + y).alias("y"), (F.col("x") + x).alias("x"), F.col("v").alias("r"))
    return frames.join(r, ["y", "x"], "left").withColumn("v", F.when(F.col("r").isNotNull(), F.col("v") / F.col("r")).otherwise(F.col("v"))).drop("r")


def channel_diagnostics(before: DataFrame, after: DataFrame, keys: list[str] = ["f"]) -> DataFrame:
    """Flux and peak of a channel before and after restoration; samples that are not finite do not count."""

    def measured(df: DataFrame, name: str) -> DataFrame:
        finite = df.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
        return finite.groupBy(*keys).agg(F.sum("v").alias(f"{name}_flux"), F.max("v").alias(f"{name}_peak"))

    return measured(before, "input").join(measured(after, "output"), keys, "full")
