"""Near-duplicate vectors by an epsilon grid order join.

Vectors of unit length at cosine c lie sqrt(2 - 2c) apart. They are turned to their principal axes (the covariance is
summed over all rows), which keeps distances, and ordered by label and by the grid cells, ``eps`` wide, of their
``LEAD`` leading coordinates. The ordered sequence is cut into intervals of ``BLOCK`` vectors. Two intervals meet only
if the boxes of their leading coordinates come within ``eps``; a pair that meets is halved again and again, skipping
halves that are provably distant, down to small blocks whose cosines are computed outright, in double precision.

Equal vectors travel as one with a weight. Intervals give link counts by vector and the links of a spanning forest,
never all pairs; counts are complete.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, and one whose label is
null, links with nothing; vectors of different lengths do not link; repeated rows link with each other; a repeated
vec_id counts its rows as one vector each and shares the result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, min_labels, tidied, whole_ids

COSINE, LEAD, BLOCK, LEAF = 0.93, 6, 1024, 64
#: Longest vector whose covariance is summed (its square goes to the driver); longer ones keep their given axes.
AXES = 1024
#: Different lengths of vectors whose axes are computed, a pass and a table each; with more, all keep their given axes.
LENGTHS = 16
_SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal axes by falling variance of all unit vectors of ``dim`` components (``vectors.v``)."""
    if dim > AXES:
        return np.eye(dim)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                total += x.T @ x
                mean += x.sum(0)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(dim + 1), "row": [*total.tolist(), mean.tolist()], "n": np.full(dim + 1, n)})

    parts = vectors.select("v").mapInArrow(tidied(sums), "i long, row array<double>, n long")
    flat = parts.select("i", "n", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
    if not flat.num_rows:
        return np.eye(dim)
    table = np.zeros((dim + 1, dim))
    table[flat.column("i").to_numpy(), flat.column("j").to_numpy()] = flat.column("x").to_numpy()
    n = flat.column("n").to_numpy()[0]
    mean = table[dim] / n
    _, axes = np.linalg.eigh(table[:dim] / n - np.outer(mean, mean))
    return axes[:, ::-1].copy()


def _count(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray, eps: float, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Weighted link counts of the rows of ``x`` and of ``y``, and the links found, by recursive halving."""
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, len(x), 0, len(y))]
    lead = min(LEAD, x.shape[1])
    while stack:
        a, b, c, d = stack.pop()
        if same and (a, b) > (c, d):
            continue
        p, q = x[a:b, :lead], y[c:d, :lead]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if gap @ gap > eps * eps:
            continue
        if max(b - a, d - c) > LEAF:
            m, o = (a + b + 1) // 2, (c + d + 1) // 2
            stack += [(s, e, u, v) for s, e in ((a, m), (m, b)) for u, v in ((c, o), (o, d)) if e > s and v > u]
            continue
        near = x[a:b] @ y[c:d].T >= cosine
        if same and (a, b) == (c, d):
            np.fill_diagonal(near, False)
            nx[a:b] += near @ wy[c:d]
            near = np.triu(near)
        else:
            nx[a:b] += near @ wy[c:d]
            ny[c:d] += wx[a:b] @ near
        i, j = np.nonzero(near)
        if len(i):
            found.append((i + a, j + c))
    return nx, ny, found


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = min_labels(n, i, j)
    other = np.flatnonzero(label != np.arange(n))
    return label[other], other


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept, for every row."""
    eps = float(np.sqrt(2 - 2 * cosine)) + _SLACK
    rows = vectors.select(whole_ids(vectors, vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    # -0.0 and 0.0 are one component; so equal vectors have one hash and one group
    rows = rows.withColumn("v", F.when(F.coalesce(usable, F.lit(False)), F.transform("v", lambda c: c + F.lit(0.0))))
    groups = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    groups = materialize(groups.withColumn("g", F.xxhash64("label", "v")), "vectors")
    dims = [r[0] for r in groups.select(F.size("v")).distinct().limit(LENGTHS + 1).collect()]
    axes = {dim: principal_axes(groups.where(F.size("v") == dim), dim) for dim in dims} if len(dims) <= LENGTHS else {}
    # vectors of different lengths never meet: the length is a part of what must be equal
    counted = materialize(_join(groups.withColumn("label", F.concat_ws(":", F.size("v").cast("string"), "label")), axes, eps, cosine), "links")
    found = components(counted.where("other is not null").select(F.col("g").alias("a"), F.col("other").alias("b")))
    n = counted.groupBy("g").agg(F.sum("n").alias("n"))
    table = groups.select("label", "v", "g", "rep", "w").join(n, "g", "left").join(found, F.col("g") == F.col("node"), "left").withColumn("root", F.coalesce("root", "g"))
    table = materialize(table.select("label", "v", "g", "rep", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "root"), "groups")
    name = table.groupBy("root").agg(F.min("rep").alias("component_id"))
    table = table.join(name, "root").select("g", "n_links", "component_id")
    keyed = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")).alias("g"))
    out = keyed.join(table, "g", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _leading(y: np.ndarray) -> np.ndarray:
    """The ``LEAD`` leading coordinates; shorter vectors are filled up with zeros."""
    return np.pad(y[:, :LEAD], ((0, 0), (0, max(0, LEAD - y.shape[1]))))


def _join(groups: DataFrame, axes: dict[int, np.ndarray], eps: float, cosine: float) -> DataFrame:
    """(g long, n long, other long): weighted link counts by vector, and links enough to connect what links. Vectors of one
    label have one length; ``axes`` by length, missing ones stay as given."""
    spark = groups.sparkSession
    turns = spark.sparkContext.broadcast(axes)
    lead = LEAD

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, dim in ((b, d) for b in batches for d in pc.unique(pc.list_value_length(b.column(3))).to_pylist()):
            batch = whole.filter(pc.equal(pc.list_value_length(whole.column(3)), dim))
            x = _matrix(batch.column(3))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            y = x @ turns.value[dim] if dim in turns.value else x
            cells = np.floor(_leading(y) / eps).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"label": batch.column(0), "g": batch.column(1), "w": batch.column(2), "x": [r.tobytes() for r in y], "cell": cells.tolist()})

    placed = groups.select("label", "g", "w", "v").mapInArrow(tidied(place), "label string, g long, w long, x binary, cell array<long>")
    order = [F.col("label"), *[F.col("cell")[i] for i in range(lead)], F.col("g")]

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            label, g, w, x = zip(*held)
            y = _leading(np.frombuffer(b"".join(x)).reshape(len(x), -1))
            return pa.RecordBatch.from_pydict({"label": [label[0]], "id": [g[0]], "g": [list(g)], "w": [list(w)], "x": [b"".join(x)], "lo": [y.min(0).tolist()], "hi": [y.max(0).tolist()]})

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (len(held) == BLOCK or held[0][0] != row[0]):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    blocks = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("label", "g", "w", "x")
    blocks = materialize(blocks.mapInArrow(tidied(intervals), "label string, id long, g array<long>, w array<long>, x binary, lo array<double>, hi array<double>"), "intervals")
    # intervals that may come within eps: those sharing a strip of the first axis, then a test of the whole boxes
    box = blocks.select("label", "id", "lo", "hi")
    strip = lambda c: F.floor(c / eps).cast("long")
    a = box.select("label", F.col("id").alias("p"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.explode(F.sequence(strip(F.col("lo")[0]), strip(F.col("hi")[0]))).alias("s"))
    b = box.select("label", F.col("id").alias("q"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi"), F.explode(F.sequence(strip(F.col("lo")[0]) - 1, strip(F.col("hi")[0]) + 1)).alias("s"))
    gap = F.lit(0.0)
    for i in range(lead):
        d = F.greatest(F.col("plo")[i] - F.col("qhi")[i], F.col("qlo")[i] - F.col("phi")[i], F.lit(0.0))
        gap = gap + d * d
    pairs = a.join(b, ["label", "s"]).where((F.col("p") <= F.col("q")) & (gap <= eps * eps)).select("p", "q").distinct()
    left = blocks.select(F.col("id").alias("p"), F.col("g").alias("pg"), F.col("w").alias("pw"), F.col("x").alias("px"))
    right = blocks.select(F.col("id").alias("q"), F.col("g").alias("qg"), F.col("w").alias("qw"), F.col("x").alias("qx"))
    met = pairs.join(left, "p").join(right, "q").repartition("p", "q").select("p", "q", "pg", "pw", "px", "qg", "qw", "qx")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p, q, pg, pw, px, qg, qw, qx = (batch.column(i)[k].as_py() for i in range(8))
                x, y = np.frombuffer(px).reshape(len(pg), -1), np.frombuffer(qx).reshape(len(qg), -1)
                nx, ny, found = _count(x, y, np.array(pw), np.array(qw), eps, cosine, p == q)
                g = np.array(pg if p == q else pg + qg)
                n = nx + ny if p == q else np.concatenate([nx, ny])
                if not n.any():
                    continue
                i = np.concatenate([f[0] for f in found])
                j = np.concatenate([f[1] for f in found]) + (0 if p == q else len(pg))
                root, other = _forest(len(g), i, j)
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"g": pa.array(np.concatenate([g[hit], g[root]])), "n": pa.array(np.concatenate([n[hit], np.zeros(len(root), np.int64)])), "other": pa.array(np.concatenate([g[hit], g[other]]))})

    return met.mapInArrow(tidied(meet), "g long, n long, other long")
