"""What several corpus operators share: written intermediates, batched Arrow maps, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where ``spark.checkpoint.dir`` is unset in local mode (tests) one is made here."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has already ended; the cluster's own clean-up is left
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back, so a lost executor costs no upstream work."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what ``materialize`` wrote, where nothing will read it again."""
    _remove(df.sparkSession, df.written_at)


def whole_ids(df: DataFrame, column: str) -> Column:
    """An id column as long; components are named by their smallest id, so ids must be whole numbers."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise ValueError(f"{column} must hold whole numbers")
    return F.col(column).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def tidied(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn``, after whose last batch the worker gives freed memory back: workers outlive their tasks and share an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
                    ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node index of each of ``n`` nodes' component under the links ``a[i]``-``b[i]``."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            deeper = label[label]
            if np.array_equal(deeper, label):
                break
            label = deeper
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of a bounded run of batches by a star for each of their components."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def star() -> pa.RecordBatch:
        a = np.concatenate([x.column(0).to_numpy() for x in held])
        b = np.concatenate([x.column(1).to_numpy() for x in held])
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = min_labels(len(nodes), index[: len(a)], index[len(a) :])
        other = label != np.arange(len(nodes))
        return pa.RecordBatch.from_pydict({"a": nodes[label[other]], "b": nodes[other]})

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 2_000_000:
            yield star()
            held, rows = [], 0
    if held:
        yield star()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a long, b long): one row (node long, root long) for each linked node.

    ``root`` is the smallest node of the component. Self links and nulls link nothing; an empty table gives no row.
    Each round contracts what a task holds to stars, then runs the large-star and small-star steps, whose number
    grows with the logarithm of the longest chain. Each round's links are written to the shared folder. A hub with
    many neighbours is never gathered: both steps are a minimum with map-side combining and a join.
    """
    spark = links.sparkSession
    edges = (
        links.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).mapInArrow(_contract, "a long, b long").distinct()
    )
    edges = materialize(edges, "links")
    n = edges.count()
    for _ in range(max_rounds):
        if not n:
            break
        # large star: every larger neighbour of a node goes to the smallest neighbour (or the node itself)
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b")
        large = large.distinct()
        # small star: smaller neighbours and the node itself go to the smallest neighbour
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b")
        new = materialize(small.mapInArrow(_contract, "a long, b long").distinct(), "links")
        stats = new.agg(F.count("*").alias("n"), F.countDistinct("b").alias("d")).first()
        discard(edges)
        roots_below = new.alias("x").join(new.alias("y"), F.col("x.a") == F.col("y.b"), "left_semi").limit(1).count()
        edges, n = new, stats["n"]
        if stats["n"] == stats["d"] and not roots_below:
            break
    else:
        raise RuntimeError("the components did not settle")
    root = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return root.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
