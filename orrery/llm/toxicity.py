"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: which of its words, pairs of neighbours, pairs with one word between and stems (the first ``STEMS``
bytes of longer words, so that forms never learnt share what their stem says) occur, each hashed to one of ``BUCKETS``
places. Training goes through the sample once per epoch in a fixed order, with a learning rate of its own
for every coordinate and L1 shrinkage, so that few weights differ from zero; those are broadcast
(``BUCKETS`` at most). Scoring reads each whole text once.

The sample: labelled texts, ``SAMPLE`` at most, those with the least hash of their doc_id. That is the only bound.

Defined results: a null, empty or wordless text scores by the bias alone; null labels teach nothing; a document that
has labels 0 and 1 counts as 1; repeated rows are scored alike; without labelled texts every score is just below 0.5,
predicted 0; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

BITS = 20
BUCKETS = 1 << BITS
SAMPLE = 16_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 5.0, 0.05, 6
STEMS = (4, 5, 6, 7, 8)
_word = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def features(text: str | None) -> np.ndarray:
    """Sorted places of the features of a whole text."""
    words = _word((text or "").lower().encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(crc32, words), np.uint64)
    distinct = set(words)
    one, two, skip = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    stems = [np.fromiter(map(crc32, {w[:n] for w in distinct if len(w) > n}), np.uint64) * two + np.uint64(n) for n in STEMS]
    grams = np.concatenate([h * one, h[:-1] * two + h[1:] * one, h[:-2] * skip + h[2:] * one, *stems])
    grams ^= grams >> np.uint64(29)
    return np.unique((grams * one >> np.uint64(64 - BITS)).astype(np.int32))


class Ftrl:
    """FTRL-proximal: z and n for every coordinate; weights are read off when needed. The last place is the bias."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, BUCKETS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The places and values of the weights that are not zero, learnt from ``labels`` (doc_id, label) and ``docs``."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(F.col(doc_id).cast("string"))
    chosen = known.select(F.col(doc_id).alias("i"), "y", order.alias("o")).orderBy("o", "i").limit(sample)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i").select("o", "y", "t")  # ``sample`` rows at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], names=["o", "y", "f"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(y, np.frombuffer(f, np.int32)) for b in batches for y, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        model = Ftrl()
        for _ in range(EPOCHS):
            for y, f in seen:
                model.learn(f, y)
        w = model.weights(np.arange(BUCKETS + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "w": w[at]})

    found = rows.mapInArrow(tidied(extract), "o long, y int, f binary").repartition(1).sortWithinPartitions("o", "y", "f").mapInArrow(tidied(fit), "at int, w double").toArrow()
    return found.column("at").to_numpy(), found.column("w").to_numpy()


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score double, predicted int for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = shared.value
        w = np.zeros(BUCKETS + 1)
        w[at] = values
        for batch in batches:
            margin = np.array([w[features(t)].sum() for t in batch.column(1).to_pylist()], np.float64) + w[BUCKETS] - 1e-12
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -700, 700))))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)[doc_id]
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(tidied(run), f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
