"""Near-duplicate groups by SimHash fingerprints, joined with themselves in binary tries.

Fingerprint: A-Z lower-cased, words split at ASCII white space, shingles of four words with repeats (fewer words: the
whole sequence), XXH64 with seed 42 of each; a bit is 1 where over half of the hashes have it. Two fingerprints link
at ``budget`` differing bits or fewer.

The join: with five or more blocks of bits, ``budget`` differing bits leave some blocks equal, so fingerprints are
dealt by each choice of equal blocks, and each deal is a sorted sequence read as a binary trie. Pairs of nodes are
followed together, differing bits are added up, and a pair is dropped when they exceed the budget or when both nodes
already lie in one component. The number of blocks follows the number of fingerprints, so that a deal stays small;
every choice of blocks is exact. A deal above ``_DEAL`` rows is cut into parts that meet in pairs.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; repeated rows and copies
share a fingerprint and a component; a null doc_id never names a component unless its members all are null; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, min_labels, tidied, unused, whole_ids

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Rows of one deal at most before it is cut into parts.
_DEAL = 1 << 16
_SPAN = 1 << 16
#: Ids at most for a broadcast (some 5 MB).
BROADCAST_ROWS = 300_000


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, n) - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    shingles = n - SHINGLE + 1
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    for lo in range(0, shingles, _SPAN):
        hi = min(lo + _SPAN, shingles)
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[lo:hi], stops[lo:hi])), np.uint64, hi - lo)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > shingles, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(whole_ids(docs, doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), "doc_id long, fp long")


def trie_components(x: np.ndarray, budget: int) -> np.ndarray:
    """Labels (smallest index) of the components that sorted, distinct fingerprints form at ``budget`` differing bits."""
    n = len(x)
    near = np.flatnonzero(np.bitwise_count(x[1:] ^ x[:-1]) <= budget)
    label = min_labels(n, near, near + 1)
    changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    stack = [(63, np.array([[0, n, 0, n, 0]], np.int64))]
    while stack:
        bit, f = stack.pop()
        alo, ahi, blo, bhi, err = f.T
        one = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (label[alo] == label[blo])
        f = f[~one]
        if not len(f):
            continue
        if len(f) > 1 << 15:
            half = len(f) // 2
            stack += [(bit, f[half:]), (bit, f[:half])]
            continue
        alo, ahi, blo, bhi, err = f.T
        pairs = (ahi - alo) * (bhi - blo)
        leaf = (pairs <= 64) | (bit < 0)
        if leaf.any():
            la, wa, lb, wb = alo[leaf], (ahi - alo)[leaf], blo[leaf], (bhi - blo)[leaf]
            size = wa * wb
            which = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            i, j = la[which] + k // wb[which], lb[which] + k % wb[which]
            hit = np.bitwise_count(x[i] ^ x[j]) <= budget
            i, j = label[i[hit]], label[j[hit]]
            if (i != j).any():
                label = min_labels(n, np.concatenate([i, np.arange(n)]), np.concatenate([j, label]))
                changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            f = f[~leaf]
            if not len(f):
                continue
            alo, ahi, blo, bhi, err = f.T
        above = np.uint64(bit)

        def split(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return np.clip(np.searchsorted(x, ((x[lo] >> above) | np.uint64(1)) << above), lo, hi)

        am, bm = split(alo, ahi), split(blo, bhi)
        same = alo == blo
        nxt = [
            np.stack([alo, am, blo, bm, err], 1),
            np.stack([am, ahi, bm, bhi, err], 1),
            np.stack([alo, am, bm, bhi, err + 1], 1),
            np.stack([am, ahi, blo, bm, err + 1], 1)[~same],
        ]
        f = np.concatenate(nxt)
        f = f[(f[:, 1] > f[:, 0]) & (f[:, 3] > f[:, 2]) & (f[:, 4] <= budget)]
        if len(f):
            stack.append((bit - 1, f))
    return label


def _deals(n: int, budget: int) -> list[list[tuple[int, int]]]:
    """The choices of equal blocks, each a list of (shift, width); a deal holds a few hundred of ``n`` even fingerprints."""
    for blocks in range(budget + 1, 17):
        cut = [round(64 * i / blocks) for i in range(blocks + 1)]
        choices = [[(cut[i], cut[i + 1] - cut[i]) for i in c] for c in combinations(range(blocks), blocks - budget)]
        if n / 2 ** min(sum(w for _, w in c) for c in choices) <= 512:
            break
    return choices


def links(reps: DataFrame, n: int, budget: int = BUDGET) -> DataFrame:
    """Links (a long, b long) that connect the distinct fingerprints ``reps.fp`` as all links within the budget do."""
    keys = []
    for t, choice in enumerate(_deals(n, budget)):
        key = F.lit(0).cast("long")
        for shift, width in choice:
            key = key.bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))) if len(choice) == 1 else F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    dealt = reps.select("fp", F.explode(F.array(*keys)).alias("d")).select("fp", "d.t", "d.key")
    sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > _DEAL).select("t", "key", F.ceil(F.col("n") / _DEAL).cast("int").alias("parts"))
    dealt = dealt.join(sizes.where("n between 2 and " + str(_DEAL)).select("t", "key", F.lit(1).alias("parts")).union(large), ["t", "key"])
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda d: F.struct(F.least(d, F.col("part")).alias("p"), F.greatest(d, F.col("part")).alias("q")))
    dealt = dealt.withColumn("part", part).select("t", "key", "fp", F.explode(meets).alias("m")).select("t", "key", "m.p", "m.q", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []

        def flush(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = np.sort(group.view(np.uint64))
            label = trie_components(x, budget)
            other = label != np.arange(len(x))
            return x[label[other]], x[other]

        last = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            a, b = [], []
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                now = tuple(c[lo] for c in cols[:4])
                if last is not None and now != last:
                    u, v = flush(np.concatenate(rest))
                    a.append(u)
                    b.append(v)
                    rest = []
                last = now
                rest.append(cols[4][lo:hi])
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})
        if rest:
            u, v = flush(np.concatenate(rest))
            yield pa.RecordBatch.from_pydict({"a": u.view(np.int64), "b": v.view(np.int64)})

    group = ["t", "key", "p", "q"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidied(run), "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    prints = materialize(fingerprints(docs), "fingerprints")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    found = components(links(reps, reps.count(), budget))
    rooted = reps.join(found, reps.fp == found.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.select("fp", "root").join(first, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id names their component; rows equal in doc_id and text are one."""
    [name] = unused(docs, "gone")
    found = materialize(near_duplicates(docs, budget), "components")
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept")).where("not kept").select(F.col("doc_id").alias(name))
    gone = materialize(gone, "gone")
    if gone.count() <= BROADCAST_ROWS:  # so few keys need not move the texts
        gone = F.broadcast(gone)
    out = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")
    counts = found.agg(F.count("*").alias("n"), F.countDistinct(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("d")).first()
    return out if counts["n"] == counts["d"] else out.dropDuplicates(["doc_id", "text"])
