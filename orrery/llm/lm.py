"""Language-model scores from an Elias-Fano n-gram trie.

Level 1 holds the training tokens (by a 64-bit hash, in order) with their counts, level 2 the pairs. A pair's context
is found among a shard's contexts, monotone pointers give the range of its successors, and the next token is searched
there, relative to its context. Hashes, contexts, pointers and successors are Elias-Fano sequences; a pair carries its
smoothed log10 probability in 16 bits, rounded down. Both levels are cut into shards by hash, each written by one task
into the shared folder and memory-mapped by the tasks that score, so memory does not grow with the corpus.

P(w | v) = (c(v w) + K p(w)) / (c(v) + K), with p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) from training tokens; the
counts are those of all training texts. A text starts from a context of its own and ends with an end token.

Pairs are counted inside a task first and travel as packed runs, dealt by a hash of both tokens, so a frequent token's
pairs spread over all shards.

Defined results: a null, empty or blank text is its end token; without training texts every token has p = 1; repeated
rows count as often as they occur and are scored alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, tidied

SMOOTHING = 1000.0
#: Tokens of level 1 and pairs of level 2 in a shard, about.
SHARD_WORDS, SHARD_PAIRS = 2_000_000, 2_000_000
#: Tokens that a task looks up or counts together.
CHUNK = 1_000_000
_ROWS = 500
END = b" "
_STEP = 16 / 65535
_U = np.uint64


class EliasFano:
    """A sorted sequence of unsigned integers: low bits packed, high bits in unary with a rank for every 16 buckets."""

    NAMES = ("low", "high", "ranks")

    def __init__(self, n: int, shift: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray) -> None:
        self.n, self.shift, self.low, self.high, self.ranks = n, shift, low, high, ranks

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(_U)
        shift = max(0, (universe // max(1, n)).bit_length() - 1)
        buckets = (universe >> shift) + 1
        top = (values >> _U(shift)).astype(np.int64)
        bits = np.zeros(-(-(n + buckets + 64) // 64) * 64, bool)
        bits[top + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view(_U)
        ranks = np.searchsorted(top, np.arange(0, buckets + 16, 16)).astype(np.uint32)
        low = np.zeros(n * shift // 64 + 2, _U)
        if shift and n:
            part = values & _U((1 << shift) - 1)
            at = np.arange(n, dtype=np.int64) * shift
            word, off = at >> 6, (at & 63).astype(_U)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low[word[first]] |= np.bitwise_or.reduceat(part << off, first)
            over = (off.astype(np.int64) + shift) > 64
            if over.any():
                low[word[over] + 1] |= part[over] >> (_U(64) - off[over])  # one value at most runs into each word
        return cls(n, shift, low, high, ranks)

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(i), _U)
        at = i * self.shift
        word, off = at >> 6, (at & 63).astype(_U)
        x = self.low[word] >> off
        x |= np.where(off > 0, self.low[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
        return x & _U((1 << self.shift) - 1)

    def _skip(self, pos: np.ndarray, bits: np.ndarray, ones: bool = False) -> np.ndarray:
        """The bit position after the given number of zeros (or ones) from ``pos``."""
        pos, bits = pos.copy(), bits.copy()
        active = np.flatnonzero(bits > 0)
        while len(active):
            p, z = pos[active], bits[active]
            word = self.high[p >> 6]
            w = (word if ones else ~word) >> (p & 63).astype(_U)  # what is shifted in counts as neither
            have = np.bitwise_count(w).astype(np.int64)
            inside = have >= z
            if inside.any():
                v, k, at = w[inside], z[inside], np.zeros(int(inside.sum()), np.int64)
                for half in (32, 16, 8, 4, 2, 1):
                    below = np.bitwise_count(v & _U((1 << half) - 1)).astype(np.int64)
                    go = below < k
                    k = np.where(go, k - below, k)
                    at += np.where(go, half, 0)
                    v = np.where(go, v >> _U(half), v)
                pos[active[inside]] = p[inside] + at + 1
            rest = ~inside
            pos[active[rest]] = ((p[rest] >> 6) + 1) << 6
            bits[active[rest]] = z[rest] - have[rest]
            active = active[rest]
        return pos

    def bounds(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of elements in each bucket."""
        block = bucket >> 4
        start = self._skip(self.ranks[block].astype(np.int64) + (block << 4), bucket & 15)
        end = self._skip(start, np.ones(len(bucket), np.int64)) - 1
        return start - bucket, end - bucket

    def find(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> np.ndarray:
        """The index of the first element at or above each ``x``, of those from ``first`` to ``last`` - 1 in its bucket."""
        bucket = (x >> _U(self.shift)).astype(np.int64)
        lo, hi = self.bounds(bucket)
        if last is not None:
            lo = np.maximum(lo, first)
            hi = np.maximum(np.minimum(hi, last), lo)
        want = x & _U((1 << self.shift) - 1)
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = self.low_bits(mid) < want[active]
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        return lo

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at the given indexes."""
        if not len(i):
            return np.zeros(0, _U)
        block = np.searchsorted(self.ranks, i.astype(self.ranks.dtype), "right") - 1
        first = self.ranks[block].astype(np.int64)
        at = self._skip(first + (block << 4), i - first + 1, ones=True) - 1
        return ((at - i).astype(_U) << _U(self.shift)) | self.low_bits(i)

    def index(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> np.ndarray:
        """The index of each ``x``, -1 where it is absent (from the elements ``first`` to ``last`` - 1, if given)."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        bucket = (x >> _U(self.shift)).astype(np.int64)
        _, end = self.bounds(bucket)
        if last is not None:
            end = np.minimum(end, last)
        at = self.find(x, first, last)
        inside = at < end
        safe = np.where(inside, at, 0)
        return np.where(inside & (self.low_bits(safe) == (x & _U((1 << self.shift) - 1))), at, -1)


def _folder(path: str) -> str:
    """The shared folder as executors mount it."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"levels are memory-mapped, which needs a shared folder that executors mount, not {url.scheme}://")
    return url.path


def _save(path: str, **parts) -> None:
    """Writes sequences and arrays to one file, by way of a name of the task's own; a repeated task does no harm."""
    head, blobs, at = {}, [], 0
    for name, part in parts.items():
        arrays = {k: getattr(part, k) for k in EliasFano.NAMES} if isinstance(part, EliasFano) else {"": part}
        head[name] = {"n": part.n, "shift": part.shift} if isinstance(part, EliasFano) else {}
        for k, a in arrays.items():
            head[name][k] = [at, len(a), a.dtype.str]
            blobs.append(a.tobytes() + bytes(-a.nbytes % 8))
            at += len(blobs[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(own, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        f.writelines(blobs)
    os.replace(own, path)


def _open(path: str) -> dict:
    with open(path, "rb") as f:
        n = int.from_bytes(f.read(8), "little")
        head = json.loads(f.read(n))
    data = np.memmap(path, np.uint8, "r", 8 + n)

    def array(spec: list) -> np.ndarray:
        at, size, kind = spec
        return data[at : at + size * np.dtype(kind).itemsize].view(kind)

    return {name: EliasFano(h["n"], h["shift"], *(array(h[k]) for k in EliasFano.NAMES)) if "n" in h else array(h[""]) for name, h in head.items()}


def _tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


class Words:
    """Level 1: global ids (in hash order) and counts of tokens."""

    def __init__(self, folder: str, bits: int, sizes: list[int]) -> None:
        self.folder, self.bits = folder, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.open: dict[int, dict] = {}

    def shard(self, k: int) -> dict:
        if k not in self.open:
            self.open[k] = _open(f"{self.folder}/words-{k}")
        return self.open[k]

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: not in training) and counts by hash."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        which = (h >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        rest = h & _U((1 << (64 - self.bits)) - 1)
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(len(self.starts)))
        for k in range(len(self.starts) - 1):
            part = order[edges[k] : edges[k + 1]]
            if len(part) and self.starts[k + 1] > self.starts[k]:
                shard = self.shard(k)
                at = shard["hashes"].index(rest[part])
                hit = at >= 0
                ids[part[hit]] = at[hit] + self.starts[k]
                counts[part[hit]] = shard["counts"][at[hit]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        which = np.searchsorted(self.starts, ids, "right") - 1
        out = np.zeros(len(ids), np.int64)
        for k in np.unique(which).tolist():
            part = np.flatnonzero(which == k)
            out[part] = self.shard(k)["counts"][ids[part] - self.starts[k]]
        return out


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, list[tuple[pa.RecordBatch, int, int]]]]:
    """Runs of whole texts of about ``CHUNK`` tokens: distinct tokens, local ids of all tokens, lengths, and row ranges."""
    local: dict = defaultdict(count().__next__)
    ids, sizes, rows, held = [], [], [], 0

    def out():
        return list(local), np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array(sizes, np.int64), rows

    for batch in (whole.slice(lo, _ROWS) for whole in batches for lo in range(0, whole.num_rows, _ROWS)):
        first = 0
        for i, t in enumerate(batch.column(column).to_pylist()):
            words = _tokens(t)
            ids.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)))
            sizes.append(len(words))
            held += len(words)
            if held >= CHUNK:
                rows.append((batch, first, i + 1))
                yield out()
                local = defaultdict(count().__next__)
                ids, sizes, rows, held, first = [], [], [], 0, i + 1
        if first < batch.num_rows:
            rows.append((batch, first, batch.num_rows))
    if sizes:
        yield out()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, [42] * len(words)), _U, len(words))


def _mix(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = v * _U(0x9E3779B97F4A7C15) + w * _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(31)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Model:
    """What a task needs to open the levels; it has one number for each shard."""

    def __init__(self, folder: str, bits: int, sizes: list[int], total: int, texts: int, pairs: int, smoothing: float) -> None:
        self.folder, self.bits, self.sizes, self.total, self.texts, self.pairs, self.smoothing = folder, bits, sizes, total, texts, pairs, smoothing
        self.types = sum(sizes)

    def words(self) -> Words:
        return Words(self.folder, self.bits, self.sizes)

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.total + 0.5 * (self.types + 1))

    def contexts(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The token before each; ``types`` at the start of a text."""
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[np.cumsum(sizes) - sizes] = self.types
        return before


def _level1(training: DataFrame, text: str, folder: str) -> tuple[int, list[int], int, int]:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"h": _hashes(list(seen)).view(np.int64), "c": np.fromiter(seen.values(), np.int64, len(seen))})

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(_tokens(t))
                if len(seen) > 400_000:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    words = materialize(training.select(F.col(text).alias("t")).mapInArrow(tidied(counted), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    types, total = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    bits = max(0, (types // SHARD_WORDS).bit_length())
    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    order = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = -1

        def flush() -> pa.RecordBatch:
            h, c = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            rest = h.view(_U) & _U((1 << (64 - bits)) - 1)
            _save(f"{folder}/words-{now}", hashes=EliasFano.build(rest, 1 << (64 - bits)), counts=c.astype(np.uint32 if c.max() < 2**32 else np.uint64))
            return pa.RecordBatch.from_pydict({"shard": [now], "n": [len(h)]})

        for batch in batches:
            s, h, c = (batch.column(i).to_numpy() for i in range(3))
            edges = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for lo, hi in zip(edges, edges[1:]):
                if lo < hi:
                    if s[lo] != now and held:
                        yield flush()
                        held = []
                    now = int(s[lo])
                    held.append((h[lo:hi], c[lo:hi]))
        if held:
            yield flush()

    dealt = words.select(shard.alias("s"), "h", "c").repartition("s").sortWithinPartitions("s", order)
    sizes = dict(map(tuple, dealt.mapInArrow(tidied(write), "shard long, n long").collect()))  # one row for each shard
    end = words.where(F.col("h") == int(_hashes([END]).view(np.int64)[0])).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return bits, [sizes.get(k, 0) for k in range(1 << bits)], total, end


def _level2(training: DataFrame, text: str, model: Model) -> None:
    if model.types >= 2**32 - 1:
        raise ValueError("ids of 32 bits do not hold all tokens")
    shards = model.pairs

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model.words()
        pack = zstandard.ZstdCompressor(level=1).compress
        for distinct, ids, sizes, _ in _chunks(batches, 0):
            known, _ = words.ids(_hashes(distinct))
            w = known[ids]
            v = model.contexts(w, sizes)
            key, n = np.unique(v.astype(_U) << _U(32) | w.astype(_U), return_counts=True)
            which = (_mix(key >> _U(32), key & _U(2**32 - 1)) % _U(shards)).astype(np.int64)
            order = np.argsort(which, kind="stable")
            edges = np.searchsorted(which[order], np.arange(shards + 1))
            for k in range(shards):
                part = order[edges[k] : edges[k + 1]]
                if len(part):
                    x = key[part]
                    v32, w32 = (x >> _U(32)).astype(np.uint32), x.astype(np.uint32)
                    blob = np.diff(v32, prepend=np.uint32(0)).tobytes() + w32.tobytes() + np.minimum(n[part], 255).astype(np.uint8).tobytes() + n[part][n[part] >= 255].astype(np.uint64).tobytes()
                    yield pa.RecordBatch.from_pydict({"s": [k], "n": [len(part)], "blob": [pack(blob)]})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model.words()
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, rows = -1, 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return key[first], np.add.reduceat(n, first)

        def flush() -> pa.RecordBatch:
            key, n = merged()
            v, w = (key >> _U(32)).astype(np.int64), (key & _U(2**32 - 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            contexts = v[first]
            start = contexts == model.types
            of_context = np.full(len(contexts), model.texts, np.int64)
            of_context[~start] = words.counts(contexts[~start])
            which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))
            p = (n + model.smoothing * model.base(words.counts(w))) / (of_context[which] + model.smoothing)
            code = np.clip(np.ceil(-np.log10(p) / _STEP), 0, 65535).astype(np.uint16)
            width = model.types + 1
            _save(
                f"{model.folder}/pairs-{now}",
                contexts=EliasFano.build(contexts.astype(_U), width),
                pointers=EliasFano.build(np.append(first, len(v)).astype(_U), len(v) + 1),
                successors=EliasFano.build(which.astype(_U) * _U(width) + w.astype(_U), len(contexts) * width),
                codes=code,
            )
            return pa.RecordBatch.from_pydict({"n": [len(key)]})

        for batch in batches:
            for s, m, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if s != now and held:
                    yield flush()
                    held, rows = [], 0
                now = s
                data = unpack(blob)
                v = np.cumsum(np.frombuffer(data, np.uint32, m), dtype=np.uint32)
                n = np.frombuffer(data, np.uint8, m, 8 * m).astype(np.int64)
                n[n == 255] = np.frombuffer(data, np.uint64, -1, 9 * m).astype(np.int64)
                held.append((v.astype(_U) << _U(32) | np.frombuffer(data, np.uint32, m, 4 * m).astype(_U), n))
                rows += m
                if rows > 4 * SHARD_PAIRS:
                    held = [merged()]
                    rows = len(held[0][0])
        if held:
            yield flush()

    packed = training.select(F.col(text).alias("t")).mapInArrow(tidied(counted), "s long, n long, blob binary")
    packed.repartition(F.col("s")).sortWithinPartitions("s").mapInArrow(tidied(write), "n long").agg(F.sum("n")).first()


def train(training: DataFrame, text: str = "text", smoothing: float = SMOOTHING) -> Model:
    """Builds both levels from all texts of ``training`` in the shared folder."""
    folder = _folder(new_path(training.sparkSession, "ngrams"))
    bits, sizes, total, texts = _level1(training, text, folder)
    model = Model(folder, bits, sizes, total, texts, total // SHARD_PAIRS + 1, smoothing)
    _level2(training, text, model)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model.words()
        shards: dict[int, dict | None] = {}
        width = model.types + 1

        def level(k: int) -> dict | None:
            if k not in shards:
                path = f"{model.folder}/pairs-{k}"
                shards[k] = _open(path) if os.path.exists(path) else None
            return shards[k]

        for distinct, ids, sizes, rows in _chunks(batches, 1):
            known, counts = words.ids(_hashes(distinct))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            c, w = counts[ids], known[ids]
            p = model.base(c)
            logp = np.log10(p)
            v = model.contexts(w, sizes)
            of_context = np.empty_like(c)
            of_context[1:] = c[:-1]
            of_context[v == model.types] = model.texts
            out = np.log10(model.smoothing * p / (of_context + model.smoothing))
            ask = np.flatnonzero((v >= 0) & (w >= 0))
            key, back = np.unique(v[ask].astype(_U) << _U(32) | w[ask].astype(_U), return_inverse=True)
            found = np.full(len(key), np.nan)
            kv, kw = key >> _U(32), key & _U(2**32 - 1)
            which = (_mix(kv, kw) % _U(model.pairs)).astype(np.int64)
            order = np.argsort(which, kind="stable")
            edges = np.searchsorted(which[order], np.arange(model.pairs + 1))
            for k in range(model.pairs):
                part = order[edges[k] : edges[k + 1]]
                shard = level(k) if len(part) else None
                if shard is None:
                    continue
                context = shard["contexts"].index(kv[part])
                part, context = part[context >= 0], context[context >= 0]
                ends = shard["pointers"].get(np.concatenate([context, context + 1])).astype(np.int64)
                lo, hi = ends[: len(context)], ends[len(context) :]
                at = shard["successors"].index(context.astype(_U) * _U(width) + kw[part], lo, hi)
                hit = at >= 0
                found[part[hit]] = shard["codes"][at[hit]] * -_STEP
            pair = found[back]
            out[ask] = np.where(np.isnan(pair), out[ask], pair)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column(0).slice(lo, hi - lo) for b, lo, hi in rows]),
                    pa.array(sizes),
                    pa.array(np.bincount(owner, c > 0, n).astype(np.int64)),
                    pa.array(np.full(n, model.total, np.int64)),
                    pa.array(np.bincount(owner, logp, n)),
                    pa.array(np.bincount(owner, out, n)),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(tidied(run), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
