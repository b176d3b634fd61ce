"""Language identification with hyperdimensional profiles.

Every letter has a pseudo-random vector of +1 and -1. A letter trigram is bound by rotating the vectors of its first
two letters and multiplying the three; a text is the bundle (sum) of its trigrams, a language the bundle of its
training texts. A text takes the language whose prototype has the largest cosine with it.

``accept`` keeps a text only where two bounds hold. Its cosine is ``FLOOR`` at least: two unrelated texts have cosines of
deviation 1 / sqrt(DIM) = 0.031 whatever their lengths, so 0.15 is 4.8 deviations. And its resemblance is ``SHARE`` at
least: the mean weight that the language gives the text's trigrams, divided by the same mean over the language's own
training texts, which is thus 1 for them, long or short. Texts too short to rise above the floor go.

Defined results: a null text, or one without a letter, gives ``und`` and score 0. A text is read whole, in pieces of
bounded memory. Equal cosines go to the language first in code point order. Repeated rows count as often as they
occur. Without a labelled text every text is ``und``. Other columns are ignored, or carried along under their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

DIM = 1024
#: The least cosine and the least resemblance (training texts: 1 on average) of a text in a learnt language.
FLOOR, SHARE = 0.15, 0.4
#: Languages at most: the prototypes go to every task, DIM doubles each.
MAX_LANGUAGES = 4096
_PIECE = 1 << 18
_BLOCK = 2048
_ROWS = 500
_letter: dict[str, np.ndarray] = {}
_vectors: dict[int, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if "table" not in _letter:
        _letter["table"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter["table"]


def letter_vector(code: int) -> np.ndarray:
    """The vector of a code point (0: the edge of a word), the same on every machine."""
    if code not in _vectors:
        if len(_vectors) > 20_000:
            _vectors.clear()
        _vectors[code] = np.random.Generator(np.random.PCG64([code, 71])).integers(0, 2, DIM).astype(np.float32) * 2 - 1
    return _vectors[code]


def _bind(letters: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The vectors of trigrams given as indexes (i, j, k) into ``letters``."""
    base = np.stack([letter_vector(int(c)) for c in letters])
    return np.roll(base, 2, 1)[codes[:, 0]] * np.roll(base, 1, 1)[codes[:, 1]] * base[codes[:, 2]]


def _bundle_piece(code: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out[owner]`` the vectors of all trigrams of a run of lower-case code points, 0 at word edges."""
    letters, index = np.unique(code, return_inverse=True)
    ok = (code[1:-1] != 0) & (owner[:-2] == owner[2:])
    n = len(letters)
    key = ((index[:-2] * n + index[1:-1]) * n + index[2:])[ok]
    who = owner[1:-1][ok]
    if not len(key):
        return
    if n**3 <= 4_000_000:
        seen = np.zeros(n**3, bool)
        seen[key] = True
        grams = np.flatnonzero(seen)
        place = np.zeros(n**3, np.int64)
        place[grams] = np.arange(len(grams))
        at = place[key]
    else:
        grams, at = np.unique(key, return_inverse=True)
    triples = np.stack([grams // (n * n), grams // n % n, grams % n], 1)
    first = int(who.min())
    docs = int(who.max()) - first + 1
    width = max(1, min(len(grams), _BLOCK, 8_000_000 // docs))
    for lo in range(0, len(grams), width):
        hi = min(lo + width, len(grams))
        if hi - lo == len(grams):
            flat = (who - first) * len(grams) + at
        else:
            part = (at >= lo) & (at < hi)
            flat = (who[part] - first) * (hi - lo) + at[part] - lo
        counts = np.bincount(flat, minlength=docs * (hi - lo)).astype(np.float32).reshape(docs, hi - lo)
        out[first : first + docs] += counts @ _bind(letters, triples[lo:hi])


def bundle(texts: list[str | None]) -> np.ndarray:
    """One row for each text: the sum of its trigrams' vectors."""
    return _bundle(texts)[0]


def _bundle(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bundles and the number of trigrams (one for each letter) of each text."""
    out = np.zeros((len(texts), DIM), np.float64)
    letters = np.zeros(len(texts), np.int64)
    is_letter = _is_letter()
    codes: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if codes:
            _bundle_piece(np.concatenate(codes), np.concatenate(owners), out)
        codes.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(is_letter[code], code, 0)
        letters[i] = np.count_nonzero(code)
        code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
        for lo in range(0, max(1, len(code) - 2), _PIECE):
            part = code[lo : lo + _PIECE + 2]  # pieces share two letters, so no trigram is lost or doubled
            codes.append(part)
            owners.append(np.full(len(part), i, np.int64))
            held += len(part)
            if held >= _PIECE:
                flush()
    flush()
    return out, letters


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Prototypes (lang string, proto array<double>, letters long): each language's bundle, and its trigrams, over all rows whose text and language are set."""
    source = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        count: dict[str, int] = {}
        for batch in (b.slice(lo, _ROWS) for b in batches for lo in range(0, b.num_rows, _ROWS)):
            vectors, letters = _bundle(batch.column(0).to_pylist())
            langs = np.array(batch.column(1).to_pylist(), object)
            for name in set(langs):
                total[name] = total.get(name, 0) + vectors[langs == name].sum(0)
                count[name] = count.get(name, 0) + int(letters[langs == name].sum())
            if len(total) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "proto": [v.tolist() for v in total.values()], "letters": [count[k] for k in total]}, schema=pa.schema([("lang", pa.string()), ("proto", pa.list_(pa.float64())), ("letters", pa.int64())]))

    partial = source.mapInArrow(tidied(sums), "lang string, proto array<double>, letters long")
    summed = partial.select("lang", "letters", F.posexplode("proto").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"), F.sum("letters").alias("letters"))
    return summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("proto"), F.max("letters").alias("letters"))


class _Prototypes:
    """The learnt languages as tasks get them: names and unit vectors, ``MAX_LANGUAGES`` at most."""

    def __init__(self, prototypes: DataFrame) -> None:
        rows = prototypes.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
        if len(rows) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        self.names = [r["lang"] for r in rows]
        matrix = np.array([r["proto"] for r in rows], np.float64).reshape(len(rows), DIM)
        norm = np.linalg.norm(matrix, axis=1)
        self.matrix = matrix / np.maximum(norm, 1e-300)[:, None]
        self.own = norm / np.maximum([r["letters"] for r in rows], 1)  # a trigram's mean product with its own language's unit vector

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The best language and its cosine (0 at least) for each text."""
        return self._best(bundle(texts))[:2]

    def resembles(self, texts: list[str | None]) -> np.ndarray:
        """Whether each text is in a learnt language: cosine ``FLOOR`` and resemblance ``SHARE`` at least."""
        vectors, letters = _bundle(texts)
        found, score, best = self._best(vectors)
        if not self.names:
            return np.zeros(len(texts), bool)
        share = score * np.linalg.norm(vectors, axis=1) / np.maximum(letters * self.own[best], 1e-300)
        return (found != "und") & (score >= FLOOR) & (share >= SHARE)

    def _best(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norm = np.linalg.norm(vectors, axis=1)
        if not self.names:
            return np.full(len(norm), "und", object), np.zeros(len(norm)), np.zeros(len(norm), int)
        cosine = vectors @ self.matrix.T / np.maximum(norm, 1e-300)[:, None]
        best = cosine.argmax(1)
        return np.where(norm > 0, np.array(self.names, object)[best], "und"), np.where(norm > 0, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0), best


def predict(docs: DataFrame, prototypes: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred string and score double (the cosine, 0 at least)."""
    shared = docs.sparkSession.sparkContext.broadcast(_Prototypes(prototypes))
    kinds, names = dict(docs.dtypes), [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, _ROWS) for b in batches for lo in range(0, b.num_rows, _ROWS)):
            found, score = shared.value.score(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(found.tolist(), pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    out = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("t"))
    done = out.mapInArrow(tidied(run), ", ".join(f"{n} {kinds[c]}" for c, n in zip(keep, names)) + ", lang_pred string, score double")
    return done.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "lang_pred", "score")


def identify(docs: DataFrame, labelled: DataFrame, keep: list[str]) -> DataFrame:
    """Learns from ``labelled`` (text, lang) and predicts every row of ``docs``."""
    return predict(docs, train(labelled), keep)


def accept(docs: DataFrame, labelled: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in a learnt language (``FLOOR`` and ``SHARE``). Only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(_Prototypes(train(labelled)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [shared.value.resembles(texts.slice(lo, _ROWS).to_pylist()) for lo in range(0, len(texts), _ROWS)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, bool), pa.bool_())

    @F.arrow_udf("boolean")
    def resembles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(run)(batches)

    return docs.where(resembles(F.col(text)))
