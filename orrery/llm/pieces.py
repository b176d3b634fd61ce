"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from the model file. The normaliser rewrites a text (white space escaped, a prefix added,
and the model's own character rules where it has any). The piece machine is a trie whose arcs read characters and write
piece ids; byte fallback adds, for a character that no piece spells, a path that writes its bytes. Composed with an
input it gives a lattice, and the answer is the lattice's shortest path in the tropical semiring (weights add along a
path, the least sum wins).

A unigram model's weights are its negated scores. A merge (BPE) model has no such weights: its answer is the path on
which every two neighbouring pieces are what merging gives for the two of them together. So there the states also
remember the last piece, an arc weighs 0 if the pair is stable under merging and infinity if not, and exactly one path
has a finite weight. Pairs are checked once by merging and remembered.

Pieces never hold white space after another character (checked at compile time), so a text is cut before white space
and each part is composed once, then kept in a bounded cache. Texts are read whole.

Defined results: a null or empty text has no ids and decodes to the empty text; characters without a piece become
bytes; bytes that are no UTF-8 decode to U+FFFD; repeated rows get equal results; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_CACHE = 250_000
_LONGEST = 64
_ROWS = 500
_INF = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """The fields (number, wire type, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, kind, data[at : at + n]
        at += n


class Model:
    """The parts of a SentencePiece model file that encoding needs."""

    def __init__(self, path: str) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, self.byte_fallback = 1, False
        self.add_prefix, self.squeeze, self.escape, charsmap = True, True, True, b""
        with open(path, "rb") as f:
            data = f.read()
        for number, _, value in _fields(data):
            if number == 1:
                piece = {k: v for k, _, v in _fields(value)}
                self.pieces.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = {k: v for k, _, v in _fields(value)}
                self.model_type = spec.get(3, 1)
                self.byte_fallback = bool(spec.get(35, 0))
            elif number == 3:
                spec = {k: v for k, _, v in _fields(value)}
                charsmap = spec.get(2, b"")
                self.add_prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if charsmap:
            raise ValueError("models with character rules are not supported")
        if any(k == USER for k in self.kinds):
            raise ValueError("models with user-defined symbols are not supported")
        if self.model_type not in (1, 2):
            raise ValueError("neither a unigram nor a BPE model")
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}

    def normalize(self, text: str) -> str:
        """The normaliser: white space rules, then the escaped text."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.add_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def decode(self, ids: list[int]) -> str:
        """Text from ids."""
        out = bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                out.append(int(self.pieces[i][3:5], 16))
            elif self.kinds[i] == UNKNOWN:
                out += " ⁇ ".encode()
            elif self.kinds[i] != CONTROL:
                out += self.pieces[i].encode()
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.add_prefix and text.startswith(" ") else text


class Transducer:
    """The piece machine with byte fallback, and its composition with inputs."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.rank = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k == NORMAL}
        self.id_of = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        self.merging = model.model_type == 2
        self.trie: dict = {}
        worst = min(self.rank.values(), default=0.0)
        self.unknown_weight = 10.0 - worst
        for piece, i in self.id_of.items():
            if self.merging and len(piece) > 1 and self.merge(piece) != [piece]:
                continue  # merging never ends in this piece
            node = self.trie
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = (i, 0.0 if self.merging else -self.rank[piece])
        self.stable: dict[int, bool] = {}  # by last piece and next
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of)

    def merge(self, text: str) -> list[str]:
        """Merging as a BPE model defines it: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = -_INF, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging keeps two pieces, side by side, as they are."""
        return self.merge(left + right) == [left, right]

    def fallback(self, ch: str) -> tuple[int, ...]:
        if self.model.byte_fallback:
            return tuple(self.model.byte_ids[b] for b in ch.encode("utf-8", "surrogatepass"))
        return (self.model.unknown,)

    def shortest(self, text: str) -> list[int]:
        """The ids on the shortest path of the lattice of ``text`` and the machine, from left to right."""
        return self._stable_path(text) if self.merging else self._least_path(text)

    def _arcs(self, text: str, i: int) -> Iterator[tuple[int, int, float]]:
        """The arcs that leave position i: where each ends, what it writes, its weight."""
        node, single = self.trie, False
        for j in range(i, len(text)):
            node = node.get(text[j])
            if node is None:
                break
            arc = node.get("")
            if arc is not None:
                single = single or j == i
                yield j + 1, arc[0], arc[1]
        if not single:
            yield i + 1, -1, self.unknown_weight

    def _least_path(self, text: str) -> list[int]:
        n = len(text)
        weight, back = [0.0] + [_INF] * n, [(0, 0)] * (n + 1)
        for i in range(n):
            for j, piece, w in self._arcs(text, i):
                if weight[i] + w < weight[j]:
                    weight[j], back[j] = weight[i] + w, (i, piece)
        at, path = [], []
        j = n
        while j > 0:
            j, piece = back[j]
            at.append(j)
            path.append(piece)
        return self._spelled(text, at[::-1], path[::-1])

    def _stable_path(self, text: str) -> list[int]:
        """Weights are 0 or infinite and depend on the last piece: the first path of weight 0 is the shortest. Arcs are
        followed longest first; a state that leads nowhere is left once and not entered again."""
        n = len(text)
        root, stable, pieces = self.trie, self.stable, self.model.pieces
        at, path, options, dead = [0], [-2], [], set()
        i = 0
        while i < n:
            if len(options) < len(at):
                arcs = []
                node = root
                for j in range(i, n):
                    node = node.get(text[j])
                    if node is None:
                        break
                    if "" in node:
                        arcs.append((j + 1, node[""][0]))
                if not arcs or arcs[0][0] != i + 1:
                    arcs.insert(0, (i + 1, -1))
                options.append(arcs)
            arcs, last = options[-1], path[-1]
            while arcs:
                j, piece = arcs.pop()
                if last >= 0 and piece >= 0:
                    key = last << 32 | piece
                    known = stable.get(key)
                    if known is None:
                        known = self.fits(pieces[last], pieces[piece])
                        if len(stable) > 400_000:
                            stable.clear()
                        stable[key] = known
                    if not known:
                        continue  # an arc of infinite weight
                if dead and (j, piece) in dead:
                    continue
                at.append(j)
                path.append(piece)
                i = j
                break
            else:
                dead.add((i, last))
                at.pop()
                path.pop()
                options.pop()
                i = at[-1]
        return self._spelled(text, at, path[1:])

    def _spelled(self, text: str, at: list[int], path: list[int]) -> list[int]:
        if min(path, default=0) >= 0:
            return path
        ids = [x for i, piece in zip(at, path) for x in ((piece,) if piece >= 0 else self.fallback(text[i]))]
        if not self.model.byte_fallback:  # the library joins neighbouring unknowns
            ids = [x for k, x in enumerate(ids) if not (k and x == self.model.unknown == ids[k - 1])]
        return ids


class _Parts(dict):
    """Packed ids by part of a normalised text; two generations bound it, long parts are not kept."""

    def __init__(self, machine: Transducer) -> None:
        super().__init__()
        self.machine, self.old = machine, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = np.array(self.machine.shortest(part), np.int32).tobytes()
        if len(part) <= _LONGEST:
            if len(self) >= _CACHE:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


def _cutter(machine: Transducer):
    """Cuts a normalised text where no piece can join its two sides: before white space, around characters of no longer
    piece, between a letter and a mark (and a mark and a letter) that stand side by side in no piece."""
    joined = {c for p in machine.id_of if len(p) > 1 for c in p}
    neighbours = {(x, y) for p in machine.id_of for x, y in zip(p, p[1:]) if SPACE not in (x, y)}
    stop = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
    marks = {chr(c) for c in range(33, 127) if not chr(c).isalnum()}
    marks |= {c for pair in neighbours for c in pair if not c.isascii() and marks & set(pair)}  # characters that go with marks
    not_before = {y for x, y in neighbours if y in marks and x not in marks}  # marks that a letter may join
    not_after = {x for x, y in neighbours if x in marks and y not in marks}
    group = lambda chars: "".join(map(re.escape, sorted(chars)))
    m, rest = group(marks), f"[^{SPACE}{stop}]*"
    letters = f"{SPACE}*[^{SPACE}{stop}{m}]+" + (f"(?:[{group(not_before)}]{rest})?" if not_before else "")
    others = f"{SPACE}*[{m}]+" + (f"(?:(?<=[{group(not_after)}]){rest})?" if not_after else "")
    return re.compile(f"{letters}|{others}|{SPACE}+" + (f"|[{stop}]" if stop else "")).findall


class Encoder:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str) -> None:
        self.model = Model(path)
        self.machine = Transducer(self.model)
        self.parts = _Parts(self.machine)
        self.find = _cutter(self.machine) if self.machine.cuts else lambda t: [t]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return np.frombuffer(b"".join(map(self.parts.__getitem__, self.find(self.model.normalize(text)))), np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces long, ids array<int>, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        spelled = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode() for p, k in zip(encoder.model.pieces, encoder.model.kinds)]
        spelled[encoder.model.unknown] = " ⁇ ".encode()
        drop = len(SPACE.encode()) if encoder.model.add_prefix else 0
        space = SPACE.encode()
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):  # few texts at a time: ids take more room than text
                batch = whole.slice(lo, _ROWS)
                found, sha, same = [], [], []
                for t in batch.column(1).to_pylist():
                    ids = encoder.encode(t)
                    out = b"".join(map(spelled.__getitem__, ids.tolist()))
                    out = out[drop:] if out.startswith(space) else out
                    found.append(ids)
                    sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    same.append(out.decode("utf-8", "replace").replace(SPACE, " ") == (t or ""))
                sizes = [len(i) for i in found]
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), lists, pa.array(sha), pa.array(same)], names=["doc_id", "n_pieces", "ids", "ids_sha256", "round_trip"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(tidied(run), f"doc_id {kind}, n_pieces long, ids array<int>, ids_sha256 string, round_trip boolean")


def decode(rows: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text: the text that the ids spell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = dict(rows.dtypes)[doc_id]
    return rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("i")).mapInArrow(tidied(run), f"doc_id {kind}, text string")
