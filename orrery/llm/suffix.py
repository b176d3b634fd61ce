"""Removal of byte strings that occur more than once, by a sparse suffix array.

Every byte covered by a ``match``-byte string that also starts anywhere else goes: in another text, or elsewhere in the
same one (overlaps count). What repeats is judged on the input, not on what is left. Besides, passages are found: maximal
runs of bytes covered by ``least``-byte strings that also start elsewhere, where they hold ``words`` words or more.

1. Anchors. In each ``least``-byte window the ``k``-gram with the least hash is an anchor. That depends on the
   window's bytes alone, so equal windows have equal anchors at equal offsets; longer windows hold such windows.
2. Anchors meet by hash, one sorted stream for each key. Where the bytes around two anchors agree as far as any
   window reaches, both are settled at once; only anchors with one hash and different surroundings go on.
3. Those bring their surroundings. Suffixes that start at the anchors are sorted deep-shallow: by their grams, then
   multikey quicksort to ``SHALLOW`` bytes behind them, then a blind trie for every group that still agrees. The array's common prefixes to the right
   and, by the same sort of the reversed bytes, to the left give the longest repeat around each anchor, exactly.
   An anchor with more than ``HOT`` different surroundings is dealt by ``PARTS`` keys instead of one: a window that
   repeats reaches l bytes to the left and the rest to the right, so two anchors that share one agree in the bytes of
   one of the parts into which l may fall, and its key holds those bytes. Keys that occur once drop out by a count with
   map-side combining. Keys that still hold more than ``VAST`` are settled by hashes of their windows, counted likewise.

Defined results: a null text is empty; a text shorter than a window has none of its repeats; a repeated row is a text of
its own, so both lose all if long enough; an empty table gives no rows; a null doc_id is a document like any other, and
ids may be of any type (``digest`` returns them as they are); columns of any name pass through ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, tidied, unused

MATCH, SHALLOW = 400, 128
#: A passage: strings of so many bytes that repeat, in a run of so many words. 50 words seldom take fewer bytes.
LEAST, WORDS = 200, 50
#: Different surroundings of one anchor above which it is dealt by parts, and their number under one part's key at most
#: that a task sorts.
HOT, VAST, PARTS = 20_000, 100_000, 8
#: Anchors of one gram that are compared pair by pair, and those whose common prefixes are read off the two suffix
#: arrays at once; more go through the classes of all their windows, whose cost grows with their number alone.
FEW, MANY = 6, 2000
_SEGMENT = 1 << 20
#: Keys of cut texts at most for a broadcast (some 5 MB).
BROADCAST_ROWS = 300_000
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_NULL = -(1 << 63)
#: Kinds of rows that are dealt by hash: an anchor, one that stands for several of its text, a span of settled bytes.
_ONCE, _TWICE, _SPAN = 0, 1, 2
_tables: dict[str, np.ndarray] = {}


class Rule(NamedTuple):
    """What is looked for: strings of ``match`` bytes, and passages unless ``words`` is 0."""

    match: int = MATCH
    least: int = LEAST
    words: int = WORDS

    @property
    def windows(self) -> tuple[int, ...]:
        """The lengths of the strings that count, the longest first."""
        return (self.match, self.least) if self.words and self.least < self.match else (self.match,)

    @property
    def k(self) -> int:
        """The length of the grams that are anchors."""
        return self.windows[-1] * 8 // 25

    @property
    def side(self) -> int:
        """How far a window through an anchor reaches before its gram, or behind it."""
        return self.match - self.k


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "byte" not in _tables:
        _tables["byte"] = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
    if len(_tables.get("up", ())) < n:
        inverse = pow(_ODD, -1, 1 << 64)
        for name, base in (("up", _ODD), ("down", inverse)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _tables[name] = np.cumprod(p, dtype=np.uint64)
    return _tables["byte"], _tables["up"], _tables["down"]


def _slide(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over x[i : i + w] for each i that has a whole window."""
    n = len(x)
    padded = np.full(-(-n // w) * w, fill, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = op.accumulate(rows, axis=1).ravel()
    behind = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - w + 1], ahead[w - 1 : n])


def _anchors_of(buf: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of texts that lie one after another; ``ends[i]``: the end of the text of byte i."""
    byte, up, down = _powers(len(buf) + 1)
    n, w = len(buf), window - k + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(byte[buf] * up[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h |= np.uint64(1)
    low = _slide(h, w, np.minimum, 2**64 - 1)
    at = np.arange(len(low))
    low[at + window > ends[: len(low)]] = 0
    high = _slide(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum, 0)
    pos = np.flatnonzero(high == h)
    return pos, h[pos]


def anchors(texts: list[bytes | None], rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole texts: the text's index, the position, the hash and a 128-bit hash of the surroundings of each anchor."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    window, side, match = rule.windows[-1], rule.side, rule.match

    def add(which: list[int], starts: list[int], buf: bytes, segment_of: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.frombuffer(buf, np.uint8)
        bounds = np.array([*starts, len(buf)])
        ends = np.repeat(bounds[1:], np.diff(bounds))
        pos, h = _anchors_of(a, ends, window, rule.k)
        owner = np.searchsorted(bounds, pos, "right") - 1
        return np.array(which)[owner], pos - bounds[owner] + segment_of, h

    def finish(who: np.ndarray, pos: np.ndarray, h: np.ndarray) -> None:
        digest = xxhash.xxh3_128_digest
        around = [digest(texts[i][max(0, p - side) : p + match], min(p, side)) for i, p in zip(who.tolist(), pos.tolist())]
        out.append((who, pos, h, np.frombuffer(b"".join(around), np.uint64).reshape(-1, 2)))

    which: list[int] = []
    starts: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        if t is None or len(t) < window:
            continue
        if len(t) > _SEGMENT:
            parts = [add([i], [0], t[lo : lo + _SEGMENT + window - 1], lo) for lo in range(0, len(t) - window + 1, _SEGMENT)]
            pos, first = np.unique(np.concatenate([p[1] for p in parts]), return_index=True)
            finish(np.full(len(pos), i), pos, np.concatenate([p[2] for p in parts])[first])
            continue
        which.append(i)
        starts.append(size)
        held.append(t)
        size += len(t)
        if size >= _SEGMENT:
            finish(*add(which, starts, b"".join(held)))
            which, starts, held, size = [], [], [], 0
    if held:
        finish(*add(which, starts, b"".join(held)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


def _common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _blind_trie(strings: list[bytes], group: list[int]) -> tuple[list[int], list[int]]:
    """Sorts a group through a blind trie: its order, and the common prefix of each string with the one before it.

    A node holds the depth at which its strings part and its children by the byte there (-1: a string that ends).
    A string goes down by those bytes alone, one comparison with the leaf found tells where it belongs.
    """
    root: list | int = group[0]
    for s in group[1:]:
        text = strings[s]
        node = root
        while not isinstance(node, int):
            depth = node[0]
            byte = text[depth] if depth < len(text) else -1
            child = node[1].get(byte)
            node = child if child is not None else next(iter(node[1].values()))
        same = _common(text, strings[node])
        other = strings[node]
        parent, node, edge = None, root, None
        while not isinstance(node, int) and node[0] < same:
            edge = text[node[0]] if node[0] < len(text) else -1
            parent, node = node, node[1][edge]
        byte = text[same] if same < len(text) else -1
        if not isinstance(node, int) and node[0] == same:
            if byte in node[1]:  # both end here: equal strings share a leaf's place
                node[1][byte] = [same + 1, {-1: node[1][byte], -2 - s: s}]
            else:
                node[1][byte] = s
            continue
        theirs = other[same] if same < len(other) else -1
        fresh = [same, {theirs: node, byte: s}] if byte != theirs else [same, {-1: node, -2 - s: s}]
        if parent is None:
            root = fresh
        else:
            parent[1][edge] = fresh
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple[list | int, int]] = [(root, 0)]
    while stack:
        node, with_last = stack.pop()
        if isinstance(node, int):
            order.append(node)
            lcp.append(min(with_last, len(strings[node])))
            continue
        children = sorted(node[1].items())
        depth = node[0]
        stack.extend((child, depth if i else with_last) for i, (_, child) in reversed(list(enumerate(children))))
    return order, lcp


def deep_shallow_sort(strings: list[bytes], group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``strings``, by ``group`` first, and the common prefix of each with its forerunner in its group.

    The multikey sort goes down by eight bytes at a time and parts all groups of one depth together, to ``SHALLOW``
    bytes; strings that still agree go through a blind trie, equal ones as one.
    """
    n = len(strings)
    words = np.frombuffer(b"".join([s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings]), ">u8").reshape(n, -1).astype(np.uint64)
    size = np.fromiter(map(len, strings), np.int64, n)
    group = np.zeros(n, np.int64) if group is None else group
    order = np.argsort(group, kind="stable")
    group = group[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])  # where a group starts
    lcp = np.zeros(n, np.int64)
    at = np.arange(n)  # places whose group has more than one string
    for depth in range(words.shape[1] + 1):
        edge = np.append(first[at], True) if len(at) else np.ones(1, bool)
        at = at[~(edge[:-1] & edge[1:])]
        if not len(at) or depth == words.shape[1]:
            break
        which = np.cumsum(first[at])
        key = words[order[at], depth]
        by = np.lexsort((key, which))
        order[at] = order[at][by]
        key = key[by]
        parts = np.flatnonzero((key[1:] != key[:-1]) & ~first[at[1:]]) + 1
        x = key[parts] ^ key[parts - 1]
        equal = np.zeros(len(parts), np.int64)
        for byte in range(1, 8):
            equal += x >> _U(64 - 8 * byte) == 0
        lcp[at[parts]] = 8 * depth + equal
        first[at[parts]] = True
    edges = at[first[at]].tolist()
    ends = np.flatnonzero(np.append(first, True))
    for lo, hi in zip(edges, ends[np.searchsorted(ends, edges, "right")].tolist()):
        same: dict[bytes, list[int]] = {}
        for i in order[lo:hi].tolist():
            same.setdefault(strings[i], []).append(i)
        o, c = _blind_trie(strings, [v[0] for v in same.values()])
        place = lo
        for i, common in zip(o, c):
            equals = same[strings[i]]
            order[place : place + len(equals)] = equals
            if place > lo:
                lcp[place] = common
            lcp[place + 1 : place + len(equals)] = len(strings[i])
            place += len(equals)
    shorter = np.minimum(size[order[1:]], size[order[:-1]])  # what was filled up with zeros counts no further
    lcp[1:] = np.minimum(lcp[1:], shorter)
    return order, lcp


def _least_between(lcp: np.ndarray) -> np.ndarray:
    """The common prefix of any two strings of a suffix array (of each with itself: 0)."""
    m = len(lcp)
    ahead = np.where(np.tri(m, k=0, dtype=bool), np.int16(32767), lcp.astype(np.int16))
    ahead = np.minimum.accumulate(ahead, 1)
    ahead[np.tri(m, k=0, dtype=bool)] = 0
    return ahead + ahead.T


def repeats(left: list[bytes], right: list[bytes], gram: np.ndarray, rule: Rule) -> list[tuple[np.ndarray, np.ndarray]]:
    """How many bytes left of and right of its gram each anchor's longest repeats reach (-1: no repeat is long enough),
    for each of the rule's windows.

    ``left``: the bytes before the anchor, backwards; ``right``: those behind its gram; ``gram``: a number for each gram.
    """
    n, side = len(right), rule.side
    sides = [w - rule.k for w in rule.windows]
    reach = [(np.full(n, -1, np.int64), np.full(n, -1, np.int64)) for _ in sides]
    order, lcp = deep_shallow_sort(right, gram)
    left_order, left_lcp = deep_shallow_sort(left, gram)
    edges = np.flatnonzero(np.diff(gram[order], prepend=gram[order[0]] - 1 if n else 0))
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), n]):
        m = hi - lo
        if m < 2:
            continue
        group = order[lo:hi]
        ahead = np.minimum(lcp[lo:hi], side)
        if m <= FEW:
            group, ahead = group.tolist(), ahead.tolist()
            for i in range(m):
                r = side
                for j in range(i + 1, m):
                    r = min(r, ahead[j])
                    x, y = group[i], group[j]
                    s = min(side, _common(left[x], left[y]))
                    for need, (reach_l, reach_r) in zip(sides, reach):
                        if s + r >= need:
                            for z in (x, y):
                                reach_l[z], reach_r[z] = max(reach_l[z], s), max(reach_r[z], r)
            continue
        behind, rank = np.minimum(left_lcp[lo:hi], side), np.empty(m, np.int64)
        by = np.argsort(group)
        rank[by[np.searchsorted(group, left_order[lo:hi], sorter=by)]] = np.arange(m)  # where each stands from the left
        if m <= MANY:
            r, s = _least_between(ahead), _least_between(behind)[rank][:, rank]
            both = r + s
            np.fill_diagonal(both, -1)
            for need, (reach_l, reach_r) in zip(sides, reach):
                fits = both >= need
                reach_l[group] = np.where(fits, s, np.int16(-1)).max(1)
                reach_r[group] = np.where(fits, r, np.int16(-1)).max(1)
            continue
        right_len = np.array([len(right[g]) for g in group])
        left_len = np.array([len(left[g]) for g in group])
        for need, (reach_l, reach_r) in zip(sides, reach):
            for a in range(need + 1):
                right_class = np.cumsum(np.concatenate([[0], ahead[1:] < need - a]))
                left_class = np.cumsum(np.concatenate([[0], behind[1:] < a]))[rank]
                fits = np.flatnonzero((left_len >= a) & (right_len >= need - a))
                key = right_class[fits] * (m + 1) + left_class[fits]
                _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
                hit = group[fits[count[inverse] > 1]]
                reach_l[hit] = a
                reach_r[hit] = np.maximum(reach_r[hit], need - a)
    return reach


def _classify(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by hash and surroundings: those that repeat, with role 0 (settled), 1 (settled, and a witness
    for the rest of its hash) or 2 (open). What is carried from batch to batch is one anchor for each surroundings of one hash."""
    rest = [np.zeros(0, np.int64)] * 7

    def rows(cols: list[np.ndarray], role: np.ndarray, keep: np.ndarray, span: bool = False) -> pa.RecordBatch:
        did, th, pos, h, c1 = (c[keep] for c in cols[:5])
        lo, hi = (pos, c1) if span else (np.maximum(pos - rule.side, 0), pos + rule.match)
        return pa.RecordBatch.from_pydict({"did": did, "th": th, "lo": lo, "hi": hi, "pos": pos, "h": h, "role": role[keep].astype(np.int8)})

    def decide(cols: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        _, _, _, h, c1, c2, kind = cols
        n = len(h)
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]))
        size = np.diff(np.append(first, n))
        settled = (size > 1) | (np.maximum.reduceat(kind, first) == _TWICE)
        hash_of = h[first]
        group = np.cumsum(np.concatenate([[True], hash_of[1:] != hash_of[:-1]])) - 1
        several = np.bincount(group)[group] > 1
        open_end = (group == group[-1]) & (not last)
        role = np.full(n, -1)
        role[np.repeat(settled, size)] = 0
        role[first] = np.where(open_end, -1, np.where(several, np.where(settled, 1, 2), np.where(settled, 0, -1)))
        carry = first[open_end]
        return rows(cols, role, role >= 0), [*(c[carry] for c in cols[:6]), np.where(settled[open_end], _TWICE, _ONCE)]

    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(7)]
        span = cols[6] == _SPAN
        if span.any():
            yield rows(cols, np.zeros(len(span), np.int64), span, True)
        cols = [np.concatenate([r, c[~span]]) for r, c in zip(rest, cols)]
        if len(cols[0]):
            out, rest = decide(cols, False)
            if out.num_rows:
                yield out
    if len(rest[0]):
        out, _ = decide(rest, True)
        if out.num_rows:
            yield out


class _Keys:
    """A fixed-size Bloom filter of text hashes: spares texts without a repeat the shuffle, decides nothing."""

    BITS = 1 << 25

    def __init__(self, wanted: DataFrame) -> None:
        bit = F.col("th").bitwiseAND(F.lit(self.BITS - 1))
        words = wanted.select(F.shiftrightunsigned(bit, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        table = np.zeros(self.BITS // 64, np.int64)
        table[words.column("w").to_numpy()] = words.column("b").to_numpy()
        self.table = wanted.sparkSession.sparkContext.broadcast(table)

    def among(self, docs: DataFrame) -> DataFrame:
        """The rows of (did, th, text) whose text may be wanted."""
        table = self.table

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = batch.column(1).to_numpy() & (self_bits - 1)
                yield batch.filter(pa.array(table.value[bit >> 6] >> (bit & 63) & 1 == 1))

        self_bits = self.BITS
        return docs.mapInArrow(tidied(run), "did long, th long, text binary")


def _key(docs: DataFrame, doc_id: str, text: str) -> tuple[F.Column, F.Column, F.Column]:
    """What a text goes by (its id and a hash), and the text. Ids that are no whole numbers go by a hash: with the text's, rows of one key are copies."""
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = isinstance(docs.schema[doc_id].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    did = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL)) if plain else F.xxhash64(F.col(doc_id))
    return did, F.xxhash64(whole), whole


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    did, th, whole = _key(docs, doc_id, text)
    return docs.select(did.alias("did"), th.alias("th"), whole.cast("binary").alias("text"))


def _span_rows(did: np.ndarray, th: np.ndarray, who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Settled spans as rows that are dealt evenly."""
    key = (th[who].view(np.uint64) ^ (lo.astype(np.uint64) * np.uint64(_ODD))).view(np.int64)
    return pa.RecordBatch.from_pydict({"did": did[who], "th": th[who], "pos": lo, "h": key, "c1": hi, "c2": np.zeros(len(who), np.int64), "kind": np.full(len(who), _SPAN)})


def _thin_runs(who: np.ndarray, pos: np.ndarray, h: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Thins the anchors of periodic runs: which anchors stay, and the runs' settled spans (text, lo, hi).

    Anchors with one hash at equal gaps d of a gram's length at most lie in text of period d. If the run is long enough, a window
    strictly inside recurs d bytes to its left or right; one that is not holds the run's first or last anchor. So those two
    stay, with two from the middle whose surroundings lie in the run and stand for all windows inside, here and elsewhere.
    """
    n = len(who)
    gap = np.where((np.diff(who) == 0) & (np.diff(h.view(np.int64)) == 0), np.diff(pos), 0) if n > 1 else np.zeros(0, np.int64)
    gap = np.where(gap <= rule.k, gap, 0)
    keep, runs = np.ones(n, bool), []
    edges = np.flatnonzero(np.concatenate([[True], gap[1:] != gap[:-1], [True]])) if len(gap) else np.zeros(0, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        d = int(gap[a]) if a < len(gap) else 0
        if d and int(pos[b] - pos[a]) + rule.k >= rule.match + rule.side + 2 * d:
            m = (a + b) // 2
            keep[a + 1 : b] = False
            keep[[m, m + 1]] = True
            runs.append((who[a], pos[a] + 1, pos[b] + rule.k - 1))
    return keep, np.array(runs, np.int64).reshape(-1, 3)


def _find_anchors(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each text. Those of one batch with equal surroundings are settled here: one stands for all, and the
    bytes around them come as spans (pos, c1), so that what many texts share deals out one row a batch under its hash."""
    for batch in batches:
        who, pos, h, around = anchors(batch.column(2).to_pylist(), rule)
        if not len(who):
            continue
        did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keep, runs = _thin_runs(who, pos, h, rule)
        if len(runs):
            yield _span_rows(did, th, *runs.T)
            who, pos, h, around = who[keep], pos[keep], h[keep], around[keep]
        c1, c2 = around[:, 0].view(np.int64), around[:, 1].view(np.int64)
        order = np.lexsort((pos, who, c2, c1, h))
        new = np.concatenate([[True], (np.diff(h[order].view(np.int64)) != 0) | (np.diff(c1[order]) != 0) | (np.diff(c2[order]) != 0)])
        first = np.flatnonzero(new)
        several = np.repeat(np.diff(np.append(first, len(order))) > 1, np.diff(np.append(first, len(order))))
        lead = order[first]
        kind = np.where(several[first], _TWICE, _ONCE)
        yield pa.RecordBatch.from_pydict({"did": did[who[lead]], "th": th[who[lead]], "pos": pos[lead], "h": h[lead].view(np.int64), "c1": c1[lead], "c2": c2[lead], "kind": kind})
        if several.any():
            members = np.sort(order[several])  # by text and position
            w, lo, hi = who[members], np.maximum(pos[members] - rule.side, 0), pos[members] + rule.match
            cut = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (lo[1:] > hi[:-1])]))
            end = np.append(cut[1:], len(w)) - 1
            yield _span_rows(did, th, w[cut], lo[cut], hi[end])


def _surroundings(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {"did": [], "th": [], "pos": [], "h": [], "before": [], "after": [], "gram": []}
        for did, th, text, wants in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for want in wants:
                p = want["pos"]
                rows["did"].append(did)
                rows["th"].append(th)
                rows["pos"].append(p)
                rows["h"].append(want["h"])
                rows["before"].append(text[max(0, p - rule.side) : p][::-1])
                rows["after"].append(text[p + rule.k : p + rule.match])
                rows["gram"].append(xxhash.xxh3_64_intdigest(text[p : p + rule.k]) - (1 << 63))
            if len(rows["pos"]) > 20_000:
                yield pa.RecordBatch.from_pydict(rows)
                rows = {k: [] for k in rows}
        if rows["pos"]:
            yield pa.RecordBatch.from_pydict(rows)


def _parts(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each wanted anchor: for each window length and part, a hash of the bytes that all its windows share."""
    for batch in batches:
        rows: dict[str, list] = {"did": [], "th": [], "pos": [], "key": []}
        for did, th, text, wants in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for p in sorted({w["pos"] for w in wants}):
                for window in rule.windows:
                    room = window - rule.k
                    steps = [room * i // PARTS for i in range(PARTS)] + [room + 1]
                    for i, (a, b) in enumerate(zip(steps, steps[1:])):  # a to b - 1 bytes to the left
                        lo, hi = p - a, p + rule.k + room - (b - 1)
                        if lo >= 0 and hi <= len(text):
                            rows["did"].append(did)
                            rows["th"].append(th)
                            rows["pos"].append(p)
                            rows["key"].append(xxhash.xxh3_64_intdigest(text[lo:hi], window * PARTS + i) - (1 << 63))
        if rows["pos"]:
            yield pa.RecordBatch.from_pydict(rows)


def _window_hashes(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows through each wanted anchor, once for each text; ``level``: which of the rule's lengths."""
    for batch in batches:
        for did, th, text, wants in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for level, window in enumerate(rule.windows):
                starts = sorted({s for w in wants for s in range(max(0, w["pos"] - window + rule.k), min(w["pos"], len(text) - window) + 1)})
                if starts:
                    d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[s : s + window]) for s in starts), np.int64).reshape(-1, 2)
                    n = len(starts)
                    yield pa.RecordBatch.from_pydict({"did": [did] * n, "th": [th] * n, "lo": starts, "hi": [s + window for s in starts], "level": pa.array([level] * n, pa.int8()), "w1": d[:, 0], "w2": d[:, 1]})


def _sort_groups(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of runs of whole hash groups and gives the ranges that repeat."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def ranges(table: pa.Table) -> Iterator[pa.RecordBatch]:
        did, th, pos = (table.column(c).to_numpy() for c in ("did", "th", "pos"))
        _, once = np.unique(np.rec.fromarrays([did, th, pos]), return_index=True)  # an anchor under several keys is one string
        table, did, th, pos = table.take(once), did[once], th[once], pos[once]
        for level, (reach_l, reach_r) in enumerate(repeats(table.column("before").to_pylist(), table.column("after").to_pylist(), table.column("gram").to_numpy(), rule)):
            hit = reach_l >= 0
            yield pa.RecordBatch.from_pydict({"did": did[hit], "th": th[hit], "lo": (pos - reach_l)[hit], "hi": (pos + rule.k + reach_r)[hit], "level": np.full(int(hit.sum()), level, np.int8)})

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 30_000:
            continue
        table = pa.Table.from_batches(held)
        h = table.column("h").to_numpy()
        end = int(np.searchsorted(h, h[-1]))
        if end:
            yield from ranges(table.slice(0, end))
        held, rows = table.slice(end).to_batches(), table.num_rows - end
    if rows:
        yield from ranges(pa.Table.from_batches(held))


def repeated_ranges(docs: DataFrame, rule: Rule, hot: int | None = None, vast: int | None = None) -> DataFrame:
    """(did, th, lo long, hi long, level tinyint) over keyed texts: together all bytes that a window of the rule's
    length number ``level`` covers (one that a longer window covers counts for the shorter too); ranges may overlap and
    pass a text's ends. A settled range holds no window if the text is shorter than one."""
    hot, vast = HOT if hot is None else hot, VAST if vast is None else vast
    found = docs.mapInArrow(tidied(partial(_find_anchors, rule)), "did long, th long, pos long, h long, c1 long, c2 long, kind long")
    marks = materialize(found.repartition("h").sortWithinPartitions("h", "c1", "c2").mapInArrow(tidied(partial(_classify, rule)), "did long, th long, lo long, hi long, pos long, h long, role tinyint"), "repeats")
    settled = marks.where("role < 2").select("did", "th", "lo", "hi", F.lit(0).cast("tinyint").alias("level"))
    open_ = marks.where("role > 0").select("did", "th", "pos", "h")
    large = materialize(open_.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h"), "hot")
    any_large = large.limit(1).count() > 0
    texts = _Keys(open_).among(docs)
    kind = "did long, th long, lo long, hi long, level tinyint"

    def with_text(part: DataFrame) -> DataFrame:
        wants = part.groupBy("did", "th").agg(F.collect_list(F.struct("pos", "h")).alias("wants"))
        return texts.join(wants, ["did", "th"]).select("did", "th", "text", "wants")

    sorted_, out = open_, settled
    if any_large:
        sorted_ = open_.join(large, "h", "left_anti")
        parts = materialize(with_text(open_.join(large, "h", "left_semi")).mapInArrow(tidied(partial(_parts, rule)), "did long, th long, pos long, key long"), "parts")
        keys = materialize(parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "part-keys")
        few, many = (parts.join(keys.where(c), "key", "left_semi").select("did", "th", "pos", F.col("key").alias("h")) for c in (F.col("n") <= vast, F.col("n") > vast))
        sorted_ = sorted_.unionByName(few)
        if keys.where(F.col("n") > vast).limit(1).count():
            windows = with_text(many).mapInArrow(tidied(partial(_window_hashes, rule)), f"{kind}, w1 long, w2 long")
            windows = materialize(windows, "windows")
            again = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
            out = out.union(windows.join(again, ["w1", "w2"], "left_semi").select("did", "th", "lo", "hi", "level"))
    around = with_text(sorted_).mapInArrow(tidied(partial(_surroundings, rule)), "did long, th long, pos long, h long, before binary, after binary, gram long")
    out = out.union(around.repartition("h").sortWithinPartitions("h").mapInArrow(tidied(partial(_sort_groups, rule)), kind))
    return materialize(out, "ranges")


def _spans(ranges: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The maximal runs that ranges cover in a text of ``n`` bytes."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        lo, hi = max(0, lo), min(n, hi)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        elif lo < hi:
            out.append((lo, hi))
    return out


def _cut(rule: Rule, passages_go: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {"n_removed": [], "n_spans": [], "n_passages": [], "n_passage_words": [], "kept": []}
        for text, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            spans = _spans([(r["lo"], r["hi"]) for r in ranges if r["level"] == 0], len(text)) if len(text) >= rule.match else []
            words = 0
            passages: list[tuple[int, int]] = []
            if len(rule.windows) > 1:
                for lo, hi in _spans([(r["lo"], r["hi"]) for r in ranges], len(text)):
                    if (n := len(text[lo:hi].split())) >= rule.words:
                        passages.append((lo, hi))
                        words += n
            if passages_go:
                spans = _spans(spans + passages, len(text))
            ends = [0, *(x for span in spans for x in span), len(text)]
            rows["n_removed"].append(sum(hi - lo for lo, hi in spans))
            rows["n_spans"].append(len(spans))
            rows["n_passages"].append(len(passages))
            rows["n_passage_words"].append(words)
            rows["kept"].append(b"".join(text[lo:hi] for lo, hi in zip(ends[::2], ends[1::2])))
        yield pa.RecordBatch.from_pydict({"did": batch.column(0), "th": batch.column(1)} | rows)


def remove_repeats(docs: DataFrame, rule: Rule = Rule(), passages_go: bool = False, doc_id: str = "doc_id", text: str = "text", hot: int | None = None, vast: int | None = None) -> DataFrame:
    """One row for each text that repeats: did, th (its key), n_removed, n_spans, n_passages, n_passage_words long, kept
    binary. The passages go too if ``passages_go``, else they are counted only."""
    keyed = _keyed(docs, doc_id, text)
    ranges = repeated_ranges(keyed, rule, hot, vast)
    by_text = ranges.groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi", "level")).alias("ranges"))
    texts = _Keys(ranges).among(keyed).dropDuplicates(["did", "th"])  # dealt as the join below deals them
    kind = "did long, th long, n_removed long, n_spans long, n_passages long, n_passage_words long, kept binary"
    return texts.join(by_text, ["did", "th"]).select("did", "th", "text", "ranges").mapInArrow(tidied(partial(_cut, rule, passages_go)), kind)


def digest(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text", hot: int | None = None, vast: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes), n_passages and n_passage_words for every row."""
    did, th, whole = _key(docs, doc_id, text)
    base = docs.select(F.col(doc_id).alias("doc_id"), did.alias("did"), th.alias("th"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole.cast("binary"), 256).alias("sha"))
    counts = ["n_removed", "n_spans", "n_passages", "n_passage_words"]
    cut = remove_repeats(docs, rule, False, doc_id, text, hot, vast).select("did", "th", *counts, F.sha2("kept", 256).alias("kept_sha"))
    count = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts}
    return base.join(cut, ["did", "th"], "left").select(
        "doc_id", "n_bytes", count["n_removed"], count["n_spans"], F.coalesce("kept_sha", "sha").alias("kept_sha256"), count["n_passages"], count["n_passage_words"]
    )


def without_repeats(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with their texts less the repeats and, if the rule has words, the passages; bytes of characters that a cut has split go too. Null texts stay null."""
    did, th, kept = unused(docs, "did", "th", "kept")
    by_id, by_text, _ = _key(docs, doc_id, text)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.decode("utf-8", "ignore") for b in batch.column(2).to_pylist()], pa.string())], names=["did", "th", "kept"])

    cut = remove_repeats(docs, rule, True, doc_id, text).where("n_removed > 0").select("did", "th", "kept")
    cut = materialize(cut.mapInArrow(tidied(decode), "did long, th long, kept string"), "cut-texts").toDF(did, th, kept)
    keyed = docs.withColumns({did: by_id, th: by_text})
    changed = F.coalesce(F.col(kept), F.col(text))
    if cut.count() > BROADCAST_ROWS:
        return keyed.join(cut, [did, th], "left").withColumn(text, changed).select(*docs.columns)
    keys = F.broadcast(cut.select(did, th))  # so few keys need not move the texts that stay whole
    moved = keyed.join(keys, [did, th], "left_semi").join(cut, [did, th]).withColumn(text, changed)
    return keyed.join(keys, [did, th], "left_anti").select(*docs.columns).unionByName(moved.select(*docs.columns))
