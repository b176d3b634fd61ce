"""The corpus operators against brute force, round trips and held-out accuracy, on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

P = pytest.importorskip("public_tokenizers")
llm = pytest.importorskip("orrery.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from orrery.llm import chat, common, decontam, embed, langid, lm, pieces, simhash, suffix, tokcount, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, k0 string"


def docs_of(spark, texts, langs=None):
    langs = langs or [None] * len(texts)
    return spark.createDataFrame([(i, t, g, None, None, 0.5, "clash") for i, (t, g) in enumerate(zip(texts, langs))], DOCS)


def union_find(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


EDGES = [None, "", "   ", "...", "a", "é", "x " * 40_000, "same text here now", "same text here now"]


# --- shared


def test_components_match_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 540)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = union_find(600, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: label[x] for x in linked}


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1


def test_language_profiles_equal_plain_bundles():
    text = "Der Hund, Ünd 12 hé\n" * 3
    words = re.findall(r"[^\W\d_]+", text.lower())
    want = np.zeros(langid.DIM)
    for w in words:
        s = [0, *map(ord, w), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            want += np.roll(langid.letter_vector(a), 2) * np.roll(langid.letter_vector(b), 1) * langid.letter_vector(c)
    assert np.allclose(langid.bundle([text, None, ""])[0], want)


def test_language_profiles_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(["alpha", "βeta", "gamma"]) for _ in range(500))
    whole = langid.bundle([text, "short one", text])
    monkeypatch.setattr(langid, "_PIECE", 97)
    assert np.allclose(langid.bundle([text, "short one", text]), whole)


def test_language_id(spark):
    words = {"aa": ["the", "house", "with", "thing"], "bb": ["der", "haus", "mit", "schön"]}
    rng = random.Random(2)
    texts = [" ".join(rng.choices(words[g], k=20)) for g in ("aa", "bb") * 15]
    langs = ["aa", "bb"] * 15
    docs = docs_of(spark, [*texts, *EDGES], [*langs, *[None] * len(EDGES)])
    got = {r["doc_id"]: r for r in langid.identify(docs, docs, ["doc_id"]).collect()}
    assert len(got) == len(texts) + len(EDGES)
    assert all(got[i]["lang_pred"] == g for i, g in enumerate(langs))
    for i, t in enumerate(EDGES, len(texts)):
        letters = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (not letters) and 0 <= got[i]["score"] <= 1
    kept = langid.accept(docs, docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(30))


def test_language_id_rejects_languages_never_learnt(spark):
    rng = random.Random(6)

    def language(alphabet):
        words = ["".join(rng.choices(alphabet, k=rng.randint(2, 8))) for _ in range(150)]
        return lambda k: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(150)], k=k))

    latin = "etaoinshrdlu"
    own = [language(latin), language(latin)]
    foreign = [language([chr(c) for c in range(a, b)]) for a, b in ((0x430, 0x450), (0x3B1, 0x3CA), (0x627, 0x648), (0xE01, 0xE2E), (0x5D0, 0x5EB), (0x4E00, 0x4F00))] + [language(latin)]
    learnt = docs_of(spark, [own[i % 2](60) for i in range(60)], [("aa", "bb")[i % 2] for i in range(60)])
    mine = [own[i % 2](k) for i in range(20) for k in (20, 60, 200)]
    strange = [f(k) for f in foreign for k in (1, 5, 20, 60, 200) for _ in range(8)]
    strange += ["Все люди рождаются свободными и равными", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", *EDGES[:4]]
    kept = {r["doc_id"] for r in langid.accept(docs_of(spark, mine + strange), learnt).collect()}
    assert kept == set(range(len(mine)))
    assert langid.accept(learnt, learnt).count() == 60 and langid.accept(learnt, learnt.limit(0)).count() == 0


def test_language_id_without_training(spark):
    docs = docs_of(spark, ["some text", None])
    assert [tuple(r) for r in langid.identify(docs, docs, ["doc_id"]).orderBy("doc_id").collect()] == [(0, "und", 0.0), (1, "und", 0.0)]
    assert langid.identify(docs.limit(0), docs.limit(0), ["doc_id"]).count() == 0


# --- 2


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints():
    rng = random.Random(3)
    for _ in range(60):
        t = "".join(rng.choice("ab CÉ\n\x0b ") for _ in range(rng.randrange(60)))
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    for t in EDGES:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_trie_components_match_all_pairs():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([centres, *[c ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for c in centres[:20]]]))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    assert np.array_equal(simhash.trie_components(x, 4), common.min_labels(len(x), i, j))


@pytest.mark.parametrize("deal", [1 << 16, 8])
def test_simhash_groups(spark, monkeypatch, deal):
    monkeypatch.setattr(simhash, "_DEAL", deal)
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(150)) for _ in range(12)]
    texts = [*EDGES]
    for b in base:
        for _ in range(rng.randrange(1, 9)):
            w = b.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    fp = [slow_fingerprint(t) for t in texts]
    n = len(texts)
    label = union_find(n, [(a, b) for a in range(n) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fp[i]:016x}", label[i]) for i in range(n)}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(label)
    assert simhash.one_of_each(docs.union(docs)).count() == len(set(label))


def test_simhash_block_choices():
    for n in (10, 10**6, 10**9):
        choices = simhash._deals(n, 4)
        blocks = sorted({b for c in choices for b in c})
        assert sum(w for _, w in blocks) == 64
        for hit in ([0, 1, 2, 3], [60, 61, 62, 63], [0, 20, 40, 63]):  # some choice avoids any four bits
            assert any(all(not s <= b < s + w for b in hit for s, w in c) for c in choices)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0


# --- 3


def slow_decontam(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    sizes = {len(k) for k in wins}
    out = []
    for t in texts:
        w = words(t)
        hit, ids = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    ids |= wins[k]
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark):
    rng = random.Random(7)
    vocabulary = ["the", "of", "cat", "dog", "ü", "x1", "Zebra", "rare"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 30])))) for i in range(14)] + [(3, "twice the same id of it"), (50, None), (51, "!!"), (52, "the"), (53, "never seen anywhere at all"), (54, "of " * 14)]
    texts = [*EDGES]
    for _ in range(60):
        t = [rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(25))) for _ in range(2)]
        texts.append(f"{t[0]} {rng.choice(items)[1] or ''}! {t[1]}")
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    want = slow_decontam(texts, items)
    got = sorted(map(tuple, decontam.report(docs, bench).collect()))
    assert [g[1:] for g in got] == want
    assert {r["doc_id"] for r in decontam.clean(docs, bench).collect()} == {i for i, w in enumerate(want) if not w[4]}
    assert decontam.report(docs.union(docs), bench).count() == 2 * len(texts)
    assert {r["contaminated"] for r in decontam.report(docs, bench.limit(0)).collect()} == {False}
    assert decontam.report(docs.limit(0), bench).count() == 0


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [item, "alpha beta gamma x delta epsilon zeta eta theta y iota kappa", "kappa iota theta eta zeta epsilon delta gamma beta alpha", "alpha beta gamma a b c d e f delta epsilon zeta eta theta iota kappa"]
    tokens = decontam.tokenize(docs_of(spark, texts))
    found = decontam.matches(tokens, decontam.windows(spark.createDataFrame([(1, item)], "item_id long, text string")), slop=3)
    assert {(r["doc_id"], r["kind"]) for r in found.collect()} == {(0, "exact"), (0, "near"), (1, "near"), (2, "near")}


def test_proximity_of_all_windows(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.sample(vocab, k)) for k in (30, 45, 12)] + [" ".join(rng.choices(vocab, k=35)), "w1 w2 w3"]
    texts = ["", "w3 x w1 y w2", "w3 x x x w1 w2"]
    for _ in range(60):
        words = rng.choice(items[:4]).split()
        at = rng.randrange(len(words) - 9)
        part = words[at : at + 10]
        if rng.random() < 0.5:
            rng.shuffle(part)
        for _ in range(rng.randrange(5)):
            part.insert(rng.randrange(len(part)), rng.choice(["x", "y"]))
        texts.append(" ".join(rng.choices(["x", "y", *vocab], k=rng.randrange(9)) + part + rng.choices(["x", "y", *vocab], k=rng.randrange(9))))
    want = set()
    for i, text in enumerate(texts):
        t = text.split()
        for j, item in enumerate(items):
            w = item.split()
            n = min(10, len(w))
            spans = [set(t[k : k + n + 3]) for k in range(max(1, len(t) - n - 2))]
            if any(set(w[o : o + n]) <= s for o in range(len(w) - n + 1) for s in spans):
                want.add((i, j))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontam.matches(decontam.tokenize(docs_of(spark, texts)), decontam.windows(bench), slop=3).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found if r["kind"] == "near"} == want and 30 < len(want) < 70
    for r in found:
        assert 0 <= r["start"] <= r["stop"] < len(texts[r["doc_id"]].split())


# --- 4


def test_embedding_groups(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 16)
    monkeypatch.setattr(embed, "LEAF", 4)
    rng = np.random.default_rng(8)
    rows = []
    for c in rng.normal(size=(12, 16)):
        for _ in range(rng.integers(1, 9)):
            rows.append(((c + rng.normal(size=16) * 0.11) * rng.uniform(0.5, 3)).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[0]], None, [], [0.0] * 16, [float("nan"), *[1.0] * 15], [None, *[1.0] * 15], [float("inf")] * 16, [1.0, 2.0], [1.0, 2.0]]
    labels = [None if i % 23 == 5 else int(rng.integers(0, 2)) for i in range(len(rows))]
    labels[-2:] = [1, 1]
    n = len(rows)
    good = [r is not None and len(r) > 0 and all(x is not None and np.isfinite(x) for x in r) and any(r) and g is not None for r, g in zip(rows, labels)]
    links = []
    for a in range(n):
        for b in range(a):
            if good[a] and good[b] and labels[a] == labels[b] and len(rows[a]) == len(rows[b]):
                x, y = np.array(rows[a]), np.array(rows[b])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links.append((a, b))
    count = Counter(x for ab in links for x in ab)
    label = union_find(n, links)
    table = spark.createDataFrame([(i, r, g, "extra") for i, (r, g) in enumerate(zip(rows, labels))], "vec_id long, embedding array<double>, label int, g string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed.near_duplicates(table).collect()}
    assert len(links) > 30 and got == {i: (count[i], label[i], label[i] == i) for i in range(n)}
    assert embed.near_duplicates(table.limit(0)).count() == 0
    assert embed.near_duplicates(table.where("embedding is null")).count() == 1


# --- 5


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(P.path("piece_bpe_32k.model"))


TEXTS = [*EDGES, "  a  b ", "a\n\nb\t c", "héllo 日本語 🎉🎉 x", "<s> </s> <unk> [INST]", "a" * 60, "def f(x):\n    return x**2 # no\n", "ﬁ ½ 　x", "▁a▁▁b", "\u0000x"]


def test_pieces_equal_the_library(encoder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    texts = TEXTS + ["".join(rng.choice("ab cde. ()\nthe' \tхи日") for _ in range(60)) for _ in range(300)]
    for t in texts:
        ids = encoder.encode(t).tolist()
        assert ids == sp.encode(t or "") and encoder.decode(ids) == sp.decode(ids)


def test_pieces_query_and_decoding(spark):
    docs = docs_of(spark, TEXTS)
    rows = pieces.encode(docs, P.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in rows.collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i]["round_trip"] == ("▁" not in (t or "")) and got[i]["n_pieces"] == len(got[i]["ids"])
    back = {r["doc_id"]: r["text"] for r in pieces.decode(rows, P.path("piece_bpe_32k.model")).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS) if not (t or "").startswith("▁"))
    assert pieces.encode(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_unigram_weights_take_the_least_path():
    class Tiny:
        model_type, byte_fallback, unknown = 1, False, 0
        pieces, scores, kinds = ["<unk>", "a", "b", "ab", "ba", "aba"], [0, -1.0, -1.5, -1.2, -3.0, -2.9], [2, 1, 1, 1, 1, 1]

    machine = pieces.Transducer(Tiny())
    assert machine.shortest("aba") == [3, 1] and machine.shortest("xxa") == [0, 1]


# --- 6


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*EDGES, "a<|endoftext|>b <|endoftext|>", "  x\n\n  y 's 'S I'll 123abc _-_ \t\t　z", "é" * 50, "\r\n a", "it's " * 900]
    got = {r["doc_id"]: tuple(r)[1:] for r in tokcount.count_tokens(docs_of(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False))
        assert got[i] == (len((t or "").encode()), n, n > 1024)
    assert tokcount.count_tokens(docs_of(spark, texts).limit(0), path).count() == 0


def test_token_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokcount, "_CACHE", 10)
    lengths = tokcount.Lengths({"x": 1}, len)
    assert [lengths[f"{i:05}"] for i in range(100)] == [5] * 100 and len(lengths) <= 11 and lengths["x"] == 1


# --- 7


def test_ftrl_equals_the_scalar_rule():
    rng = random.Random(21)
    rows = [(np.unique(np.array([rng.randrange(40) for _ in range(rng.randrange(1, 9))], np.int32)), rng.randrange(2)) for _ in range(300)]
    model, z, n = toxicity.Ftrl(), Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for at, y in rows:
            model.learn(at, y)
            places = [*at.tolist(), toxicity.BUCKETS]
            w = {i: weight(i) for i in places}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in places:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    everywhere = np.arange(toxicity.BUCKETS + 1)
    got = model.weights(everywhere)
    assert np.allclose([got[i] for i in z], [weight(i) for i in z]) and np.count_nonzero(got) <= len(z)


def test_successors_are_sought_in_their_context():
    rng = np.random.default_rng(12)
    values = np.unique(rng.integers(0, 1 << 30, 3000, dtype=np.uint64))
    e = lm.EliasFano.build(values, 1 << 30)
    lo = rng.integers(0, len(values), 800)
    hi = np.minimum(lo + rng.integers(0, 40, 800), len(values))
    x = np.where(rng.random(800) < 0.7, values[np.minimum(lo + rng.integers(0, 45, 800), len(values) - 1)], rng.integers(0, 1 << 30, 800, dtype=np.uint64))
    want = [next((i for i in range(a, b) if values[i] == v), -1) for a, b, v in zip(lo, hi, x)]
    assert e.index(x, lo, hi).tolist() == want


def test_toxic_stems():
    a, b = toxicity.features("Grumblefoo x"), toxicity.features("grumblebar y")
    assert len(np.intersect1d(a, b)) == sum(n <= len("grumble") for n in toxicity.STEMS) and not len(toxicity.features(None))


def test_toxicity(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vile", "nasty"])
        rows.append(" ".join(words))
        labels.append((i, int(bad)))
    docs = docs_of(spark, [*rows, *EDGES])
    table = spark.createDataFrame(labels + [(9999, None), (None, 1)], "doc_id long, toxic int")
    weights = toxicity.train(docs, table.where("doc_id < 480"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, weights).collect()}
    assert len(got) == len(rows) + len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    right = sum(got[i]["predicted"] == y for i, y in labels[480:])
    assert right >= 0.9 * 120 and len(weights[0]) < 3000
    empty = toxicity.score(docs, toxicity.train(docs, table.limit(0))).collect()
    assert {r["predicted"] for r in empty} == {0}


# --- 8


def test_elias_fano():
    rng = np.random.default_rng(11)
    for n, top in ((0, 10), (1, 1), (300, 301), (5000, 1 << 40), (4000, 5000), (900, 1 << 62)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = lm.EliasFano.build(v, top)
        q = np.concatenate([v, rng.integers(0, top, 200, dtype=np.uint64)])
        assert np.array_equal(e.find(q), np.searchsorted(v, q))
        assert np.array_equal(e.index(q) >= 0, np.isin(q, v)) and (not n or np.array_equal(e.get(np.arange(n)), v))


@pytest.mark.parametrize("shard", [2_000_000, 50])
def test_lm_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(lm, "SHARD_PAIRS", shard)
    monkeypatch.setattr(lm, "SHARD_WORDS", shard)
    rng = random.Random(12)
    texts = [*EDGES, *[" ".join(rng.choice(["The", "cat", "sat", f"n{rng.randrange(200)}", "É"]) for _ in range(rng.randrange(40))) for _ in range(80)]]
    docs = docs_of(spark, texts)
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 1}
    model = lm.train(docs.where("pmod(crc32(cast(doc_id as string)), 5) <> 1"))
    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    c, b = Counter(), Counter()
    seqs = [[*(t or "").encode().lower().split(), b" "] for t in texts]
    for i, s in enumerate(seqs):
        if i not in held:
            c.update(s)
            b.update(zip([b"^", *s], s))
    total, types, k = sum(c.values()), len(c), lm.SMOOTHING
    before = Counter(c) + Counter({b"^": c[b" "]})
    for i, s in enumerate(seqs):
        p = [(c[w] + 0.5) / (total + 0.5 * (types + 1)) for w in s]
        full = sum(math.log10((b[v, w] + k * q) / (before[v] + k)) for v, w, q in zip([b"^", *s], s, p))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(s), sum(c[w] > 0 for w in s), total)
        assert abs(r["base_score"] - sum(map(math.log10, p))) < 1e-6 * len(s)
        assert full - 2.5e-4 * len(s) <= r["score"] <= full + 1e-9 * len(s)
    none = lm.score(docs, lm.train(docs.limit(0))).collect()
    assert {r["n_known"] for r in none} == {0} and lm.score(docs.limit(0), model).count() == 0


# --- 9


def test_chat_events(spark):
    events = [
        (1, 0, 0, "message", "user", "hi [INST] & </s>"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", "assistant", "Hel"), (1, 1, 3, "delta", "assistant", "lo"),
        (1, 1, 4, "regenerate", "assistant", None), (1, 1, 5, "delta", "assistant", "Good "), (1, 1, 6, "delta", "assistant", "day &lt;"), (1, 2, 7, "message", "user", "x"), (1, 2, 8, "edit", "user", "y"),
        (2, None, 0, None, None, None), (2, 0, 0, "message", "user", "same"), (2, 0, 0, "message", "user", "same"),
    ]
    table = spark.createDataFrame(events, "conv_id long, turn long, seq long, kind string, role string, text string")
    formatted = chat.format_events(table)
    got = {r["conv_id"]: r for r in formatted.withColumn("m", chat.parse(F.col("formatted"))).collect()}
    assert [tuple(m) for m in got[1]["m"]] == [("user", "hi [INST] & </s>"), ("assistant", "Good day &lt;"), ("user", "y")]
    assert [tuple(m) for m in got[2]["m"]] == [("", ""), ("user", "same"), ("user", "same")]
    for r in got.values():
        at, loss = 0, ""
        for masked, n in r["loss"]:
            loss += r["formatted"][at : at + n] if masked else ""
            at += n
        assert at == len(r["formatted"])
        assert loss.replace("&lbr;", "[").replace("&lt;", "<").replace("&amp;", "&") == "".join(m["text"] for m in r["m"] if m["role"] == "assistant")
    assert chat.digest(chat.format_events(table.limit(0))).count() == 0


def test_chat_long_conversation(spark):
    rows = spark.range(1000).selectExpr("1L as conv_id", "id as turn", "id as seq", "'message' as kind", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    r = chat.digest(chat.format_events(rows)).first()
    assert r["n_turns"] == 1000 and r["turns_sha256"] == hashlib.sha256("".join(f"{'user' if i % 2 == 0 else 'assistant'}\nt{i}\n" for i in range(1000)).encode()).hexdigest()


def test_chat_digest_reads_the_mask(spark):
    rows = spark.createDataFrame([(1, 0, 0, "message", "user", "a & b"), (1, 1, 1, "message", "assistant", "c [d]"), (1, 2, 2, "message", "user", "é")], "conv_id long, turn long, seq long, kind string, role string, text string")
    formatted = chat.format_events(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert chat.digest(formatted).first()["loss_sha256"] == sha("c [d]")
    other = formatted.withColumn("loss", F.transform("loss", lambda x, i: x.withField("masked", (i == 2) | (i == 8))))
    r = chat.digest(other).first()
    assert r["loss_sha256"] == sha("a & bé") and r["loss_chars"] == 6
    for bad in (F.slice("loss", 1, 9), F.transform("loss", lambda x, i: x.withField("chars", x["chars"] + (i == 5).cast("int")))):
        with pytest.raises(Exception, match="loss runs"):
            chat.digest(formatted.withColumn("loss", bad)).collect()


def test_chat_many_messages_of_one_turn(spark):
    want = [(turn, i) for turn, n in ((None, 70), (-1, 2), (0, 100), (1, 1), (2, 200), (3, 3), (64, 130), (65, 1)) for i in range(n)]
    events = [(1, turn, i // 2, "message", "user" if i % 3 else "assistant", f"t{turn} {i // 2:03d}") for turn, i in want]
    order = sorted(events, key=lambda e: (e[1] is not None, e[1] or 0, e[2], e[4], e[5]))
    random.Random(1).shuffle(events)
    formatted = chat.format_events(spark.createDataFrame(events, "conv_id long, turn long, seq long, kind string, role string, text string"))
    r = chat.digest(formatted).first()
    assert [tuple(m) for m in formatted.select(chat.parse(F.col("formatted"))).first()[0]] == [e[4:] for e in order]
    assert r["n_turns"] == len(want) and r["turns_sha256"] == hashlib.sha256("".join(f"{e[4]}\n{e[5]}\n" for e in order).encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256("".join(e[5] for e in order if e[4] == "assistant").encode()).hexdigest()


# --- 10


def slow_suffix(texts):
    texts = [(t or "").encode() for t in texts]

    def covered(n):
        seen = {}
        for i, t in enumerate(texts):
            for s in range(len(t) - n + 1):
                seen.setdefault(t[s : s + n], []).append((i, s))
        out = [np.zeros(len(t) + 2, bool) for t in texts]
        for v in seen.values():
            if len(v) > 1:
                for i, s in v:
                    out[i][s + 1 : s + n + 1] = True
        return out

    def runs(mask):
        step = np.diff(mask.astype(int))
        return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))

    out = []
    for t, gone, found in zip(texts, covered(400), covered(200)):
        words = [n for lo, hi in runs(found) if (n := len(t[lo:hi].split())) >= 50]
        kept = np.frombuffer(t, np.uint8)[~gone[1:-1]].tobytes()
        out.append((len(t), int(gone.sum()), len(runs(gone)), hashlib.sha256(kept).hexdigest(), len(words), sum(words)))
    return out


def planted_texts(seed, n):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("ab cdé") for _ in range(k))
    passages = [text(k) for k in (330, 399, 400, 401, 500, 900)]
    out = []
    for _ in range(n):
        t = text(rng.randrange(200))
        for _ in range(rng.randrange(3)):
            t += rng.choice(passages)[rng.choice([0, 0, 17, 60]) :] + text(rng.choice([0, 3, 90]))
        out.append(t)
    return [*out, "a" * 1000, "ab" * 700, "a" * 399, "é" * 500, "x" * 900 + "y" + "x" * 500, out[3], out[3]]


@pytest.mark.parametrize(("hot", "vast"), [(None, None), (3, None), (3, 2)])
def test_suffix_removal(spark, hot, vast):
    texts = [*planted_texts(13, 90), *[t for t in EDGES if len(t or "") < 1000], "q w " * 3000]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.digest(docs, hot=hot, vast=vast).collect()}
    assert got == dict(enumerate(slow_suffix(texts)))


def test_suffix_long_texts_and_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_SEGMENT", 1000)
    texts = [t * 3 for t in planted_texts(14, 12)]
    docs = docs_of(spark, texts)
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix.digest(docs).collect()} == dict(enumerate(slow_suffix(texts)))
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    assert suffix.digest(docs.limit(0)).count() == 0 and suffix.digest(docs.union(docs)).count() == 2 * len(texts)


@pytest.mark.parametrize(("hot", "vast"), [(None, None), (3, 2)])
def test_suffix_periodic_runs(spark, hot, vast):
    rng = random.Random(17)
    text = lambda k: "".join(rng.choice("ab cdé") for _ in range(k))
    units = ["To ", "Des. ", "xy", "q", "Is onhe. ", "a longer period of some forty bytes.. "]
    texts = []
    for _ in range(70):
        u = rng.choice(units)
        t = text(rng.randrange(250)) + u * rng.choice([20, 60, 100, 150, 300]) + text(rng.choice([0, 40, 300]))
        texts.append(t + u * rng.choice([0, 0, 70]))
    texts += [texts[3][:900], texts[4][50:], "Des. " * 300, "xDes. " + "Des. " * 200 + "y", "zz" + "q" * 1500]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.digest(docs_of(spark, texts), hot=hot, vast=vast).collect()}
    assert got == dict(enumerate(slow_suffix(texts)))


def test_suffix_common_passage_in_many_texts(spark):
    rng = random.Random(19)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    short, long = words(55), words(120)
    texts = [f"{words(40)} {short if i % 2 else long} {words(40)}" for i in range(40)] + [words(150) for _ in range(10)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.digest(docs_of(spark, texts), hot=5).collect()}
    assert got == dict(enumerate(slow_suffix(texts)))
    assert all(got[i][4] == 1 and (got[i][1] > 0) == (i % 2 == 0) for i in range(40)) and not any(got[i][4] for i in range(40, 50))


def test_suffix_passages_go(spark):
    rng = random.Random(20)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage, brief = words(55), words(42)
    rows = [("x", f"{words(30)}, {passage}", "a"), ("y", f"{passage}; {words(30)}", "b"), ("z", f"{brief}! {words(9)}", "c"), (None, f"{words(9)}? {brief}", "d"), ("n", None, "e")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, did string").withColumns({"th": F.lit(1), "kept": F.lit(2)})
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r["did"]: r["text"] for r in out.collect()}
    assert got["a"] == rows[0][1][: -len(passage)] and got["b"] == rows[1][1][len(passage) :]  # a comma and a semicolon stand beside the passage
    assert got["c"] == rows[2][1] and got["d"] == rows[3][1] and got["e"] is None


def test_deep_shallow_sort():
    rng = random.Random(15)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice([10, 40, 60]))) for _ in range(150)]
    strings += [b"c" * 150 + s for s in strings[:80]] + [b"c" * 150 + s + b"\0" for s in strings[:20]] + [b"c" * 170] * 4 + [b"", b"\0", b"c" * 150]
    order, lcp = suffix.deep_shallow_sort(strings)
    assert [strings[i] for i in order] == sorted(strings)
    for k in range(1, len(order)):
        assert lcp[k] == suffix._common(strings[order[k - 1]], strings[order[k]])


# --- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(16)
    fresh = lambda k: " ".join("".join(rng.choices("etaoinshr", k=rng.randrange(2, 9))) for _ in range(k))
    item, shared = fresh(30), fresh(120)
    clean = [fresh(100) for _ in range(12)]
    texts = [*clean, clean[0], f"{fresh(40)} {item} {fresh(40)}", f"{fresh(90)} {shared} {fresh(90)}", f"{fresh(80)} {shared} {fresh(110)}", "12345 67", None]
    docs_of(spark, texts, ["en"] * len(texts)).drop("score", "k0").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "suffix_dedup", "decontamination", "encoding"]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(12), 14, 15}
    decode = pieces.Model(P.path("piece_bpe_32k.model")).decode
    assert all(decode(got[i]["ids"]) == texts[i] for i in range(12))
    assert all(shared[50:-50] not in decode(got[i]["ids"]) and got[i]["round_trip"] for i in (14, 15))


def test_queries_are_registered():
    names = list(llm.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(llm.oracle_sql()) <= set(names)
