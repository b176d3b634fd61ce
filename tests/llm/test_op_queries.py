"""The registered queries on a tiny folder of tables: contracts, folds and edge rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")
llm = pytest.importorskip("orrery.llm.queries")


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(31)
    pools = {"xx": ["".join(rng.choices("abcde", k=5)) for _ in range(60)], "yy": ["".join(rng.choices("vwxyz", k=5)) for _ in range(60)]}
    docs = []
    for i in range(120):
        lang = rng.choice(["xx", "yy"])
        text = " ".join(rng.choices(pools[lang], k=rng.randrange(20, 90)))
        if i % 4 == 0:
            text += " horrid thing"
        docs.append((i, text, lang, None, len(text)))
    item = " ".join(f"exam{k}" for k in range(14))
    passage = " ".join(f"shared{k}" for k in range(80))
    docs += [(200, docs[3][1], "xx", None, 1), (201, f"a {item} b", None, None, 1), (202, f"one {passage}", "xx", None, 1), (203, f"{passage} two", "xx", None, 1), (204, None, None, None, None), (205, "", "xx", None, 0), (206, "12 34", "xx", None, 5), (None, "a b c", "xx", None, 5)]
    folder = str(tmp_path_factory.mktemp("tables"))

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")

    put("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    put("labels", [(i, 1, int(i % 4 == 0)) for i in range(120)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    put("benchmark", [(7, item), (8, "exam1 exam2"), (9, None)], "item_id long, text string")
    put("embeddings", [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, 0.0, 0.0], 1), (7, [2.0, 0.0, 0.1], 1)], "vec_id long, embedding array<float>, label int")
    put("conversations", [(1, 0, "user", "hi <b>"), (1, 1, "assistant", "[INST] & </s>"), (1, 2, "assistant", None), (2, 0, "system", "be kind")], "conv_id long, turn long, role string, text string")
    return folder, {d[0]: d for d in docs}


def run(spark, tables, name):
    rows = llm.queries()[name](spark, tables[0]).collect()
    return {r[0]: r for r in rows}, rows


def test_op1(spark, tables):
    got, rows = run(spark, tables, "op1_language_id")
    assert len(rows) == len(tables[1]) and rows[0].__fields__[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert all(r["held_out"] == (i is not None and crc(i) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert got[204]["lang_pred"] == got[205]["lang_pred"] == got[206]["lang_pred"] == "und"
    assert all(got[i]["lang_pred"] == tables[1][i][2] for i in range(120) if got[i]["held_out"])


def test_op2(spark, tables):
    got, rows = run(spark, tables, "op2_simhash")
    assert len(rows) == len(tables[1]) and got[200]["component_id"] == got[3]["component_id"] == 3 and got[200]["fingerprint"] == got[3]["fingerprint"]
    assert got[204]["fingerprint"] == got[205]["fingerprint"] == "0" * 16 and got[204]["component_id"] == got[205]["component_id"]


def test_op3(spark, tables):
    got, _ = run(spark, tables, "op3_decontamination")
    assert got[201]["n_hit"] == 14 and got[201]["n_items"] == 2 and got[201]["contaminated"] and got[201]["items_sha256"] == hashlib.sha256(b"7,8").hexdigest()
    assert not any(r["contaminated"] for i, r in got.items() if i != 201) and got[204]["n_words"] == 0


def test_op4(spark, tables):
    got, _ = run(spark, tables, "op4_embedding_dedup")
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (1, 6, True), 7: (1, 6, False)}


def test_op5(spark, tables):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got, _ = run(spark, tables, "op5_sentencepiece")
    assert all(r["ids"] == library.encode(tables[1][i][1] or "") for i, r in got.items())


def test_op6(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, _ = run(spark, tables, "op6_token_counts")
    for i, r in got.items():
        text = tables[1][i][1] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n := len(library.encode(text, add_special_tokens=False)), n > 1024)


def test_op7(spark, tables):
    got, rows = run(spark, tables, "op7_toxicity")
    assert len(rows) == len(tables[1]) and all(r["held_out"] == (i is not None and crc(i) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [i for i in range(120) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.8 * len(held)


def test_op8(spark, tables):
    got, _ = run(spark, tables, "op8_lm_scores")
    tokens = {i: [*(d[1] or "").lower().split(), "\0end"] for i, d in tables[1].items()}
    count = Counter(t for i, ts in tokens.items() if i is None or crc(i) % 5 != 1 for t in ts)
    total, kinds = sum(count.values()), len(count)
    for i, r in got.items():
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens[i])
        assert r["held_out"] == (i is not None and crc(i) % 5 == 1) and r["train_tokens"] == total and r["n_tokens"] == len(tokens[i])
        assert r["n_known"] == sum(count[t] > 0 for t in tokens[i]) and abs(r["base_score"] - base) < 1e-6 and r["score"] <= 0


def test_op9(spark, tables):
    got, _ = run(spark, tables, "op9_chat_format")
    assert set(got) == {1, 2, -7} and [got[i]["n_turns"] for i in (1, 2, -7)] == [3, 1, 2]
    assert got[-7]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest() and got[2]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi <b>\nassistant\n[INST] & </s>\nassistant\n\n").hexdigest() and got[1]["loss_chars"] == len("[INST] & </s>")


def test_op10(spark, tables):
    got, _ = run(spark, tables, "op10_suffix_dedup")
    passage = " ".join(f"shared{k}" for k in range(80))
    assert got[202]["n_removed"] == got[203]["n_removed"] == len(passage) and got[202]["kept_sha256"] == hashlib.sha256(b"one ").hexdigest()
    assert got[202]["n_passages"] == 1 and got[202]["n_passage_words"] == 80 and got[204]["n_bytes"] == 0
    assert got[7]["n_removed"] == got[7]["n_passages"] == 0


def test_ids_that_cannot_name_components(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(ValueError, match="whole numbers"):
        llm.simhash.near_duplicates(docs)


def test_columns_with_clashing_names(spark):
    names = ["gone", "doc", "th", "did", "kept"]
    docs = spark.createDataFrame([(1, "a b c", *names), (2, "a b c", *names), (3, None, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, "q r s")], "item_id long, text string")
    for out in (llm.simhash.one_of_each(docs), llm.decontam.clean(docs, items), llm.suffix.without_repeats(docs)):
        assert out.columns == docs.columns and all(tuple(r)[2:] == tuple(names) for r in out.collect())
    assert llm.decontam.clean(docs, items).count() == 3 and llm.simhash.one_of_each(docs).count() == 2
