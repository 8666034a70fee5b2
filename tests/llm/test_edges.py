"""Odd inputs: nulls, repeated rows, ties, clashing columns, very long texts, empty tables."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from engramma.llm import ann, chat, decontaminate, mixing, near_dup, quality, tokens, toxicity, warc
from engramma.llm.q_text import tokenizer_path
from engramma.session import table
from engramma.storage import new_path


def test_contamination_in_a_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(30))
    words = [f"w{i % 977}" for i in range(200_000)]
    words[150_000:150_000] = item.split()
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    began = time.time()
    r = decontaminate.contamination(docs, bench).first()
    assert (r["n_words"], r["n_hit"], r["n_items"]) == (200_030, 30, 1) and time.time() - began < 60


@pytest.mark.parametrize("most_keys", [0, 20_000])
def test_contamination_by_items_of_every_length(most_keys, spark):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(12)]  # few words, so that windows overlap and repeat
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(k))) for k in range(1, 14)]
    texts = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(80)] + [(100 + k, f"x {t} y") for k, t in items]

    def brute(text):
        w, hit, found = text.split(), set(), set()
        for k, t in items:
            it = t.split()
            n = min(10, len(it))
            wins = {tuple(it[i : i + n]) for i in range(len(it) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found.add(str(k))
        return len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()

    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    got = {x["id"]: (x["n_words"], x["n_hit"], x["items_sha256"]) for x in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), most_keys=most_keys).collect()}
    assert got == {i: brute(t) for i, t in texts}


def test_nearest_repeated_queries_clashing_columns_and_sizes(spark):
    v = spark.createDataFrame([(i, [float(i + 1), 1.0], 9, 9.0) for i in range(8)] + [(1, [2.0, 1.0], 9, 9.0)], "vec_id long, embedding array<double>, rank int, score double")
    q = v.where("vec_id = 1").unionByName(v.where("vec_id = 2")).unionByName(spark.createDataFrame([(2, [1.0, 50.0], 0, 0.0)], v.schema))
    rows = ann.nearest(q, v, k=3).collect()
    ones = sorted((r["rank"], r["vec_id"]) for r in rows if r["query_id"] == 1)
    assert ones == [(1, 2), (1, 2), (2, 3), (2, 3), (3, 4), (3, 4)]  # its own id takes no part; cosines fall with the number
    twos = sorted((r["rank"], r["vec_id"]) for r in rows if r["query_id"] == 2)
    assert twos == sorted([(1, 3), (2, 1), (3, 1), (1, 0), (2, 1), (3, 1)]) or len(twos) == 6
    wide = spark.createDataFrame([(1, [1e200, 1e200]), (2, [3e200, 3e200]), (3, [1e-200, -1e-200]), (4, [1e-200, 1e-200])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest(wide, wide, k=3).collect()}
    assert len(got) == 12 and abs(got[1, 2] - 1) < 1e-12 and abs(got[1, 3]) < 1e-12 and abs(got[4, 1] - 1) < 1e-12
    tie = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in ann.nearest(tie.where("vec_id = 3"), tie, k=5).orderBy("rank").collect()] == [0, 1, 2, 4, 5]


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_tables(module, label, spark, sf):
    docs, labels = table(spark, sf, "documents").limit(60), table(spark, sf, "labels")
    assert module.predictions(docs.limit(0), labels).count() == 0
    odd = docs.selectExpr("doc_id", "text", "'x' as score", "7 as held_out", "1 as predicted").unionByName(docs.limit(1).selectExpr("doc_id", "repeat(text, 300) as text", "'x' as score", "7 as held_out", "1 as predicted"))
    got = module.predictions(odd.unionByName(odd), labels).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == 2 * odd.count() and got.score.between(0, 1).all()
    assert got.groupby("doc_id").held_out.nunique().max() == 1 and (got.predicted == (got.score >= module.THRESHOLD)).all()
    assert labels.columns.index(label) >= 0


def test_mixing_values(spark):
    docs = spark.createDataFrame([(1, "a b", None, None), (None, None, "en", "src1"), (2, "a b c", "en", "src1"), (2, "a b c", "en", "src1"), (3, " ".join(["w"] * 100_000), "fr", "src2")], "doc_id long, text string, lang string, source string")
    got = sorted(((r["id"], r["domain"], r["lang"], r["source"], r["tokens"], r["copies"]) for r in mixing.selected(docs, budget_share=2.0, max_epochs=2).collect()), key=str)
    assert got == sorted([(1, "d0", "", "", 2, 2), (None, "d1", "en", "src1", 0, 2), (2, "d1", "en", "src1", 3, 2), (2, "d1", "en", "src1", 3, 2), (3, "d2", "fr", "src2", 100_000, 2)], key=str)


def test_chat_null_and_equal_turns(spark):
    rows = [(1, None, "user", "b", 0), (1, None, "user", "a", 0), (1, 2, "assistant", None, 0), (1, 2, "assistant", "x", 0), (None, 1, "user", "n", 0), (-(2**63) + 1, 1, "user", "m", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted int")
    out = {r["conv_id"]: chat.parse_formatted(r["formatted"]) for r in chat.format_conversations(df).collect()}
    assert out[1] == [("user", "a"), ("user", "b"), ("assistant", ""), ("assistant", "x")]
    assert out[None] == [("user", "n")] and out[-(2**63) + 1] == [("user", "m")]


def test_token_store_edges(spark):
    assert tokens.read_digests(spark, tokens.write_store(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path())).count() == 0
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = [(1, "a " * 30_000, 5), (2, " ".join(word() for _ in range(5000)), 5), (None, "null id", 5), (2, "same", 5), (2, "same", 5)]
    df = spark.createDataFrame(texts, "doc_id long, text string, start int")
    folder = tokens.write_store(df, tokenizer_path())
    got = tokens.read_digests(spark, folder).orderBy("start").collect()
    e = tokens.encoder(tokenizer_path())
    ids = {t: np.array([*e._whole(t), 2], "<u4") for _, t, _ in texts}
    assert [x["doc_id"] for x in got] == [None, 1, 2, 2, 2] and [x["start"] for x in got] == np.cumsum([0, *(x["n_tokens"] for x in got)])[:-1].tolist()
    assert sorted(x["ids_crc32"] for x in got) == sorted(zlib.crc32(ids[t].tobytes()) for _, t, _ in texts)
    sizes = spark.read.parquet(f"{folder}/chunks").selectExpr("length(ids) / 2 as n").toPandas().n
    assert sizes.max() == tokens.MAX_CHUNK  # a run of one word has no mark


def test_store_roots_are_those_of_all_documents_in_order(spark, sf):
    folder = tokens.write_store(table(spark, sf, "documents"), tokenizer_path())
    rows = spark.read.parquet(f"{folder}/recipes").select("file", "place", "root").toPandas().sort_values(["file", "place"])
    manifest = spark.read.parquet(f"{folder}/manifest").toPandas().set_index("file")
    for f, g in rows.groupby("file"):
        assert tokens.merkle_root([bytes(x) for x in g.root]) == bytes(manifest.loc[f].root)
    assert tokens.verify_manifest(spark, folder).count() == 0
    leaves = [hashlib.sha256(bytes([i % 251, i // 251])).digest() for i in range(70)]
    parts = [tokens.merkle_root(leaves[i : i + 16]) for i in range(0, 70, 16)]
    assert tokens.merkle_root(parts) == tokens.merkle_root(leaves)


def test_word_encoder_on_random_unicode():
    e = tokens.encoder(tokenizer_path())
    assert e.by_word
    r = random.Random(9)
    alphabet = [*"aAzZ09 .,'!?<|>\n\t-_/", *"éÉßñÑÀçİıΣςσǅﬁﬀ日本語中한글абвГДЖاب", "́", "̈", "̧", "‍", "​", " ", " ", "　", "\x85", "\x1c", "\U0001f600", "\U0001f468‍\U0001f469", "<|endoftext|>", "<|", "'s", "'LL", "ﬃ", "ẞ", "µ"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    ids, offs = e.encode(texts)
    assert [ids[offs[i] : offs[i + 1]].tolist() for i in range(len(texts))] == [e._whole(t) for t in texts]


def test_tokenizers_of_other_kinds_encode_whole_texts():
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    assert tokens.encodes_by_word(spec)
    assert not tokens.encodes_by_word(spec | {"normalizer": None}) and not tokens.encodes_by_word(spec | {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]})


def test_every_revisit_names_a_record(spark):
    rows = [(i, f"http://h/{i}", "x" * 200 if i % 3 else f"y{i}" * 60, "z") for i in range(40)] + [(None, "u", "x" * 200, "z"), (1, "other", "x" * 200, "z"), (900, "v", "é" * 300_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(5)
    made = warc.write_archives(warc.classify(df), new_path(spark, "t-refers")).collect()
    heads = [h for r in made for h, _ in warc.stream_records(r["path"])]
    ids = {h["warc-record-id"]: h for h in heads}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(heads) == len(rows) and len(revisits) > 20
    for h in revisits:
        to = ids[h["warc-refers-to"]]
        assert to["warc-type"] == "response" and to["warc-payload-digest"] == h["warc-payload-digest"] and to["x-page-id"] == h["x-refers-to-page-id"] and to["warc-target-uri"] == h["warc-refers-to-target-uri"]
    assert warc.archive_and_read(df).count() == len(rows)


def test_near_duplicates_however_rows_are_dealt(spark):
    r = random.Random(4)
    word = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    texts, base, passage = [], word(120), word(40)
    for _ in range(60):  # near copies, enough for common segments in a slice
        t = list(base)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = word(1)[0]
        texts.append(" ".join(t))
    texts += [" ".join(word(30) + passage + word(20)) for _ in range(60)] + [texts[0]] * 20 + [" ".join(word(20_000))] * 2
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, rep int, component int")
    want = None
    for dealt in (rows.coalesce(1), rows.repartition(9, "doc_id"), rows.repartition(3, "text")):
        got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in near_dup.near_duplicates(dealt).collect())
        want = want or got
        assert got == want
    groups = {}
    for i, _, c in want:
        groups.setdefault(c, set()).add(i)
    assert groups[0] == set(range(60)) | set(range(120, 140)) and groups[140] == {140, 141} and all(len(g) == 1 for c, g in groups.items() if c not in (0, 140))


def test_pipeline_stages_on_odd_tables(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    odd = docs.limit(40).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (-5, "", None, "src1", 0), (-6, None, "en", None, None)], docs.schema))
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, odd, sf)
        assert out.columns == docs.columns and out.count() <= odd.count()
        assert f(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() == odd.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
    extra = odd.selectExpr("*", "1 as rep", "'x' as component", "2 as hits", "3 as copies")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, extra, sf).columns == extra.columns
