"""Classifiers, tokens, near duplicates and the pipeline on small fixtures."""

import zlib

import numpy as np
import pandas as pd
import pytest

from engramma.llm import near_dup, quality, q_tables, tokens, toxicity
from engramma.llm.q_text import tokenizer_path
from engramma.session import table


@pytest.mark.parametrize("module, label, threshold", [(quality, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, label, threshold):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    odd = spark.createDataFrame([(900001, None), (900002, ""), (None, "abc")], "doc_id long, text string")
    got = module.predictions(docs.select("doc_id", "text").unionByName(odd), labels).toPandas()
    assert len(got) == docs.count() + 3 and got.score.between(0, 1).all()
    j = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert len(j) > 20 and (j.predicted == j[label]).mean() >= threshold
    none = module.predictions(docs.limit(3), labels.limit(0)).toPandas()
    assert len(none) == 3


def test_word_encoder_equals_whole_texts():
    e = tokens.encoder(tokenizer_path())
    texts = ["", "  ", "It's a TEST<|endoftext|>don't <|ENDOFTEXT|> É é ÀÉ ß İI ΑΣ '' 's", "a\x85b\x1cc", "naïve ﬁ 日本語 123 4.5,6 !!!? x, y. Ñandú."]
    ids, offs = e.encode(texts)
    assert [ids[offs[i] : offs[i + 1]].tolist() for i in range(len(texts))] == [e._whole(t) for t in texts]


def test_store_round_trip(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "same", "x"), (-3, "same", "x")], "doc_id long, text string, lang string"))
    folder = tokens.write_store(docs, tokenizer_path())
    got = tokens.read_digests(spark, folder).toPandas().sort_values(["doc_id", "start"])
    e = tokens.encoder(tokenizer_path())
    pdf = docs.toPandas().sort_values("doc_id")
    ids = [np.array([*e._whole(t or ""), 2], "<u4") for t in pdf.text]
    assert got.doc_id.tolist() == pdf.doc_id.tolist() and got.n_tokens.tolist() == [len(x) for x in ids]
    assert got.start.tolist() == np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in ids]
    whole = {r["doc_id"]: r["ids"] for r in tokens.read_ids(spark, folder).collect()}
    assert all(whole[d] == x.tolist() for d, x in zip(pdf.doc_id, ids))
    assert tokens.verify_manifest(spark, folder).count() == 0
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()


def test_damaged_chunk_is_found(spark, sf, tmp_path):
    folder = tokens.write_store(table(spark, sf, "documents").limit(20), tokenizer_path(), folder="file://" + str(tmp_path / "s"))
    c = spark.read.parquet(f"{folder}/chunks").toPandas()
    c.loc[0, "ids"] = c.loc[0, "ids"][:-2] + b"\x00\x01"
    spark.createDataFrame(c, "address binary, ids binary").write.mode("overwrite").parquet(f"{folder}/chunks2")
    import shutil

    shutil.rmtree(tmp_path / "s" / "chunks")
    (tmp_path / "s" / "chunks2").rename(tmp_path / "s" / "chunks")
    with pytest.raises(Exception, match="damaged"):
        tokens.read_digests(spark, folder).collect()


def brute(texts):
    import re

    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def test_near_duplicates_against_brute_force(spark):
    r = np.random.RandomState(3)
    word = lambda n: [f"w{r.randint(10**6)}" for _ in range(n)]
    passage, texts = word(60), [None, "", "  ", "a b", "A b", "a b c"]
    for size in (20, 60, 120, 300):
        base = word(size)
        for k in range(25):  # a large group of near copies, some beyond the threshold
            t = list(base)
            for _ in range(r.randint(0, max(2, size // 25))):
                t[r.randint(len(t))] = f"x{r.randint(10**6)}"
            texts.append(" ".join(t))
        for _ in range(20):  # a passage shared by texts that are mostly of it, and by others
            texts.append(" ".join(word(r.randint(5, size)) + passage + word(r.randint(1, 12))))
    texts += [texts[40]] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("text", "body").selectExpr("doc_id", "body as text", "1 as size", "2 as id")
    got = near_dup.near_duplicates(df, bucket_segments=2000).toPandas().sort_values("doc_id")
    sizes, comps = brute(texts)
    assert got.n_shingles.tolist() == sizes and got.component_id.tolist() == comps
    kept = near_dup.keep_first(df)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(set(comps))
    assert near_dup.near_duplicates(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, (tuple(x) for x in near_dup.near_duplicates(null).collect()))) == sorted(map(str, [(None, 2, None), (1, 2, 1), (1, 2, 1)]))


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    got = q_tables.op4_language(spark, sf).toPandas().merge(table(spark, sf, "pages").toPandas(), on="page_id")
    path = got.url.str.extract(r"//[^/]+/([a-z]{2})/")[0]
    assert len(got) == table(spark, sf, "pages").count() and (got.lang == path)[path.notna()].mean() >= 0.95
    from engramma.llm import langid

    odd = spark.createDataFrame([(1, None, None), (2, "not a url", "<html lang='fr'>"), (3, "http://a.example/", "")], "page_id long, url string, html string")
    assert langid.identify(odd, table(spark, sf, "documents")).count() == 3
    assert langid.identify(odd, table(spark, sf, "documents").limit(0)).where("lang is null").count() == 3


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    seen = [docs]
    for _, f in corpus_pipeline.STAGES[:-1]:
        seen.append(f(spark, seen[-1], sf))
        assert seen[-1].columns == docs.columns and 0 < seen[-1].count() <= seen[-2].count()
    out = corpus_pipeline.STAGES[-1][1](spark, seen[-1], sf).toPandas().sort_values("doc_id")
    pd.testing.assert_frame_equal(out.reset_index(drop=True), corpus_pipeline.run(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True))
