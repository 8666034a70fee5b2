"""Queries over whole tables, held against brute force."""

import hashlib
import re
import unicodedata
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from compare import same
from engramma.operators import graph, motifs
from engramma.queries import enriched, imports, memory, passages


def words_of(duck):
    return {k: set(re.split(r"[ \t\n\x0b\f\r]+", t)) - {""} for k, t in duck.sql("select doc_id, text from documents").fetchall()}


def jaccards(sets, threshold):
    found = {}
    for (a, x), (b, y) in combinations(sorted(sets.items()), 2):
        c = len(x & y)
        if c and c / (len(x) + len(y) - c) >= threshold:
            found[a, b] = round(c / (len(x) + len(y) - c), 6)
    return found


def test_jaccard_pairs_of_all_documents(spark, sf, duck):
    assert {(r["a"], r["b"]): r["jaccard"] for r in memory.jaccard_pairs(spark, sf).collect()} == jaccards(words_of(duck), 0.5)


def test_jaccard_pairs_with_copies_at_every_threshold(spark):
    sets = {k: {(k * 7 + j * (1 + k % 3)) % 23 for j in range(1 + k % 9)} for k in range(60)} | {k: {1, 2, 3, 4} for k in range(60, 70)}
    rows = spark.createDataFrame([(k, f"e{e}") for k, x in sets.items() for e in x], "k long, e string")
    for t in (0.2, 0.5, 0.75, 1.0):
        got = graph.jaccard_pairs(rows, "k", "e", t).collect()
        want = jaccards(sets, t)
        assert len(got) == len(want) and {(r["a"], r["b"]): round(r["jaccard"], 6) for r in got} == want


def test_rare_cooccurrence_of_all_documents(spark, sf, duck):
    sets = words_of(duck)
    held = {}
    for k, x in sets.items():
        for e in x:
            held.setdefault(e, []).append(k)
    rare = {e for e, ks in held.items() if len(ks) <= int(len([x for x in sets.values() if x]) * 0.05)}
    want = {(a, b): " ".join(sorted(x & y & rare)) for (a, x), (b, y) in combinations(sorted(sets.items()), 2) if len(x & y & rare) >= 3}
    got = memory.rare_cooccurrence(spark, sf).collect()
    assert len(got) == len(want)
    assert {(r["a"], r["b"]): r["shared"] for r in got} == want and all(r["n"] == len(r["shared"].split(" ")) for r in got)
    links = {k: sum(k in p for p in want) for k, x in sets.items() if x & rare}
    first = {k: min(j for j, y in sets.items() if y & rare == sets[k] & rare) for k in links}
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in graph.rare_links(memory._words(spark, sf), "doc_id", "w", 0.05, 3).collect()} == {k: (first[k], n) for k, n in links.items()}


def test_rare_links_in_small_cells(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(graph, "COUNTERS", 50)
    sets = {k: sorted({(k * 7 + j * (1 + k % 3)) % 23 for j in range(1 + k % 9)}) for k in range(60)}
    both = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 3
    frame = lambda ks, b, lo, hi: pd.DataFrame({"k": ks, "w": [1 + k % 2 for k in ks], "x": [np.array(sets[k]) for k in ks], "b": b, "lo": lo, "hi": hi})
    own = graph._cell_links(frame(list(range(60)), 0, 0, 0), 3)
    assert dict(zip(own["k"], own["n"])) == {a: sum(1 + b % 2 for b in range(60) if a != b and both(a, b)) for a in range(60)}
    cross = graph._cell_links(pd.concat([frame(list(range(25)), 0, 0, 1), frame(list(range(25, 60)), 1, 0, 1)]), 3)
    assert dict(zip(cross["k"], cross["n"])) == {a: sum(1 + b % 2 for b in range(60) if (a < 25) != (b < 25) and both(a, b)) for a in range(60)}


def assigned_rows(texts):
    """(doc_id, motif_id, band, hits, amp, confidence) by Python's own Unicode word bounds."""
    out = []
    for k, text in texts:
        for m, (band, w) in ((m, (b, w)) for m, (w, b) in memory.WORDS.items()):
            hits = len(re.findall(rf"\b{w}\b", text, re.I))
            if hits:
                out.append((k, m, band, hits, round(min(1.0, 0.15 * hits / (len(text) / 1000)) + 1e-12, 4), 0.7 if w == "that" and "not that" in text.lower() else 1.0))
    return out


def test_motifs_of_texts_beyond_ascii(spark):
    texts = [(1, "\u201cThe\u201d caf\xe9 for th\xe9, and the\xe9 fo\xfcr"), (2, "\xe9the the\u0301 the_ the1 \u2014the\u2014"), (3, "was \xfcber with FROM\u2026this"), (4, "na\xefve: not that"), (5, "th\xe9 \u65e5\u672cthe")]
    got = motifs.assign(spark.createDataFrame(texts, "doc_id long, text string"), memory.DICTIONARY, "doc_id").collect()
    # for Python a combining mark ends a word; it belongs to the word
    want = [r[:4] for r in assigned_rows([(k, re.sub("\u0301", "\xe9", t)) for k, t in texts])]
    assert sorted((r["doc_id"], r["motif_id"], r["band"], r["hits"]) for r in got) == sorted(want)


MOTIF_QUERIES = "motif_assign motif_distribution motif_dominant posting_union posting_intersect motif_overlap_score gate_check consensus_merge motif_propagate motif_boost formula_rerank contains_any".split()


@pytest.mark.parametrize("name", MOTIF_QUERIES)
def test_motif_queries_of_all_documents(name, spark, sf, duck):
    import pandas as pd

    texts = duck.sql("select doc_id, text from documents").fetchall()
    assert any(not t.isascii() for _, t in texts) and not any(unicodedata.category(c) in ("Mn", "Mc", "Me") for _, t in texts for c in t)
    duck.register("assigned_whole", pd.DataFrame(assigned_rows(texts), columns="doc_id motif_id band hits amp confidence".split()))
    sql = memory.SQL[name].replace(memory.ASSIGNED, "SELECT * FROM assigned_whole")
    assert "octet_length" not in sql
    same(memory.QUERIES[name](spark, sf), duck.sql(sql))


def test_bm25_fields_finds_later_words(spark, tmp_path):
    spark.createDataFrame([(1, "one two three", "src9"), (2, "zebra only here", "src9"), (3, "four five", "src9")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("q", "one two three four five six seven zebra")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r["doc_id"] for r in passages.bm25_fields(spark, str(tmp_path)).collect()} == {1, 2, 3}


def test_batch_results_of_hashes_with_equal_beginnings(spark, duck, tmp_path):
    # the first eight digits of these two hashes are equal, and doc_id % 26 = 1 names a text by those only
    texts = [(1, "the text 49506"), (27, "the text 116637"), (2, "the text 3"), (26, "the text 4"), (4, "the text 49506"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")}).write.parquet(str(tmp_path / "documents.parquet"))
    got = enriched.batch_results(spark, str(tmp_path))
    con = duck.cursor()
    con.execute(f"create temp view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same(got, con.sql(enriched.SQL["batch_results"]))
    assert {r["content_hash"][:8] for r in got.collect()} == {"b4f62726", hashlib.md5(b"the text 3").hexdigest()[:8]}
    assert got.count() == 2  # both are stored with the smaller hash


def test_edges_go_to_more_tasks_as_there_are_more(spark, duck, tmp_path, monkeypatch):
    # orders of one to nine lines, one edge many times, rows without a key
    rows = [(k % 700, k // 700, (k % 700 * 37 + (k // 700) ** 2 * 101) % 997) for k in range(6000)] + [(10_000 + k, n, 5 + n) for k in range(3000) for n in range(2)] + [(None, 1, 3), (None, 2, 4), (20_000, 1, None), (20_000, 2, 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duck.cursor()
    con.execute(f"create temp view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    held = lambda: [r["n"] for r in memory._edges(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    few = held()
    monkeypatch.setattr(memory, "EDGE_ROWS", 300)
    many = held()
    assert sum(many) == sum(few) == con.sql(f"select count(*) from ({memory.EDGES})").fetchall()[0][0] > 3000
    assert len(few) <= 4 and max(many) <= 300
    for name in ("symmetric_edges", "pair_edges"):
        same(imports.QUERIES[name](spark, str(tmp_path)), con.sql(imports.SQL[name]))


def test_both_ways_keeps_what_edges_carry(spark):
    e = spark.createDataFrame([(1, 2, "x"), (1, 2, "x"), (3, 3, None), (None, 4, "y")], "a int, b long, note string")
    got = graph.both_ways(e)
    assert got.columns == ["node", "other", "direction", "note"]
    want = [(a, b, "out", t) for a, b, t in [(1, 2, "x"), (1, 2, "x"), (3, 3, None), (None, 4, "y")]] + [(b, a, "in", t) for a, b, t in [(1, 2, "x"), (1, 2, "x"), (3, 3, None), (None, 4, "y")]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert str(got._jdf.queryExecution().optimizedPlan()).count("LogicalRDD") == 1
