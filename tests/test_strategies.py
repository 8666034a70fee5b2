"""Searches by many strategies in one plan, and what is taken from the texts they find."""

import re

from pyspark.sql import functions as F

from engramma.functions import text as tx
from engramma.operators import search
from engramma.plans import strategies as sg
from engramma.queries import samples

import pytest


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def world(spark):
    texts = spark.createDataFrame([(k, f"word{k % 5} common word{k % 3}", "src", [float(k % 7), 1.0], [1.0, float(k % 4)], f"p{k % 2}", f"h{k % 9}", f"s{k % 3}") for k in range(40)], "key long, content string, summary string, vector array<double>, summary_vector array<double>, platform string, content_hash string, session_id string")
    queries = spark.createDataFrame([("a", "word1 common", [1.0, 0.5], "p1", "m"), ("b", "word2", [0.2, 1.0], None, None), ("c", "nothing here", None, "p0", "m")], "query_id string, query string, qv array<double>, platform string, motif_id string")
    return texts, queries, spark.createDataFrame([(k, "m", k / 40) for k in range(0, 40, 3)], "key long, motif_id string, amp double")


def test_one_run_equals_seven(spark):
    texts, queries, postings = world(spark)
    whole = sg.run(texts, queries, postings, depth=6)
    assert {r["strategy"] for r in whole.select("strategy").distinct().collect()} == set(sg.STRATEGIES)
    for name in sg.STRATEGIES:
        assert rows(whole.where(F.col("strategy") == name)) == rows(sg.run(texts, queries, postings, [name], depth=6))
    # a filtered lane sees its platform only, and as many rows as the others
    kept = whole.where("strategy = 'filtered_vector' and query_id = 'a'").join(texts, "key")
    assert kept.count() == 6 and kept.where("platform <> 'p1'").count() == 0
    with pytest.raises(ValueError):
        sg.run(texts.drop("summary"), queries, names=["fields"])
    assert "motif" not in {r["strategy"] for r in sg.run(texts, queries).select("strategy").distinct().collect()}


def test_merged_lanes_keep_their_names(spark):
    texts, queries, postings = world(spark)
    lanes = sg.run(texts, queries, postings, depth=6)
    want = {}
    for r in lanes.collect():
        score, names = want.get((r["query_id"], r["key"]), (0.0, set()))
        want[r["query_id"], r["key"]] = (score + 1 / (60 + r["rank"] - 1), names | {r["strategy"]})
    m = sg.merged(lanes)
    assert {(r["query_id"], r["key"]): (r["score"], r["strategies"]) for r in m.collect()} == {k: (round(s, 9), sorted(n)) for k, (s, n) in want.items()}
    one = {r["key"]: r for r in sg.across(m).collect()}
    assert all(abs(r["score"] - sum(v[0] for k, v in want.items() if k[1] == key)) < 1e-8 and set(r["strategies"]) == set().union(*(v[1] for k, v in want.items() if k[1] == key)) for key, r in one.items())
    s = {r["query_id"]: r for r in sg.statistics(lanes, texts).collect()}
    assert s["a"]["by_strategy"]["words"] == 6 and s["a"]["n_merged"] == len([k for k in want if k[0] == "a"])


def test_windows_are_looked_at_before_the_best_are_kept(spark):
    v = spark.sql("select id as key, array(1.0D, cast(id as double)) as v, concat('p', id % 3) as platform, timestamp_seconds(id) as at from range(300)")
    q = spark.sql("select * from values ('x', array(1.0D, 1.0D), 'p1', timestamp_seconds(100), timestamp_seconds(200)), ('y', array(1.0D, 1.0D), null, null, null) t(query_id, qv, platform, since, until)")
    got = search.top_k(search.cosine_pairs(v, q, "key", "v", 3, windowed=True), 3, "similarity", "key", ["query_id"])
    assert {(r["query_id"], r["key"]) for r in got.collect()} == {("x", 100), ("x", 103), ("x", 106), ("y", 1), ("y", 2), ("y", 3)}


TEXT = "Axiom 1: all is one line\n  E = m c^2 and more = here\n```py\nx = 1\n\ny = 2\n  ```\nphi = 1.618 in prose\nshort = 1\n$a=b$ costs = nothing\nTrust = love and law\n```\nnever closed = 1\nTRUTH= one\nlog(x) → infinity goes on\nno sign in this line at all = prose"


def test_extraction_follows_the_rules(spark):
    signs, patterns = tx.MATH_SIGNS, [re.compile(p.replace("(?iu)", "(?i)")) for p in tx.MATH_PATTERNS]
    lines = [x.strip() for x in TEXT.split("\n")]
    math = [x for x in lines if len(x) >= 15 and re.search(tx.MATH_OPERATORS, x) and (any(s in x for s in signs) or any(p.search(x) for p in patterns))]
    defs = [x for x in lines if any(re.search(p, x) for p in tx.DEFINITION_PATTERNS)]
    r = spark.range(1).select(F.lit(TEXT).alias("t")).select(tx.math_lines(F.col("t")).alias("m"), tx.code_blocks(F.col("t")).alias("c"), tx.definition_lines(F.col("t")).alias("d")).first()
    assert (r["m"], r["c"], r["d"]) == (math, ["x = 1\n\ny = 2"], defs) and len(math) >= 4 and len(defs) >= 2
    found = spark.createDataFrame([("q", 1), ("r", 1)], "query_id string, key int")
    texts = spark.createDataFrame([(1, TEXT), (2, TEXT), (3, None)], "key int, content string")
    assert {(x["key"], x["kind"]) for x in sg.extracted(found, texts).collect()} == {(1, "math"), (1, "code"), (1, "definitions")}
    assert samples.DEPTH == 20
