"""MaxSim retrieval through the token index, against every pair in numpy."""

import tracemalloc

import numpy as np
import pytest

from engramma import storage
from engramma.operators import maxsim


def bags(rng, n, centres, dim=16):
    out = []
    for k in range(n):
        for _ in range(rng.randint(1, 7)):
            v = centres[rng.randint(len(centres))] + rng.randn(dim) * 0.2
            out.append((k, [float(x) for x in v]))
    return out


def every_pair(docs, queries, k):
    d, q = ({i: np.array([v for j, v in rows if j == i]) for i in {j for j, _ in rows}} for rows in (docs, queries))
    return {i: sorted((-float((x @ y.T).max(1).sum()), j) for j, y in d.items())[:k] for i, x in q.items()}


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.RandomState(2)
    centres = rng.randn(30, 16)
    docs, queries = bags(rng, 400, centres), [(i + 1000, v) for i, v in bags(rng, 25, centres)]
    index = maxsim.build(spark.createDataFrame(docs, "doc long, vector array<double>").repartition(4))
    return docs, queries, index


def test_exact_search_equals_every_pair(spark, world):
    docs, queries, index = world
    got = maxsim.search(index, spark.createDataFrame(queries, "query_id long, vector array<double>").repartition(3), 5).collect()
    want = every_pair(docs, queries, 5)
    assert {(r["query_id"], r["rank"], r["doc"]) for r in got} == {(q, n + 1, d) for q, best in want.items() for n, (_, d) in enumerate(best)}
    assert max(abs(r["score"] + want[r["query_id"]][r["rank"] - 1][0]) for r in got) < 1e-9
    # the bounds leave out most pairs
    assert sum({r["query_id"]: r["n_scored"] for r in got}.values()) < 0.5 * 400 * 25


def test_probed_search_recalls_most_and_scores_few(spark, world):
    docs, queries, index = world
    got = maxsim.search(index, spark.createDataFrame(queries, "query_id long, vector array<double>"), 5, exact=False).collect()
    want = every_pair(docs, queries, 5)
    hit = sum((-next(s for s, d in want[r["query_id"]] if d == r["doc"]) > -1e9) for r in got if r["doc"] in {d for _, d in want[r["query_id"]]})
    assert hit >= 0.9 * 5 * 25
    assert sum({r["query_id"]: r["n_scored"] for r in got}.values()) < 0.4 * 400 * 25


def test_recall_on_the_table(spark, sf):
    rows = [(r["vec_id"] // 5, r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = spark.createDataFrame(rows, "doc long, vec long, vector array<double>")
    index = maxsim.build(df)
    asked = df.where("doc % 20 = 0").withColumnRenamed("doc", "query_id")
    want = every_pair([(d, v) for d, _, v in rows], [(d, v) for d, _, v in rows if d % 20 == 0], 5)
    for exact in (True, False):
        got = maxsim.search(index, asked, 5, exact=exact).collect()
        hit = sum(r["doc"] in {d for _, d in want[r["query_id"]]} for r in got)
        assert hit == 5 * len(want) if exact else hit >= 0.9 * 5 * len(want)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [0.0, 0.0]), (7, [0.0, 1.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc long, vector array<double>, rank string, score int")
    index = maxsim.build(df)
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (9, [0.0, 2.0]), (10, None), (None, [1.0, 0.0]), (11, [1.0, 0.0])], "query_id long, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["doc"], r["score"]) for r in maxsim.search(index, asked, 3).collect())
    # ties go to the smaller document; documents 3 to 5 have no vector
    assert got == [(9, 1, 1, 3.0), (9, 2, 7, 3.0), (9, 3, 2, 1.0), (11, 1, 1, 1.0), (11, 2, 2, 1.0), (11, 3, 7, 1.0)]
    assert maxsim.search(index, asked, 10).where("query_id = 9").count() == 4
    nothing = maxsim.build(df.limit(0))
    assert maxsim.search(nothing, asked, 3).count() == 0 == maxsim.search(index, asked.limit(0), 3).count()
    with pytest.raises(ValueError):
        maxsim.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "doc long, vector array<double>"))


def test_exact_search_makes_no_row_a_pair(spark, monkeypatch):
    rng = np.random.RandomState(4)
    docs = [(k, [float(x) for x in v]) for k in range(300) for v in rng.randn(3, 16)]
    docs += [(k + 300, v) for k, v in docs[:30]]  # copies in other blocks
    queries = [(k, v) for k, v in docs if k % 20 == 0 and k < 300]
    made = {}

    def written(df, name):
        out = storage.written(df, name)
        made[name] = out
        return out

    monkeypatch.setattr(maxsim, "written", written)
    for size in (64, 1 << 20):
        monkeypatch.setattr(maxsim, "DOC_BLOCK", size, raising=False)
        index = maxsim.build(spark.createDataFrame(docs, "doc long, vector array<double>").coalesce(1))
        got = maxsim.search(index, spark.createDataFrame(queries, "query_id long, vector array<double>"), 2).collect()
        want = every_pair(docs, queries, 2)
        assert {(r["query_id"], r["rank"], r["doc"]) for r in got} == {(q, n + 1, d) for q, best in want.items() for n, (_, d) in enumerate(best)}
    # in one block a query leaves its two best and a count; there are 15 queries and 310 documents, nearly all of them scored
    assert made["maxsim-scored"].count() <= 15 * 3 and sum({r["query_id"]: r["n_scored"] for r in got}.values()) > 15 * 150


def test_memory_does_not_grow_with_centroids():
    x, c = np.random.RandomState(5).randn(8192, 8), np.random.RandomState(6).randn(4096, 8)
    tracemalloc.start()
    maxsim._nearest(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_partitions_grow_with_what_the_probes_meet(spark, world, monkeypatch):
    _, queries, index = world
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    told = lambda: sorted((r["query_id"], r["rank"], r["doc"], round(r["score"], 9), r["n_met"], r["n_scored"]) for r in maxsim.search(index, asked, 5, exact=False).collect())
    want = told()
    monkeypatch.setattr(maxsim, "MET_ROWS", 500)
    seen, met = [], maxsim._met
    monkeypatch.setattr(maxsim, "_met", lambda index, probes, reach, parts: seen.append((probes.join(index.postings, "centroid").count(), parts)) or met(index, probes, reach, parts))
    assert told() == want
    rows, parts = seen[0]
    assert rows > 2500 and parts == rows // 500 + 1
