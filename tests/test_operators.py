import datetime
import hashlib

from pyspark.sql import functions as F

from engramma.functions import text as tx
from engramma.functions import timefn
from engramma.functions.vector import cosine, max_sim
from engramma.operators import events, exchanges, graph, search, tiling
from engramma.plans import classify


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_canonical_and_uuid(spark):
    import uuid

    assert one(spark, tx.canonical(F.lit("a  \r\nb\r\n\n\n\n\nc"))) == "a\nb\n\n\nc"
    assert one(spark, tx.uuid5(F.lit("abc:search_512:0"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "abc:search_512:0"))


def test_fences_and_files(spark):
    body = "x = 1\ny = 2\nprint(x + y)  # sum"
    got = one(spark, tx.code_fences(F.lit(f"see `a/b.py`\n```python\n{body}\n```\n")))
    assert [(r["lang"], r["body"], r["fingerprint"]) for r in got] == [("python", body, hashlib.md5(body.encode()).hexdigest()[:16])]
    assert one(spark, tx.code_fences(F.lit("```\n  a block of no language  \n```\n```js\ntoo short\n```")))[0]["lang"] == "unknown"
    # a bare name is no reference; a path, a name after a verb and one in backticks are
    assert one(spark, tx.file_references(F.lit("open `a/b.py` and notes.md, Reading c.ts\n/srv/x/y.css or /srv/z.exe"))) == ["/srv/x/y.css", "a/b.py", "c.ts"]


def test_tile_grid_edges(spark):
    chunk, step = tiling.SCALES["search_512"]
    rows = spark.createDataFrame([(0, ""), (1, "x" * chunk), (2, "x" * (chunk + 1)), (3, "x" * 10000), (4, None)], "id int, text string")
    got = {}
    for r in tiling.tile_grid(rows, chunk, step).collect():
        got.setdefault(r["id"], []).append((r["start_char"], r["grid_end"]))
    assert sorted(got[0]) == [(0, 0)] and sorted(got[1]) == [(0, chunk)] and 4 not in got
    for k in (2, 3):
        t = sorted(got[k])
        assert t[0][0] == 0 and max(e for _, e in t) == (chunk + 1 if k == 2 else 10000) and all(b[0] <= a[1] for a, b in zip(t, t[1:]))


def test_rebuild_with_paragraphs(spark):
    text = ("word " * 80 + ".\n\n") * 30
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    t = tiling.tiles(docs, "search_512")
    assert tiling.rebuilt(t, "id").first()["text"] == text
    assert any(r["content"].endswith("\n\n") for r in t.collect())


def test_time(spark):
    ts = one(spark, timefn.parse_time(F.lit("2024-01-02T03:04:05Z")))
    assert ts == datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, timefn.parse_time(F.lit("2024-01-02T03:04:05.123456Z"), strict=True)) is None
    assert one(spark, F.round(timefn.decay(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-03-31").cast("timestamp"), 90), 6)) == 0.5
    assert one(spark, timefn.store_date_iso(F.lit('{"$date":{"$numberLong":"1700000000000"}}'))) == "2023-11-14T22:13:20Z"


def test_vectors(spark):
    a, z = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, cosine(a, a)) == 1.0 and one(spark, cosine(a, z)) == 0.0
    assert one(spark, max_sim(F.array(a), F.array(z, a))) == 1.0


def test_graph_cycle_and_versions(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "src long, dst long")
    got = {(r["node"], r["distance"]) for r in graph.hops(e, spark.createDataFrame([(1,)], "start long"), 5).collect()}
    assert got == {(2, 1), (3, 1)}
    v = spark.createDataFrame([(3, 2), (2, 1)], "newer long, older long")
    assert [r["node"] for r in graph.version_chain(v).orderBy("position").collect()] == [3, 2, 1]


def test_fusion_and_caps(spark):
    lists = spark.createDataFrame([("q", 1, 1, 1.0), ("q", 2, 2, 1.0), ("q", 1, 3, 1.0)], "query_id string, id long, rank int, weight double")
    best = search.rrf(lists, "id").orderBy(F.desc("score")).first()
    assert best["id"] == 1 and abs(best["score"] - (1 / 61 + 1 / 63)) < 1e-12


def test_phi():
    assert events.phi_coherence(1.0, 1.0, 1.0) == 1.0
    assert events.phi_coherence(0.0, 1.0, 1.0) < 0.4


#: Kinds and confidences worked out by hand from the fixed patterns and weights.
CLASSIFIED = [
    ("What happened in January 2026 with infrastructure", "temporal", 0.95),
    ("how does the gate work", "conceptual", 0.75),
    ("relationship between coercion entropy and ethics fidelity", "relational", 0.55),
    ("how do bristle signals relate to identity declarations", "relational", 0.95),
    ("find HMM.SACRED_TRUST", "motif", 1.0),
    ("sacred trust pattern", "motif", 0.6),
    ("sacred trust connects between layers", "relational", 0.55),
    ("SACRED_TRUST", "motif", 0.7),
    ("foo bar", "exact", 0.7),
    ("latest grok conversations about ports", "temporal", 1.0),
    ("why is the port important", "conceptual", 1.0),
    ("December 17 2025 phi evolution", "exact", 0.7),
    ("what is the name of the host", "conceptual", 0.55),
    (None, "exact", 0.7),
]


def test_classification(spark):
    q = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CLASSIFIED)], "query_id int, query string")
    got = {r["query_id"]: r for r in classify.plans(q).collect()}
    assert [(got[i]["strategy"], got[i]["confidence"]) for i in range(len(CLASSIFIED))] == [(k, c) for _, k, c in CLASSIFIED]
    assert (str(got[0]["after"]), str(got[0]["before"]), got[0]["semantic_query"]) == ("2026-01-01", "2026-02-01", "What happened with infrastructure")
    assert got[2]["sub_queries"] == ["coercion entropy", "ethics fidelity", CLASSIFIED[2][0]] and got[3]["sub_queries"] == ["bristle signals", "identity declarations", CLASSIFIED[3][0]]
    assert got[4]["motifs"] == got[7]["motifs"] == ["HMM.SACRED_TRUST"] and got[3]["motifs"] == ["HMM.BRISTLE_SIGNAL", "HMM.IDENTITY_DECLARATION"]
    assert got[9]["platform"] == "grok" and got[9]["recent_days"] == 30 and got[9]["after"] is None and got[11]["after"] is None
    assert one(spark, classify.platform(F.lit("openai vs Anthropic"))) == "claude" and one(spark, classify.platform(F.lit("claude code here"))) == "claude_code"


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from engramma.storage import new_path, scratch, written

    with scratch(spark):
        outer = new_path(spark, "outer")
        spark.range(3).write.parquet(outer)
        with scratch(spark):
            inner = written(spark.range(3), "inner")
            assert inner.count() == 3
            path = inner.inputFiles()[0]
        assert not os.path.exists(path.removeprefix("file://")) and spark.read.parquet(outer).count() == 3
    assert not os.path.exists(outer.removeprefix("file://"))


def test_hops_deal_lists_of_nodes_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIST", 2)
    edges = [(a, b) for a in range(30) for b in (a * 7 % 30, (a + 1) % 30, a)] + [(99, b) for b in range(20)] + [(1, None), (1, 2), (1, 2)]
    near = {}
    for a, b in edges:
        if b is not None:
            near.setdefault(a, set()).add(b)
    want = {}
    for a in [*range(30), 99]:
        reached = {a: 0}
        for d in (1, 2):
            for n in [n for n, x in reached.items() if x == d - 1]:
                for m in near.get(n, ()):
                    reached.setdefault(m, d)
        want |= {(a, n): d for n, d in reached.items() if d}
    e = spark.createDataFrame(edges, "src int, dst int")
    got = graph.hops(e, spark.createDataFrame([(a,) for a in [*range(30), 99, 1]], "start int"), 2)
    rows = got.collect()
    assert len(rows) == len(want) and {(r["start"], r["node"]): r["distance"] for r in rows} == want
    # pairs were joined and shuffled one by one
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "RepartitionByExpression [start" in plan


def test_bm25_best_makes_no_row_a_pair(spark, monkeypatch):
    rows = [(i, f"alpha beta {'gamma ' * (i % 7)} w{i % 11}", f"s{i % 2} alpha", "p" if i % 2 else "q", None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, platform string, at timestamp").coalesce(1)
    q = spark.createDataFrame([("a", "alpha gamma", None, None, None), ("b", "w3 beta s1", "p", None, None), ("c", "nothing", None, None, None)], "query_id string, query string, platform string, since timestamp, until timestamp")
    fields = {"text": 1.0, "source": 2.0}
    for kw in ({}, {"windowed": True}):
        few, all_ = (search.bm25(docs, q, "doc_id", fields, k=k, **kw).withColumn("score", F.round("score", 9)) for k in (5, 500))
        every = search.bm25(docs, q, "doc_id", fields, **kw).withColumn("score", F.round("score", 9))
        best = lambda s: sorted(map(tuple, search.top_k(s, 5, "score", "doc_id", ["query_id"]).select("query_id", "doc_id", "score", "rank").collect()))
        assert best(few) == best(every) and sorted(map(tuple, all_.collect())) == sorted(map(tuple, every.select(*all_.columns).collect()))
        assert few.count() < every.count()
    # keys that are not distinct take the way of joins
    twice = search.bm25(docs.union(docs.limit(3)), q, "doc_id", fields, k=5)
    assert twice.count() == search.bm25(docs.union(docs.limit(3)), q, "doc_id", fields).count()
    for n in (3, 20):
        monkeypatch.setattr(search, "SCORES", n)
        assert best(search.bm25(docs, q, "doc_id", fields, k=5).withColumn("score", F.round("score", 9))) == best(search.bm25(docs, q, "doc_id", fields).withColumn("score", F.round("score", 9)))
    assert search.bm25(docs.limit(0), q, "doc_id", fields, k=5).count() == 0 == search.bm25(docs, q.limit(0), "doc_id", fields, k=5).count()


def test_cosine_counts_equal_pairs(spark, monkeypatch):
    from engramma.operators import evaluate

    vs = [(i, [float((i * 7 + j * j) % 11 - 5) for j in range(6)]) for i in range(60)] + [(60, None), (61, [0.0] * 6), (62, [1.0, 2.0]), (63, [])]
    v = spark.createDataFrame(vs, "vec_id long, embedding array<float>").coalesce(1)
    q = v.where("vec_id % 5 = 0 or vec_id > 60").selectExpr("vec_id as query_id", "embedding as qv")
    pairs = search.cosine_pairs(v, q, "vec_id").groupBy("query_id", evaluate.judged(F.round("similarity", 6)).alias("bin")).agg(F.count("*").alias("n"))
    monkeypatch.setattr(search, "VECTOR_BLOCK", 16)
    assert sorted(map(tuple, search.cosine_counts(v, q, [0.5499995, 0.3499995]).collect())) == sorted(map(tuple, pairs.collect()))
