"""Decontamination, mixing, chat, WARC and neighbours on small fixtures, against brute force."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import pytest

from engramma.llm import ann, chat, decontaminate, mixing, q_tables, q_text, warc
from engramma.storage import new_path

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import same  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("name", sorted({**q_text.SQL, **q_tables.SQL}))
def test_query_equals_its_sql(name, spark, sf, duck):
    f = {**q_text.QUERIES, **q_tables.QUERIES}[name]
    same(f(spark, sf), duck.sql({**q_text.SQL, **q_tables.SQL}[name]))


def test_contamination_cases(spark):
    ten = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10"
    docs = spark.createDataFrame([(1, f"x {ten.upper()} y", "e"), (2, None, "e"), (3, "", "e"), (4, "Short item!", "e"), (4, "nothing here", "e"), (None, ten, "e"), (5, "é " * 3000 + ten, "e")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(7, ten + " k11"), (8, "short ITEM"), (9, None), (10, ten)], "item_id long, text string")
    got = sorted(((r["id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(1, 12, 10, 2, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 2, 2, 1, True), (4, 2, 0, 0, False), (None, 10, 10, 2, True), (5, 3010, 10, 2, True)], key=str)
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs.where("doc_id = 1"), bench, action="spans").collect()}
    assert cut == {1: "x y"}
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    # the plan without a broadcast gives the same
    far = decontaminate.contamination(docs, bench, broadcast_windows=0)
    assert sorted(map(str, far.collect())) == sorted(map(str, decontaminate.contamination(docs, bench).collect()))


def test_water_filling(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "fr", "c", 5), ("d1", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, budget_tokens=700, max_epochs=1, domain_weights={"d0": 40, "d1": 30}).collect()}
    # d0 gets 400: fr can use 5 of it, its sibling language the rest; within en, a has 10 and b the rest
    assert got == {"a": 10, "b": 385, "c": 5, "d": 300}


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, 0), (None, None, "en", "src1", 0), (2, "a b c", "en", "src1", 1), (2, "a b c", "en", "src1", 1)], "doc_id long, text string, lang string, source string, copies int")
    got = mixing.mix(docs, budget_share=1.0, max_epochs=2)
    assert got.columns == docs.columns and got.count() >= 3
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.selected(docs, budget_share=2.0, max_epochs=2).where("tokens > 0 and copies <> 2").count() == 0


def test_chat_round_trip(spark):
    odd = ["", "\\", "### user: x</turn>\n", "</turn>", "#<\\:", "é\n日本", "a" * 50_000, q_tables.CONTROL_TEXT]
    rnd = random.Random(1)
    rows, want = [], {}
    for c in range(60):
        for t in range(rnd.randint(1, 6)):
            role, text = rnd.choice(["user", "assistant", "a:b\\<#", None]), rnd.choice([*odd, None])
            rows.append((c, t, role, text, 1))
            want.setdefault(c, []).append((role or "", text or ""))
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted int").repartition(7)
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in out.collect()}
    assert {c: chat.parse_formatted(r["formatted"]) for c, r in got.items()} == want
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert back[c]["loss_chars"] == len(loss) and back[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big, small = "x" * 200, "y" * 50
    rows = [(1, "u", big), (2, "v\r\nw%", big), (3, None, small), (4, "z", small), (5, "q", None), (6, "q", "é" * 60), (7, "q", "é" * 60), (None, "n", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_and_read(df).collect()}
    assert got == {1: (200, "response", None), 2: (200, "revisit", 1), 3: (50, "response", None), 4: (50, "response", None), 5: (0, "response", None), 6: (120, "response", None), 7: (120, "revisit", 6), None: (200, "revisit", 1)}
    far = {r["page_id"]: r["refers_to"] for r in warc.archive_and_read(df, broadcast_repeats=0).collect()}
    assert far == {k: v[2] for k, v in got.items()}
    assert warc.archive_and_read(df.limit(0)).count() == 0
    raw = new_path(spark, "t-raw")
    made = warc.write_archives(warc.classify(df), raw, roll_bytes=300).collect()
    assert sum(r["records"] for r in made) == len(rows) and len(made) > 3
    assert sorted(h["x-page-id"] for r in made for h, _ in warc.stream_records(r["path"])) == sorted(["1", "2", "3", "4", "5", "6", "7", ""])


def test_nearest_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame([(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [None] + [1.0] * 63), (9005, [1.0, 2.0])], "vec_id long, embedding array<float>")
    v = df.unionByName(bad).unionByName(df.where("vec_id = 3").selectExpr("9006L as vec_id", "embedding"))
    q = v.where("vec_id % 20 = 0 or vec_id = 3")
    got = {}
    for r in ann.nearest(q, v, k=5, shard_rows=100, block_queries=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    p = v.where("vec_id < 9000 or vec_id = 9006").toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    n = np.sqrt((x * x).sum(1))
    hit = total = 0
    for qid in q.where("vec_id < 9000").toPandas().vec_id:
        a = x[ids == qid][0]
        s = (x * a).sum(1) / (n * np.sqrt((a * a).sum()))
        best = sorted(((-c, i) for c, i in zip(s, ids) if i != qid))[:5]
        mine = [i for _, i, _ in sorted(got[qid])]
        hit += len(set(mine) & {i for _, i in best})
        total += 5
        assert len(mine) == 5 and all(abs(c - s[ids == i][0]) < 1e-12 for _, i, c in got[qid])
    assert hit / total >= 0.9
    assert sorted(got[3])[0][1] == 9006
    assert ann.nearest(q.limit(0), v).count() == 0 and ann.nearest(q, v.where("vec_id = 3")).where("query_id = 3").count() == 0
