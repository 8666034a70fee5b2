"""Chunks and packages against the sequential rules, on groups of many blocks."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from engramma.operators import chunking


def in_turn(texts, chunk, overlap, sep="\n\n"):
    """(text, first, last): the rule, a row at a time."""
    out, buffer, held = [], [], 0
    rows = [t for t in texts if t and t.strip()]
    for i, t in enumerate(rows):
        n = len(t) // 4
        if n > chunk:
            if buffer:
                out.append(buffer)
            out.append([(i, t)])
            buffer, held = [], 0
            continue
        buffer.append((i, t))
        held += n
        if held >= chunk:
            out.append(buffer)
            kept, total = [], 0
            for x in reversed(buffer):
                if total + len(x[1]) // 4 > overlap:
                    break
                kept.insert(0, x)
                total += len(x[1]) // 4
            buffer, held = kept, total
    if buffer:
        out.append(buffer)
    return [(sep.join(t for _, t in b), b[0][0], b[-1][0]) for b in out]


def paragraphs_in_turn(text, limit):
    parts = [p.strip() for p in re.split(r"\n\n+", text) if p.strip()]
    out, now, n = [], [], 0
    for p in parts:
        if n + len(p) > limit and now:
            out.append("\n\n".join(now))
            now = [now[-1], p]
            n = len(now[0]) + len(p)
        else:
            now.append(p)
            n += len(p)
    return out + (["\n\n".join(now)] if now else [])


@pytest.mark.parametrize("block", [2, chunking.BLOCK])
def test_budget_chunks(spark, block):
    rng = random.Random(block)
    groups = {"many": 3000, "few": 3, "one": 1, None: 40, "": 5, "blank": 2, "giants": 30}
    rows = []
    for g, n in groups.items():
        for i in range(n):
            size = rng.choice([0, 2, 3, 10, 40, 70, 150]) if g != "giants" else rng.choice([5, 900, 40])
            rows.append((g, i, "x" * size if g != "blank" else rng.choice([" \n", None]), "clash"))
    for size in (0, 2):  # long runs of rows without a token
        rows += [("quiet", k + 200 * size, "y" * size if k % 50 else "z" * 100, "clash") for k in range(200)]
    df = spark.createDataFrame(rows, "s string, i int, t string, pos string").repartition(5)
    got = {}
    for r in chunking.budget_chunks(df, "s", "i", "t", 50, 15, block=block).collect():
        got.setdefault(r["s"], []).append((r["chunk_index"], r["text"], r["first"], r["last"]))
    for g in {r[0] for r in rows}:
        want = in_turn([t for x, _, t, _ in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])], 50, 15)
        assert sorted(got.get(g, [])) == [(k, *w) for k, w in enumerate(want)], g


def test_a_group_of_many_rows(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("g").alias("s"), F.col("id").alias("i"), F.expr("repeat('x', 4 * cast(1 + id * id % 13 as int))").alias("t"))
    got = [(r["first"], r["last"]) for r in chunking.budget_chunks(df, "s", "i", "t", 40, 9).orderBy("chunk_index").select("first", "last").collect()]
    want = in_turn(["x" * (4 * (1 + i * i % 13)) for i in range(n)], 40, 9)
    assert got == [(a, b) for _, a, b in want]


@pytest.mark.parametrize("block", [1, chunking.BLOCK])
def test_paragraph_chunks(spark, block):
    rng = random.Random(3)
    texts = ["\n\n".join("p" * rng.choice([1, 5, 20, 60, 300]) + rng.choice(["", "\n", "  "]) for _ in range(k)) for k in (0, 1, 2, 7, 400)]
    texts += ["\n\n\n a \n\n \n\nb", None, "   ", "one", "w" * 700 + "\n\n" + "v" * 700 + "\n\n" + "u" * 5]
    df = spark.createDataFrame([(k if k else None, t, "clash") for k, t in enumerate(texts)], "k int, text string, size string")
    got = {}
    for r in chunking.paragraph_chunks(df, "k", chunk_chars=100, block=block).collect():
        got.setdefault(r["k"], []).append((r["chunk_index"], r["text"], r["content_hash"]))
    for k, t in enumerate(texts):
        want = [(i, c, hashlib.sha256(c.encode()).hexdigest()[:16]) for i, c in enumerate(paragraphs_in_turn(t or "", 100))]
        assert sorted(got.get(k or None, [])) == want


def test_packages(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.choice([0, 1, 5, 30, 200, None])) for g in ("a", "b", None, "c") for i in range(rng.choice([1, 300]))]
    got = {}
    for r in chunking.packed(spark.createDataFrame([(*r, 1) for r in rows], "g string, o long, s long, pos int"), "g", "o", "s", 250, misses=4).collect():
        got.setdefault(r["g"], []).append((r["place"], r["o"], r["s"]))
    for g in {r[0] for r in rows}:
        used = missed = 0
        want = []
        for _, o, s in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            if missed <= 4 and used + (s or 0) <= 250:
                want.append((len(want), o, s or 0))
                used += s or 0
            else:
                missed += 1
        assert sorted(got.get(g, [])) == want


def test_nothing(spark):
    rows = spark.createDataFrame([], "s string, i int, t string")
    assert chunking.budget_chunks(rows, "s", "i", "t", 50, 15).count() == 0 == chunking.paragraph_chunks(rows, "s", "t").count()
    with pytest.raises(ValueError):
        chunking.budget_chunks(rows, "s", "i", "t", 50, 50)


def test_paragraphs_of_short_texts_need_no_shuffle(spark):
    texts = ["\n\n".join("ab "[j % 3] * (n * j % 61) + "x" for j in range(n)) for n in range(25)] + ["", "  \n\n ", None, "a" * 500, "a\n\n" + "é" * 300 + "\n\n\n b \n\nc"]
    df = spark.createDataFrame([*enumerate(texts), (None, "one\n\ntwo")], "k long, t string")
    near = chunking.paragraph_chunks(df, "k", "t", 100)
    far = chunking.paragraph_chunks(df, "k", "t", 100, 1, whole=0)
    assert sorted(map(str, near.collect())) == sorted(map(str, far.collect()))
    assert "Exchange" not in chunking._packed_whole(df, "k", "t", 100)._jdf.queryExecution().executedPlan().toString()


def test_texts_of_budget_chunks_are_written_once(spark, monkeypatch):
    rows = spark.createDataFrame([("ab"[i % 2], i // 3, "x" * (i % 90)) for i in range(300)], "s string, i int, t string")
    seen, write, run = [], chunking.written, chunking.running
    monkeypatch.setattr(chunking, "written", lambda df, name: seen.append((name, df.columns)) or write(df, name))
    monkeypatch.setattr(chunking, "running", lambda df, *a: seen.append(("running", df.columns)) or run(df, *a))
    got = chunking.budget_chunks(rows, "s", "i", "t", 20, 5).collect()
    assert [name for name, columns in seen if "text" in columns] == ["chunk-texts"]
    assert {r["s"] for r in got} == {"a", "b"} and all(len(r["text"].split("\n\n")) == r["last"] - r["first"] + 1 for r in got)
