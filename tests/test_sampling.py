"""Seeded samples against sorting each stratum whole."""

import hashlib

import pytest
from pyspark.sql import functions as F

from engramma.operators import sampling
from engramma.operators.motifs import Dictionary, Motif


def drawn(rows, size, seed=42):
    out = set()
    for s in {s for _, s in rows}:
        keys = sorted((hashlib.md5(f"{seed}:{'' if k is None else k}".encode()).hexdigest(), k) for k, t in rows if t == s)
        out |= {(k, s) for _, k in keys[: max(0, size(len(keys)))]}
    return out


@pytest.mark.parametrize("room", [20, -10_000])
def test_samples_do_not_depend_on_partitions(spark, room):
    rows = [(k, "hot" if k % 3 else "b") for k in range(30_000)] + [(k, None) for k in range(50)] + [(90_000, "one"), (None, "null key")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k long, s string, n int").drop("n")
    want = drawn(rows, lambda n: max(10, n // 100))
    for parts in (1, 7):
        got = sampling.sample(df.repartition(parts), "k", F.greatest(F.lit(10), F.floor(F.col("n") / 100)), "s", room=room)
        assert got.columns == ["k", "s"] and {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    small = sampling.sample(df, "k", F.lit(5), "s")
    assert {tuple(r) for r in small.collect()} <= want and sampling.sample(df, "k", F.lit(0), "s").count() == 0
    assert {tuple(r) for r in sampling.sample(df, "k", F.lit(5), "s", seed=7).collect()} != {tuple(r) for r in small.collect()}
    assert sampling.sample(df.limit(0), "k", F.lit(5), "s").count() == 0


def test_shares_are_exact():
    assert sampling.quotas(100, sampling.SHARES) == {"single_motif": 40, "multi_motif": 30, "thematic": 20, "adversarial": 10}
    for n in range(57):
        q = sampling.quotas(n, sampling.SHARES)
        assert sum(q.values()) == n and all(abs(q[k] - n * s / 100) < 1 for k, s in sampling.SHARES.items())


def test_candidates_are_made_once(spark, monkeypatch):
    d = Dictionary([Motif("M.ONE", "slow", ("one",)), Motif("M.TWO", "mid", ("two",)), Motif("M.SIX", "mid", ("six",))])
    found = spark.createDataFrame([(1, "M.ONE"), (1, "M.TWO"), (1, "M.TWO"), (2, "M.TWO"), (3, "M.TWO"), (3, "M.ONE"), (None, "M.ONE"), (4, "M.NONE")], "key int, motif_id string")
    c = sampling.query_candidates(found, d, spark.createDataFrame([("a", "off?")], "name string, text string"))
    names = {"M.ONE/what", "M.ONE/how", "M.TWO/what", "M.TWO/how", "M.ONE+M.TWO", "slow/M.ONE", "mid/M.TWO", "a"}
    assert sorted(r["name"] for r in c.collect()) == sorted(names)
    plans, sample = [], sampling.sample
    monkeypatch.setattr(sampling, "sample", lambda rows, *a: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or sample(rows, *a))
    assert {r["name"] for r in sampling.query_set(c).collect()} == names
    assert len(plans) == 4 and not any("Aggregate" in p for p in plans)
