"""Audits by digest, and histograms of equal depth."""

import random

import pytest
from pyspark.sql import functions as F

from engramma.operators import audit
from engramma.storage import new_path


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, w double")


def test_one_changed_row_is_found_in_one_leaf(spark):
    a = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    b = a.withColumn("v", F.when(F.col("k") == 777, "other").otherwise(F.col("v")))
    paths = []
    for t in (a, b):
        paths.append(new_path(spark, "audit"))
        audit.with_leaf(t, ["k"], 6).repartition(4, "leaf").write.partitionBy("leaf").parquet(paths[-1])
    x, y = (spark.read.parquet(p) for p in paths)
    found = audit.differing(audit.digests(x, ["k"], 6), audit.digests(y, ["k"], 6), 6)
    assert len(found) == 1 and x.where(F.col("leaf").isin(found)).count() < 500
    assert [tuple(r) for r in audit.audit(x, y, ["k"], bits=6).collect()] == [(777, "changed")]
    stored = [audit.digests(t, ["k"], 6) for t in (a, b)]
    assert audit.audit(x, y, ["k"], *stored, bits=6).count() == 1 and audit.audit(x, x, ["k"], bits=6).count() == 0
    plan = x.where(F.col("leaf").isin(found))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


@pytest.mark.parametrize("bits", [4, 8, 12])
def test_differences_of_odd_tables(spark, bits):
    rng = random.Random(bits)
    rows = [(k if k else None, rng.choice([None, "", "x", f"v{k}"]), rng.choice([None, 1.5])) for k in range(300)]
    rows += [(5, "twice", None)] * 3 + [(6, "a", 1.0), (6, "b", 2.0)]
    other = [r for r in rows if r[0] not in (10, 11)] + [(1000, "new", None)]
    other = [(k, "changed", w) if k in (None, 20) else (k, v, w) for k, v, w in other]
    other.remove((5, "twice", None))
    rng.shuffle(other)
    got = {(r["k"], r["status"]) for r in audit.audit(table(spark, rows), table(spark, other).select("w", "k", "v"), ["k"], bits=bits).collect()}
    want = {(10, "missing"), (11, "missing"), (1000, "extra"), (5, "changed"), (20, "changed"), (None, "changed")}
    assert got == want
    assert audit.audit(table(spark, []), table(spark, [(1, "x", None)]), ["k"], bits=bits).collect()[0]["status"] == "extra"
    with pytest.raises(ValueError):
        audit.audit(table(spark, rows), table(spark, rows).drop("w"), ["k"])


def test_bins_hold_about_equally_many(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b"]), rng.expovariate(1.0)) for _ in range(4000)] + [("flat", 1.0)] * 50 + [("a", None), (None, 2.0), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {}
    for r in audit.equal_depth(df, "v", 8, "g").collect():
        got.setdefault(r["g"], []).append((r["bin"], r["low"], r["high"], r["n"]))
    for g in ("a", "b"):
        vs = sorted(v for h, v in rows if h == g and v is not None and v == v)
        bins = sorted(got[g])
        assert len(bins) == 8 and sum(b[3] for b in bins) == len(vs) and all(abs(b[3] - len(vs) / 8) <= 2 + 0.002 * len(vs) for b in bins)
        for k, low, high, n in bins:
            assert n == sum(low <= v < high or (k == 7 and v == high) for v in vs)
    assert got["flat"] == [(0, 1.0, 1.0, 50)] and got[None] == [(0, 2.0, 2.0, 1)]
    assert audit.equal_depth(df.limit(0), "v", 4).count() == 0
