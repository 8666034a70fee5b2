"""Whether two tables hold the same rows, told from digests by ranges of hashes; only ranges that differ are opened."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash ranges, as bits: a leaf of the digest. 4096 leaves are a few KB of digests a table.
BITS = 12


def leaf(keys: Sequence[str], bits: int = BITS) -> Column:
    """The hash range of a row's keys."""
    return F.shiftrightunsigned(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), 64 - bits).cast("int")


def with_leaf(table: DataFrame, keys: Sequence[str], bits: int = BITS) -> DataFrame:
    """``table`` with its rows' leaves, to be written partitioned by ``leaf``: then only leaves that are asked for are read."""
    return table.withColumn("leaf", leaf(keys, bits))


def digests(table: DataFrame, keys: Sequence[str], bits: int = BITS) -> DataFrame:
    """(leaf, n, low, high): of each hash range its rows and two sums over their hashes, whatever their order. One pass, a row a leaf and task shuffled.

    Columns count by name, in alphabetical order; a column ``leaf`` that is there is taken as the range.
    """
    cols = sorted(c for c in table.columns if c != "leaf")
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in cols)), {"ignoreNullFields": "false"})
    at = F.col("leaf") if "leaf" in table.columns else leaf(keys, bits)
    half = lambda k: F.conv(F.substring(F.md5(F.encode(whole, "utf-8")), k, 12), 16, 10).cast("decimal(38,0)")
    d = table.select(at.alias("leaf"), half(1).alias("a"), half(13).alias("b"))
    return d.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("a").alias("low"), F.sum("b").alias("high"))


def rolled_up(d: DataFrame, bits: int = 4) -> DataFrame:
    """Digests of ranges 2 ** ``bits`` times as wide."""
    return d.groupBy(F.shiftright("leaf", bits).alias("leaf")).agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"))


def differing(a: DataFrame, b: DataFrame, bits: int = BITS, step: int = 4) -> list[int]:
    """The leaves whose digests differ, found from the widest ranges down; at most 2 ** ``bits``."""
    levels = [(a, b)]
    for _ in range(0, max(0, bits - step), step):
        levels.append((rolled_up(levels[-1][0], step), rolled_up(levels[-1][1], step)))
    open_: list[int] | None = None
    for x, y in reversed(levels):
        if open_ is not None:
            inside = F.shiftright("leaf", step).isin(open_)
            x, y = x.where(inside), y.where(inside)
        y = y.select("leaf", *(F.col(c).alias(f"{c}2") for c in ("n", "low", "high")))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in ("n", "low", "high")])
        open_ = [r["leaf"] for r in x.join(y, "leaf", "full").where(~same).select("leaf").collect()]  # at most 2 ** bits
        if not open_:
            return []
    return sorted(open_)


def audit(a: DataFrame, b: DataFrame, keys: Sequence[str], digest_a: DataFrame | None = None, digest_b: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """(keys, status): the rows by which ``a`` and ``b`` differ, ``missing`` from b, ``extra`` in b, or ``changed``.

    Digests that were stored with the tables save a pass over each. Tables written by ``with_leaf`` are read in the
    leaves that differ only. A key that repeats is one whose rows differ if their multisets do. Null keys are keys.
    """
    cols = sorted(c for c in a.columns if c != "leaf")
    if cols != sorted(c for c in b.columns if c != "leaf"):
        raise ValueError("the tables have different columns")
    found = differing(digests(a, keys, bits) if digest_a is None else digest_a, digests(b, keys, bits) if digest_b is None else digest_b, bits)

    def opened(t: DataFrame, name: str) -> DataFrame:
        at = F.col("leaf") if "leaf" in t.columns else leaf(keys, bits)
        # rows of a key as one digest, so a key that many rows have is no hot group
        return digests_by_key(t.where(at.isin(found)) if found else t.limit(0), keys, cols).select(*(F.col(k).alias(f"{name}{i}") for i, k in enumerate(keys)), F.col("d").alias(name))

    x, y = opened(a, "x"), opened(b, "y")
    on = reduce(and_, [F.col(f"x{i}").eqNullSafe(F.col(f"y{i}")) for i in range(len(keys))])
    j = x.join(y, on, "full").where(~F.col("x").eqNullSafe(F.col("y")))
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("changed")
    return j.select(*(F.when(F.col("x").isNotNull(), F.col(f"x{i}")).otherwise(F.col(f"y{i}")).alias(k) for i, k in enumerate(keys)), status.alias("status"))


def digests_by_key(t: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, d): one digest of all rows of each key."""
    whole = F.md5(F.encode(F.to_json(F.struct(*(F.col(f"`{c}`") for c in cols)), {"ignoreNullFields": "false"}), "utf-8"))
    half = lambda k: F.conv(F.substring(whole, k, 12), 16, 10).cast("decimal(38,0)")
    g = t.groupBy(*(F.col(f"`{k}`").alias(k) for k in keys)).agg(F.count("*").alias("n"), F.sum(half(1)).alias("a"), F.sum(half(13)).alias("b"))
    return g.select(*keys, F.struct("n", "a", "b").alias("d"))


def equal_depth(rows: DataFrame, value: str, bins: int, by: str | None = None, error: float = 0.001) -> DataFrame:
    """(by, bin, low, high, n): a histogram whose bins hold about equally many rows, from mergeable quantile sketches.

    A bound's rank is off by ``error`` of the rows at most; counts are exact for the bounds told. Bins are closed at the
    low end, the last at both; equal bounds make one bin. Null and NaN values are left out; a null group is a group.
    """
    r = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select((F.col(by) if by else F.lit("all")).alias("g"), F.col(value).cast("double").alias("v"))
    cuts = [k / bins for k in range(1, bins)]
    s = r.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", cuts or [0.5], max(1, round(1 / error))).alias("q"))
    edges = F.array_sort(F.array_distinct(F.concat(F.array("lo"), F.col("q") if cuts else F.array().cast("array<double>"))))
    s = s.select(F.col("g").alias("gg"), "hi", edges.alias("edges"))
    # a row counts where the last edge at or below it is
    j = r.join(s, F.col("g").eqNullSafe(F.col("gg")))
    at = F.size(F.filter("edges", lambda e: e <= F.col("v")))
    c = j.groupBy("g", "hi", "edges", at.alias("bin")).agg(F.count("*").alias("n"))
    high = F.coalesce(F.get("edges", F.col("bin")), F.col("hi"))
    out = c.select("g", (F.col("bin") - 1).alias("bin"), F.get("edges", F.col("bin") - 1).alias("low"), high.alias("high"), "n")
    return out.withColumnRenamed("g", by) if by else out.drop("g")
