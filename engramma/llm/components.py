"""Connected components by label propagation with pointer jumping, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramma.storage import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b), the component being its smallest id.

    A round takes each vertex's smallest neighbouring label, then the label of that label, so distances halve; the
    number of rounds grows with the logarithm of the longest path. Null ends are left out.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = written(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = written(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("l")), f"{name}-0")
    k = 0
    while True:
        k += 1
        seen = e.join(labels.select(F.col("id").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(seen, labels["id"] == seen["a"]).select("id", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        up = step.select(F.col("id").alias("l"), F.col("l").alias("up"))
        nxt = written(step.join(up, "l").select("id", F.col("up").alias("l"), (F.col("up") != F.col("old")).alias("moved")), f"{name}-{k}")
        labels = nxt.select("id", "l")
        if not nxt.where("moved").limit(1).count():
            return labels.select("id", F.col("l").alias("component"))


def joined_components(labels: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """``labels`` (id, component) after ``more`` edges (a, b): only the components that they join are searched anew.

    Ends that no label knows are components of their own.
    """
    known = lambda k: labels.select(F.col("id").alias(k), F.col("component").alias(f"__{k}"))
    e = more.select("a", "b").join(known("a"), "a", "left").join(known("b"), "b", "left")
    e = written(e.select("a", "b", F.coalesce("__a", "a").alias("x"), F.coalesce("__b", "b").alias("y")), f"{name}-joined")
    up = components(e.select(F.col("x").alias("a"), F.col("y").alias("b")), name).select(F.col("id").alias("__c"), F.col("component").alias("__up"))
    ends = e.select(F.col("a").alias("id"), F.col("x").alias("component")).union(e.select("b", "y")).join(labels.select("id"), "id", "left_anti").distinct()
    every = labels.select("id", "component").unionByName(ends)
    return written(every.join(up, F.col("component") == F.col("__c"), "left").select("id", F.coalesce("__up", "component").alias("component")), f"{name}-labels")
