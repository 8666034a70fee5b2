"""Many searches as one plan: every query by every strategy, each row naming its lane, and the lanes fused.

What strategies share is scanned once: words of the texts, vectors, and the metadata of what was found. A strategy is a
name for a lane over these scans, so seven strategies are one job whose rows say which lane gave them; a run of some of
them gives the same rows as that part of the whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramma.functions import text as tx
from engramma.operators import search as se
from engramma.storage import written

#: The constant of reciprocal ranks; ranks count from 0.
RRF = 60
_LANE = ("query_id", "key", "score")


class Scans:
    """What lanes are made of, each written when first asked for.

    ``texts``: key, content, and optionally summary, vector, summary_vector, platform, at. ``queries``: query_id, query,
    and optionally qv, platform, since, until, motif_id. ``postings``: key, motif_id, amp.
    """

    def __init__(self, texts: DataFrame, queries: DataFrame, postings: DataFrame | None, depth: int):
        self.texts, self.queries, self.postings, self.depth = texts, queries, postings, depth
        self._made: dict[object, DataFrame] = {}

    def _once(self, name: object, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = written(make(), "strategy-scan")
        return self._made[name]

    def words(self, **fields: float) -> DataFrame:
        """The best of every query by BM25 over the fields, by weight."""
        return self._once(tuple(fields.items()), lambda: se.bm25(self.texts, self.queries, "key", fields, k=self.depth).select(*_LANE))

    def near(self, vector: str, filtered: bool) -> DataFrame:
        """The nearest texts of every query; ``filtered`` ones of its platform and window only."""
        q = self.queries
        if filtered:
            q = q.withColumns({c: F.lit(None).cast(t) for c, t in (("platform", "string"), ("since", "timestamp"), ("until", "timestamp")) if c not in q.columns})
        t = self.texts if "at" in self.texts.columns or not filtered else self.texts.withColumn("at", F.lit(None).cast("timestamp"))
        return self._once((vector, filtered), lambda: se.cosine_pairs(t, q, "key", vector, self.depth, windowed=filtered).select("query_id", "key", F.col("similarity").alias("score")))

    def motifs(self, least: float) -> DataFrame:
        """The texts that have the query's motif, by amplitude."""
        asked = self.queries.where("motif_id is not null").select("query_id", "motif_id")
        return asked.join(self.postings.where(F.col("amp") >= least), "motif_id").select("query_id", "key", F.col("amp").alias("score"))

    def ranked(self, lane: DataFrame, depth: int | None = None) -> DataFrame:
        """The best of a lane (query_id, key, score, rank from 1); scores to nine places, ties to the smaller key."""
        return se.top_k(lane.select("query_id", "key", F.round("score", 9).alias("score")), depth or self.depth, "score", "key", ["query_id"]).select("query_id", "key", "score", "rank")


#: Vector share of the hybrid lane.
ALPHA = 0.65

STRATEGIES: dict[str, Callable[[Scans], DataFrame]] = {
    "words": lambda s: s.words(content=1.0),
    "fields": lambda s: s.words(content=1.0, summary=2.0),
    "vector": lambda s: s.near("vector", False),
    "summary_vector": lambda s: s.near("summary_vector", False),
    "filtered_vector": lambda s: s.near("vector", True),
    "motif": lambda s: s.motifs(0.0),
    "hybrid": lambda s: se.relative_fusion(s.ranked(s.near("vector", False)), s.ranked(s.words(content=1.0)), "key", ALPHA),
}


def run(texts: DataFrame, queries: DataFrame, postings: DataFrame | None = None, names: Sequence[str] | None = None, depth: int = 100) -> DataFrame:
    """(query_id, strategy, key, score, rank): the ``depth`` best of every query by every strategy, as one table.

    Names are those of ``STRATEGIES``; by default all that the columns given allow. Queries and texts that a strategy
    has nothing for (no vector, no motif) have no rows in its lane.
    """
    have = set(texts.columns)
    needs = {"fields": {"summary"}, "vector": {"vector"}, "summary_vector": {"summary_vector"}, "filtered_vector": {"vector", "platform"}, "hybrid": {"vector"}}
    can = [n for n in STRATEGIES if needs.get(n, set()) <= have and (n != "motif" or (postings is not None and "motif_id" in queries.columns)) and ("vector" not in n and n != "hybrid" or "qv" in queries.columns)]
    names = can if names is None else list(names)
    if bad := [n for n in names if n not in can]:
        raise ValueError(f"nothing is given for {bad}")
    scans = Scans(texts, queries, postings, depth)
    out = None
    for n in names:
        lane = scans.ranked(STRATEGIES[n](scans)).select("query_id", F.lit(n).alias("strategy"), "key", "score", "rank")
        out = lane if out is None else out.unionByName(lane)
    return out


def merged(lanes: DataFrame) -> DataFrame:
    """(query_id, key, score, strategies, best_rank, place): reciprocal ranks added up over the lanes, which stay named, best first."""
    m = lanes.groupBy("query_id", "key").agg(F.sum(1 / (F.lit(RRF) + F.col("rank") - 1)).alias("score"), F.array_sort(F.collect_set("strategy")).alias("strategies"), F.min("rank").alias("best_rank"))
    m = m.withColumn("score", F.round("score", 9))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")))


def across(merged_rows: DataFrame) -> DataFrame:
    """(key, score, strategies, n_queries): the merged rows of all queries as one list, scores added, lanes united."""
    return merged_rows.groupBy("key").agg(F.round(F.sum("score"), 9).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("strategies")))).alias("strategies"), F.count("*").alias("n_queries"))


def statistics(lanes: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, n_rows by strategy as a map, n_merged, n_hashes, n_sessions) of a search; ``texts`` has key, content_hash, session_id."""
    n = lanes.groupBy("query_id", "strategy").agg(F.count("*").alias("n"))
    by = n.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "n")))).alias("by_strategy"))
    found = lanes.select("query_id", "key").distinct().join(texts.select("key", "content_hash", "session_id"), "key")
    c = found.groupBy("query_id").agg(F.count("*").alias("n_merged"), F.count_distinct("content_hash").alias("n_hashes"), F.count_distinct("session_id").alias("n_sessions"))
    return by.join(c, "query_id")


def extracted(merged_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, kind, items): the equations, code blocks and definitions in the texts that were found, each text once; only texts that have some."""
    t = texts.select("key", "content").join(merged_rows.select("key").distinct(), "key", "left_semi")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), f(F.coalesce("content", F.lit(""))).alias("items")) for k, f in (("math", tx.math_lines), ("code", tx.code_blocks), ("definitions", tx.definition_lines))))
    return t.select("key", F.explode(kinds).alias("x")).select("key", "x.kind", "x.items").where(F.size("items") > 0)
