"""Adaptive search: every query of a table takes the lanes, weights, filters and decay of its kind, in one plan.

A query is classified; words and vectors rank the passages that its platform and window allow, and the two rankings are
blended by the kind's share. Exact queries get passages that only the words found, conceptual ones those whose
summaries match; motif queries fuse the ranking with the motifs' own. The pool is cut, takes the metadata of whole
documents, is ranked again by a scorer (a formula unless one is given) and loses copies. Conceptual queries are raised
by their theme's motifs, temporal ones decay with age.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.functions import timefn
from engramma.operators import search as se
from engramma.plans.classify import plans
from engramma.storage import written

# Half-lives in days, passages that are ranked again, by kind of query; lane quotas and weights.
HALF_LIFE = {"exact": 90, "temporal": 60, "conceptual": 180, "relational": 120, "motif": 120}
RERANK = {"exact": 30, "temporal": 25, "conceptual": 30, "relational": 22}
WORD_LANE, SUMMARY_LANE, MOTIF_WEIGHT, BOOST, DECAY_WEIGHT = 10, 15, 1.5, 0.10, 0.15
ALTERNATIVE = {"exact": "conceptual", "temporal": "default", "motif": "conceptual", "relational": "conceptual", "conceptual": "default", "default": "conceptual"}
LOW_SCORE = 0.01


def by_kind(kind: Column, values: dict[str, float], otherwise: float) -> Column:
    return reduce(lambda c, kv: F.when(kind == kv[0], F.lit(kv[1])).otherwise(c), values.items(), F.lit(otherwise))


def alpha(kind: Column, query: Column) -> Column:
    """The vector's share: the kind's; that of an exact query grows with its stop words."""
    return F.when(kind == "exact", se.exact_alpha(query)).otherwise(by_kind(kind, {k: v for k, v in se.ALPHA.items() if k != "default"}, se.ALPHA["default"]))


def planned(queries: DataFrame, now: Column, use_platform: bool = True) -> DataFrame:
    """Queries with their plan, and with since and until for temporal ones: the window named, or the last days before ``now``."""
    p = plans(queries).withColumn("alpha", alpha(F.col("strategy"), F.col("query")))
    since = F.coalesce(F.col("after").cast("timestamp"), F.when(F.col("recent_days").isNotNull(), F.date_trunc("day", now) - F.make_dt_interval(days=F.col("recent_days"))))
    p = p.withColumn("since", since).withColumn("until", F.col("before").cast("timestamp"))
    return p if use_platform else p.withColumn("platform", F.lit(None).cast("string"))


def _ranked(scored: DataFrame, key: str, limit: int) -> DataFrame:
    return se.top_k(scored.select("query_id", key, F.round("score", 9).alias("score")), limit, "score", key, ["query_id"]).select("query_id", key, "score", "rank")


Scorer = Callable[[DataFrame], Column]


def formula(pool: DataFrame) -> Column:
    """The default scorer: score, the summary's cosine and the share of the query's motifs that a passage has."""
    return se.formula_rank_score(F.col("score"), F.col("summary_cos"), F.col("query_motifs"), F.col("motifs"))


def adaptive_search(passages: DataFrame, queries: DataFrame, key: str = "tile_id", k: int = 10, now: Column | None = None, documents: DataFrame | None = None, postings: DataFrame | None = None, themes: DataFrame | None = None, scorer: Scorer = formula, use_platform: bool = True, strategies: DataFrame | None = None) -> DataFrame:
    """(query_id, key, strategy, score, rank_score, rank) for a table of queries (query_id, query, and qv for a vector lane).

    ``passages``: key, content_hash, content, platform, at (timestamp), and optionally vector, summary, motifs.
    ``documents``: content_hash, summary, motifs, laid over the passages found. ``postings``: key, motif_id, amp, for
    motif queries. ``themes``: query_id, theme_motifs, for conceptual ones. ``strategies``: query_id, strategy, instead
    of the classified ones. Order is by rank_score, which the scorer gives; score stays what the lanes gave, boosted or
    decayed. Copies of a content hash come once; a blank hash is no copy.
    """
    now = F.current_timestamp() if now is None else now
    fetch = 3 * k
    p = planned(queries, now, use_platform)
    if strategies is not None:
        p = p.drop("strategy").join(strategies.select("query_id", "strategy"), "query_id").withColumn("alpha", alpha(F.col("strategy"), F.col("query")))
        for c in ("since", "until"):
            p = p.withColumn(c, F.when(F.col("strategy") == "temporal", F.col(c)))
    p = written(p, "adaptive-plans")
    have = set(passages.columns)
    none = F.array().cast("array<string>")

    words = written(_ranked(se.bm25(passages, p, key, {"content": 1.0}, k=fetch, windowed=True), key, fetch), "adaptive-words")
    base = words
    if "vector" in have and "qv" in p.columns:
        s = se.cosine_pairs(passages, p, key, "vector", fetch, windowed=True).withColumnRenamed("similarity", "score")
        base = _ranked(se.relative_fusion(_ranked(s, key, fetch), words, key, p.select("query_id", "alpha")), key, fetch)
    base = written(base, "adaptive-base")
    if postings is not None:
        base = _with_motif_lists(base, passages, postings, p, key, fetch)

    hashes = passages.select(key, F.coalesce(F.nullif("content_hash", F.lit("")), F.concat(F.lit("id:"), F.col(key).cast("string"))).alias("h"))
    pool = base.withColumn("lane_order", F.lit(0)).withColumn("is_extra", F.lit(False))
    seen = base.join(hashes, key).select("query_id", "h").distinct()

    def extra(lane: DataFrame, kind: str, quota: int, order: int) -> DataFrame:
        """What a lane of one kind of query has found and the base has not, the first ``quota``."""
        new = lane.join(p.where(F.col("strategy") == kind).select("query_id"), "query_id", "left_semi").join(hashes, key).join(seen, ["query_id", "h"], "left_anti")
        w = Window.partitionBy("query_id").orderBy("rank")
        return new.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= quota).select("query_id", key, "score", "rank", F.lit(order).alias("lane_order"), F.lit(True).alias("is_extra"))

    pool = pool.unionByName(extra(words, "exact", WORD_LANE, 1))
    if "summary" in have:
        said = se.bm25(passages, p.where("strategy = 'conceptual'"), key, {"summary": 1.0}, k=fetch // 2, windowed=True)
        pool = pool.unionByName(extra(_ranked(said, key, fetch // 2), "conceptual", SUMMARY_LANE, 2))
    pool = se.pool_cap(pool, fetch, k)

    # the metadata of whole documents, then the scorer over the first of the pool
    cols = [key, "content_hash", "content", "at", *(c for c in ("summary", "motifs") if c in have)]
    pool = pool.join(passages.select(*cols), key)
    pool = pool.withColumn("summary", F.col("summary") if "summary" in have else F.lit(None).cast("string")).withColumn("motifs", F.coalesce("motifs", none) if "motifs" in have else none)
    if documents is not None:
        d = documents.select(F.col("content_hash").alias("__h"), F.col("summary").alias("__s"), F.col("motifs").alias("__m"))
        pool = pool.join(d, F.col("content_hash") == F.col("__h"), "left").withColumns({"summary": F.coalesce(F.nullif("__s", F.lit("")), "summary"), "motifs": F.when(F.size("__m") > 0, F.col("__m")).otherwise(F.col("motifs"))})
    pool = pool.join(p.select("query_id", "query", "strategy", F.col("motifs").alias("query_motifs")), "query_id").withColumn("summary_cos", F.lit(0.0))
    place = Window.partitionBy("query_id").orderBy("lane_order", "rank")
    pool = pool.withColumn("place", F.row_number().over(place)).where(F.col("place") <= by_kind(F.col("strategy"), RERANK, 30))
    pool = pool.withColumn("rank_score", F.round(scorer(pool), 9))
    first = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "place")
    pool = pool.withColumn("order", F.row_number().over(first))
    pool = se.keep_first(pool, "content_hash", key, "order", ["query_id"])
    pool = pool.withColumn("order", F.row_number().over(first)).where(F.col("order") <= k)

    if themes is not None:
        pool = pool.join(themes.select("query_id", "theme_motifs"), "query_id", "left")
        up = lambda c: F.transform(F.coalesce(c, none), F.upper)
        both = (F.size(up("motifs")) > 0) & (F.size(up("theme_motifs")) > 0) & (F.col("strategy") == "conceptual")
        pool = pool.withColumn("boost", F.when(both, BOOST * se.jaccard(F.array_distinct(up("motifs")), F.array_distinct(up("theme_motifs")))).otherwise(0.0))
    else:
        pool = pool.withColumn("boost", F.lit(0.0))
    age = timefn.age_days(F.col("at"), now)
    fresh = F.when(F.col("at").isNull() | (age < 0), F.lit(1.0)).otherwise(F.pow(F.lit(2.0), -age / HALF_LIFE["temporal"]))
    moved = F.col("score") + F.col("boost")
    pool = pool.withColumn("score", F.round(F.when(F.col("strategy") == "temporal", se.blended(moved, fresh, DECAY_WEIGHT)).otherwise(moved), 9))
    # a boost or a decay orders by score again
    again = (F.col("strategy") == "temporal") | (F.max("boost").over(Window.partitionBy("query_id")) > 0)
    final = Window.partitionBy("query_id").orderBy(F.desc(F.when(F.col("again"), F.col("score")).otherwise(F.col("rank_score"))), "order")
    return pool.withColumn("again", again).withColumn("rank", F.row_number().over(final)).select("query_id", key, "strategy", "score", "rank_score", "rank")


def _with_motif_lists(base: DataFrame, passages: DataFrame, postings: DataFrame, p: DataFrame, key: str, fetch: int) -> DataFrame:
    """The base ranking, with the motif queries' one fused by reciprocal rank with the passages of each motif that they name, strongest first."""
    named = p.where("strategy = 'motif'").select("query_id", F.explode("motifs").alias("motif_id"))
    lists = se.seen(named.join(postings, "motif_id").select("query_id", "motif_id", key, "amp"), passages, p, key)
    w = Window.partitionBy("query_id", "motif_id").orderBy(F.desc("amp"), key)
    lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= fetch).select("query_id", key, "rank", F.lit(MOTIF_WEIGHT).alias("weight"))
    asked = named.select("query_id").distinct()
    own = base.join(asked, "query_id", "left_semi").select("query_id", key, "rank", F.lit(1.0).alias("weight"))
    fused = _ranked(se.rrf(own.unionByName(lists), key), key, fetch)
    return base.join(asked, "query_id", "left_anti").unionByName(fused)


def better_of(first: DataFrame, second: DataFrame, least: float = LOW_SCORE) -> DataFrame:
    """For every query the first result list, unless its best score is below ``least`` and the second list's is higher."""
    top = lambda d, n: d.groupBy("query_id").agg(F.max("score").alias(n))
    c = top(first, "a").join(top(second, "b"), "query_id", "full").select("query_id", ((F.coalesce("a", F.lit(0.0)) < least) & (F.coalesce("b", F.lit(0.0)) > F.coalesce("a", F.lit(0.0)))).alias("use_second"))
    return first.join(c.where(~F.col("use_second")).select("query_id"), "query_id").unionByName(second.join(c.where("use_second").select("query_id"), "query_id"))


def search_with_retry(passages: DataFrame, queries: DataFrame, key: str = "tile_id", least: float = LOW_SCORE, **kw) -> DataFrame:
    """``adaptive_search``; queries whose best score is below ``least`` search again without platform and by the alternative of their kind, and keep the better list."""
    first = written(adaptive_search(passages, queries, key, **kw), "adaptive-first")
    best = first.groupBy("query_id").agg(F.max("score").alias("best"))
    low = queries.join(best, "query_id", "left").where(F.coalesce("best", F.lit(0.0)) < least).drop("best")
    low = written(low, "adaptive-low")
    if not low.limit(1).count():
        return first
    kinds = plans(low).select("query_id", reduce(lambda c, kv: F.when(F.col("strategy") == kv[0], F.lit(kv[1])).otherwise(c), ALTERNATIVE.items(), F.lit("default")).alias("strategy"))
    return better_of(first, adaptive_search(passages, low, key, use_platform=False, strategies=kinds, **kw), least)
