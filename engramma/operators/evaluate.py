"""Retrieval metrics over ranked result tables (query_id, rank from 1, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.operators.ordered import numbered

def recall_at(ranked: DataFrame, relevant: DataFrame, key: str, cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query_id, cutoff, recall): the share of a query's relevant keys among its first ``cutoff``; -1 without any."""
    n = relevant.groupBy("query_id").agg(F.count_distinct(key).alias("n_relevant"))
    hit = ranked.join(relevant.select("query_id", key).distinct(), ["query_id", key])
    g = hit.groupBy("query_id").agg(*(F.count_distinct(F.when(F.col("rank") <= k, F.col(key))).alias(f"h{k}") for k in cutoffs))
    all_q = ranked.select("query_id").distinct().join(n, "query_id", "left").join(g, "query_id", "left")
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("cutoff"), F.coalesce(F.col(f"h{k}"), F.lit(0)).alias("h")) for k in cutoffs)))
    return all_q.select("query_id", "n_relevant", rows.alias("x")).select("query_id", "x.cutoff", F.when(F.col("n_relevant").isNull(), F.lit(-1.0)).otherwise(F.col("x.h") / F.col("n_relevant")).alias("recall"))


def mrr(ranked: DataFrame, is_relevant: Column) -> DataFrame:
    """(query_id, mrr): one over the first relevant rank, 0 if there is none."""
    return ranked.groupBy("query_id").agg(F.coalesce(1 / F.min(F.when(is_relevant, F.col("rank"))), F.lit(0.0)).alias("mrr"))


def precision_at(ranked: DataFrame, is_relevant: Column, k: int) -> DataFrame:
    top = ranked.where(F.col("rank") <= k)
    return top.groupBy("query_id").agg(F.avg(is_relevant.cast("double")).alias("precision"))


def ndcg_at(ranked: DataFrame, gain: str, k: int) -> DataFrame:
    """(query_id, ndcg) with the ideal order of the same rows; 0 where nothing is relevant."""
    ideal = ranked.withColumn("__i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(gain), "rank")))
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col(gain) / F.log2(F.col(r) + 1)).otherwise(0.0))
    g = ideal.groupBy("query_id").agg(part("rank").alias("dcg"), part("__i").alias("best"))
    return g.select("query_id", F.when(F.col("best") == 0, F.lit(0.0)).otherwise(F.col("dcg") / F.col("best")).alias("ndcg"))


def dedup_ratio(ranked: DataFrame, content_hash: str, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k).groupBy("query_id").agg((F.count_distinct(content_hash) / F.count("*")).alias("dedup_ratio"))


def index_percentiles(rows: DataFrame, value: str, percents: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, one column a name): sorted[min(int(n * p / 100), n - 1)] of the values that are not null, without interpolation.

    Values are counted first, so what is ordered in a group are its different values.
    """
    keys = list(by) or ["__all"]
    c = rows.where(F.col(value).isNotNull()).withColumn("__all", F.lit(0)).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    c = c.withColumn("__t", F.sum("__n").over(w)).withColumn("__upto", F.sum("__n").over(w.orderBy("__v")))
    at = lambda p: F.least(F.floor(F.col("__t") * F.lit(p) / 100), F.col("__t") - 1)
    out = c.groupBy(*keys).agg(*(F.min(F.when(F.col("__upto") > at(p), F.col("__v"))).alias(name) for name, p in percents.items()))
    return out if by else out.drop("__all")


def mean_known(x: Column) -> Column:
    """The mean of values that are not the marker -1; an aggregate."""
    return F.avg(F.when(x >= 0, x))


def wilcoxon(pairs: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, w_plus, w_minus, statistic, p_value): signed ranks of a - b without zeros, ties at their mean rank.

    The p-value is the normal approximation, 1 below five pairs.
    """
    d = pairs.select(*by, (F.col(a) - F.col(b)).alias("__d")).where("__d <> 0").withColumn("__a", F.abs("__d"))
    if by:
        w = Window.partitionBy(*by).orderBy("__a")
        d = d.withColumn("__lo", F.rank().over(w)).withColumn("__m", F.count("*").over(Window.partitionBy(*by, "__a")))
    else:
        ties = numbered(d, "__a", name="__lo").groupBy("__a").agg(F.min("__lo").alias("__lo"), F.count("*").alias("__m"))
        d = d.join(ties, "__a")
    d = d.withColumn("__r", F.col("__lo") + (F.col("__m") - 1) / 2)
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("__d") < 0, F.col("__r"))), F.lit(0.0)).alias("w_minus"))
    g = g.withColumn("statistic", F.least("w_plus", "w_minus"))
    z = F.abs(F.col("statistic") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24)
    # Abramowitz and Stegun 26.2.17, of the upper tail
    t = 1 / (1 + 0.2316419 * z)
    tail = F.exp(-z * z / 2) / F.lit(2.5066282746310002) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
    return g.withColumn("p_value", F.when(F.col("n") < 5, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)))


def regression_gate(old: DataFrame, new: DataFrame, allowed_drop: float = 0.02) -> DataFrame:
    """(metric, old, new, delta, pct, regressed) of two runs (metric, value)."""
    j = old.select("metric", F.col("value").alias("old")).join(new.select("metric", F.col("value").alias("new")), "metric")
    j = j.withColumn("delta", F.col("new") - F.col("old"))
    return j.withColumn("pct", F.when(F.col("old") != 0, 100 * F.col("delta") / F.col("old"))).withColumn("regressed", F.col("new") < F.col("old") - allowed_drop)


def term_recall(ranked: DataFrame, terms: DataFrame, text: str, cutoffs: tuple[int, ...] = (5, 10), head: int = 2000) -> DataFrame:
    """(query_id, cutoff, recall): the share of a query's terms (query_id, term) that the heads of its first texts hold, in any case; -1 without terms.

    ``head`` is the rule's own limit on what is searched of a text.
    """
    t = terms.select("query_id", F.lower("term").alias("term")).where("term <> ''").distinct()
    first = ranked.where(F.col("rank") <= max(cutoffs)).select("query_id", "rank", F.lower(F.substring(text, 1, head)).alias("__t"))
    best = t.join(first, "query_id", "left").groupBy("query_id", "term").agg(F.min(F.when(F.col("__t").contains(F.col("term")), F.col("rank"))).alias("at"))
    g = best.groupBy("query_id").agg(*(F.avg((F.coalesce("at", F.lit(2**31 - 1)) <= k).cast("double")).alias(f"r{k}") for k in cutoffs))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("cutoff"), F.coalesce(F.col(f"r{k}"), F.lit(-1.0)).alias("recall")) for k in cutoffs)))
    return ranked.select("query_id").distinct().join(g, "query_id", "left").select("query_id", rows.alias("x")).select("query_id", "x.*")


def motif_precision(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(query_id, precision): the share of the first ``k`` results that have an expected motif; -1 without expected motifs. ``expected`` is (query_id, motifs)."""
    e = expected.select("query_id", F.col("motifs").alias("__e"))
    j = ranked.where(F.col("rank") <= k).join(e, "query_id", "left")
    hit = F.arrays_overlap(F.coalesce("motifs", F.array().cast("array<string>")), F.col("__e"))
    return j.groupBy("query_id").agg(F.avg(F.when(F.size("__e") > 0, F.coalesce(hit, F.lit(False)).cast("double"))).alias("p")).select("query_id", F.coalesce("p", F.lit(-1.0)).alias("precision"))


def motif_overlap(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap): the mean share of a query's expected motifs that its first ``k`` results have; 0 without any."""
    j = ranked.where(F.col("rank") <= k).join(expected.select("query_id", F.col("motifs").alias("__e")), "query_id")
    own = F.size(F.array_intersect(F.coalesce("motifs", F.array().cast("array<string>")), F.col("__e"))) / F.size("__e")
    return j.groupBy("query_id").agg(F.avg(F.when(F.size("__e") > 0, own).otherwise(0.0)).alias("overlap"))


def gold(ranked: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(query_id, gold_recall, gold_mrr) of one wanted content hash a query (query_id, gold_hash): whether it is among the first ``k``, one over its first rank; -1 where none is wanted."""
    j = ranked.join(wanted, "query_id", "left")
    at = F.min(F.when(F.col("content_hash") == F.col("gold_hash"), F.col("rank")))
    g = j.groupBy("query_id").agg(at.alias("at"), F.max("gold_hash").alias("w"))
    known = lambda c: F.when(F.col("w").isNull(), F.lit(-1.0)).otherwise(c)
    return g.select("query_id", known(F.when(F.col("at") <= k, 1.0).otherwise(0.0)).alias("gold_recall"), known(F.coalesce(1 / F.col("at"), F.lit(0.0))).alias("gold_mrr"))


def judged(similarity: Column) -> Column:
    """Relevance of a result by its cosine with the query: 2 from 0.55, 1 from 0.35, else 0."""
    return F.when(similarity >= 0.55, 2).when(similarity >= 0.35, 1).otherwise(0)


def eval_rank_score(score: Column, jaccard: Column, enriched: Column, phi: Column, trust: Column) -> Column:
    """0.50 score, 0.35 overlap of motifs and 0.15 of a bonus that enriched results have."""
    bonus = F.when(enriched, 0.05 + 0.05 * (F.coalesce(phi, F.lit(0.0)) + F.coalesce(trust, F.lit(0.0)))).otherwise(0.0)
    return 0.50 * score + 0.35 * jaccard + 0.15 * bonus


def strategy_means(metrics: DataFrame, value: str = "value") -> DataFrame:
    """(strategy, category, metric, mean, n) of rows (strategy, category, metric, value), for each category and, with a null category, for all; values of -1 are unknown."""
    return metrics.groupingSets([["strategy", "category", "metric"], ["strategy", "metric"]], "strategy", "category", "metric").agg(mean_known(F.col(value)).alias("mean"), F.count("*").alias("n"))


def ablation(results: DataFrame, relevance: str = "relevance") -> DataFrame:
    """(enriched, mean, n): mean relevance of enriched results and of the others."""
    return results.groupBy(F.coalesce("enriched", F.lit(False)).alias("enriched")).agg(F.avg(relevance).alias("mean"), F.count("*").alias("n"))


def duplicate_report(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, same names) of files (path, content_hash): contents with several paths and their canonical, the shortest, path; names that stand for several contents."""
    c = files.groupBy("content_hash").agg(F.count("*").alias("n"), F.min_by("path", F.struct(F.length("path"), "path")).alias("canonical"), F.array_sort(F.collect_set("path")).alias("paths")).where("n > 1")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    same = files.groupBy(name.alias("name")).agg(F.count_distinct("content_hash").alias("n_contents"), F.count("*").alias("n")).where("n_contents > 1")
    return c, same
