"""The library called from Spark SQL by name; audits and histograms of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramma.functions.register import register
from engramma.operators import audit as au
from engramma.queries.memory import SQL as _MEMORY_SQL
from engramma.queries.passages import SQL as _PASSAGE_SQL
from engramma.session import table


def _views(spark, d, *names):
    register(spark)
    for n in names:
        table(spark, d, n).createOrReplaceTempView(f"em_{n}")


def sql_tiles(spark, d):
    _views(spark, d, "documents")
    return spark.sql("SELECT doc_id, x.tile_index, x.start_char, x.end_char, md5(encode(x.content, 'utf-8')) AS content_md5, em_token_estimate(x.content) AS token_count FROM em_documents, LATERAL em_tiles(text, 2048, 752) x WHERE text IS NOT NULL")


def sql_sessions(spark, d):
    _views(spark, d, "events")
    return spark.sql("""
        SELECT CAST(key AS BIGINT) AS user_id, session_index, count(*) AS n_events, min(tie) AS first_event
        FROM em_sessions(TABLE(SELECT CAST(user_id AS STRING) AS key, CAST(ts AS TIMESTAMP) AS at, event_id AS tie FROM em_events) PARTITION BY key ORDER BY (at, tie), 7200) GROUP BY ALL""")


def sql_entropy(spark, d):
    _views(spark, d, "events")
    return spark.sql("SELECT user_id, round(em_entropy(ns), 6) AS entropy FROM (SELECT user_id, collect_list(n) AS ns FROM (SELECT user_id, event_type, count(*) AS n FROM em_events GROUP BY ALL) GROUP BY user_id)")


def store_audit(spark, d):
    """The documents against a copy that lacks some, has some more, and changed others."""
    a = table(spark, d, "documents").select("doc_id", "source", F.md5(F.encode("text", "utf-8")).alias("h"))
    b = a.where("doc_id % 11 <> 0").withColumn("h", F.when(F.col("doc_id") % 13 == 0, F.lit("other")).otherwise(F.col("h")))
    b = b.unionByName(a.where("doc_id % 17 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000))
    return au.audit(a, b, ["doc_id"], bits=8)


def equal_depth_bins(spark, d):
    """Orders by price in eight bins for each priority: their rows, and whether each bin holds an eighth to within the sketch's error."""
    b = au.equal_depth(table(spark, d, "orders"), "o_totalprice", 8, "o_orderpriority")
    total = b.groupBy("o_orderpriority").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_bins"), F.min("n").alias("least"), F.max("n").alias("most"))
    near = F.greatest(F.abs(F.col("least") - F.col("n_rows") / 8), F.abs(F.col("most") - F.col("n_rows") / 8)) <= 2 + 0.002 * F.col("n_rows")
    return total.select("o_orderpriority", "n_rows", "n_bins", near.alias("even"))


QUERIES = {f.__name__: f for f in (sql_tiles, sql_sessions, sql_entropy, store_audit, equal_depth_bins)}
SQL = {
    "sql_tiles": _PASSAGE_SQL["tile_boundaries_512"],
    "sql_sessions": _MEMORY_SQL["gap_sessions"],
    "sql_entropy": _MEMORY_SQL["event_entropy"],
    "store_audit": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'changed' END AS status FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 UNION ALL SELECT doc_id + 1000000000, 'extra' FROM documents WHERE doc_id % 17 = 0",
    "equal_depth_bins": "SELECT o_orderpriority, count(*) AS n_rows, CAST(8 AS BIGINT) AS n_bins, true AS even FROM orders GROUP BY o_orderpriority",
}
