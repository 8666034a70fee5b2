"""Seeded samples and test query sets; searches by all strategies at once; events through a message log; windows and intervals of event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramma.operators import dictionary as dc
from engramma.operators import sampling as sm
from engramma.plans import strategies as sg
from engramma.queries.passages import _BQ, _COS, ANCHORS, _docs, _lane_queries, bm25_sql
from engramma.queries.retrieval import SQL as _RETRIEVAL_SQL
from engramma.queries.retrieval import motif_dictionary
from engramma.session import table
from engramma.storage import new_path
from engramma.streaming import log, windows


def random_sample(spark, d):
    """A hundredth of each source's documents, ten at least."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return sm.sample(docs, "doc_id", F.greatest(F.lit(10), F.floor(F.col("n") / 100)), "source")


def query_set(spark, d):
    """A hundred test queries of motifs found in all documents, in exact shares; benchmark items are off topic."""
    found = motif_dictionary(spark, d).select(F.col("doc_id").alias("key"), "motif_id")
    other = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("name"), "text")
    q = sm.query_set(sm.query_candidates(found, dc.standard_dictionary(), other))
    return q.select("query_id", "category", "name", "text", F.array_join("expected_motifs", ",").alias("motifs"))


DEPTH = 20


def _searched(spark, d):
    """Every benchmark item by seven strategies over all documents: a document's vector is that of its number, its summary's that of the next, its motif its language."""
    docs, e = _docs(spark, d), table(spark, d, "embeddings")
    t = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("content"), F.col("source").alias("summary"), F.col("source").alias("platform"), "lang", F.md5(F.encode("text", "utf-8")).alias("content_hash"), F.col("source").alias("session_id"))
    v = lambda name, shift: e.select((F.col("vec_id") - shift).alias("key"), F.col("embedding").alias(name))
    t = t.join(v("vector", 0), "key", "left").join(v("summary_vector", 1), "key", "left")
    q = _lane_queries(spark, d).select("query_id", F.concat_ws(" ", "query", F.lit("src1")).alias("query"), "qv", F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("src"), (F.col("query_id") % 5).cast("string"))).alias("platform"), F.when(F.col("query_id") % 2 == 0, "fr").alias("motif_id"))
    postings = t.select("key", F.col("lang").alias("motif_id"), (F.col("key") % 100 / 100).alias("amp"))
    return t, sg.run(t, q, postings, depth=DEPTH)


def strategy_lanes(spark, d):
    """The best of every lane."""
    return _searched(spark, d)[1].withColumn("score", F.round("score", 6)).where("rank <= 10")


def strategy_merged(spark, d):
    """The lanes fused, with the names of the lanes that found each document."""
    m = sg.merged(_searched(spark, d)[1]).where("place <= 10")
    return m.select("query_id", "place", "key", "score", F.array_join("strategies", ",").alias("strategies"), "best_rank")


def message_log(spark, d):
    """All events through a log in three segments, to a consumer that fails every seventh once."""
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("body"), F.col("event_id"))
    folder, out = new_path(spark, "log"), new_path(spark, "log-out")
    for k in range(3):
        log.append(e.where(F.col("event_id") % 3 == k), folder)
    handle = lambda df: df.withColumn("ok", (F.col("id").cast("long") % 7 != 0) | (F.col("tries") > 0))
    for _ in range(2):  # the second run finds what the first could not handle
        log.consume(log.messages(spark, folder, "all"), handle, folder, out, f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(log.MESSAGE).parquet(f"{out}/done/*").select(F.col("id").cast("long").alias("event_id"), "body", "tries")


def sliding_windows(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("at"))
    w = windows.sliding_counts(e, "at", "event_type", width="6 hours", slide="2 hours")
    return w.select(F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "event_type", "n")


def event_intervals(spark, d):
    """Every purchase with the same user's clicks in the two hours before it."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("row"), "event_type")
    j = windows.interval_join(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "at", "2 HOURS")
    return j.select("user_id", F.col("left").alias("click"), F.col("right").alias("purchase"))


QUERIES = {f.__name__: f for f in (random_sample, query_set, strategy_lanes, strategy_merged, message_log, sliding_windows, event_intervals)}
_NAMES = "(VALUES " + ", ".join(f"('{m.motif_id}', '{m.band}', '{m.motif_id.partition('.')[2].lower().replace('_', ' ')}')" for m in dc.STANDARD) + ") v(motif_id, band, phrase)"
_VEC = "SELECT b.item_id AS query_id, {key} AS key, " + _COS.format(a="embedding", b="av") + " AS score FROM embeddings, " + ANCHORS + " a, benchmark b WHERE a.label = b.item_id % 10 AND {key} IN (SELECT doc_id FROM documents)"
_BEST = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM (SELECT query_id, key, round(score, 9) AS score FROM ({})) QUALIFY rank <= " + str(DEPTH)
_STRETCH = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
_WORDS = f"SELECT query_id, doc_id AS key, score FROM ({bm25_sql('documents', 'doc_id', 'text', _BQ)}) WHERE query_id % 10 IN (SELECT label FROM embeddings)"
_FIELDS = f"SELECT query_id, doc_id AS key, sum(score) AS score FROM (SELECT * FROM ({bm25_sql('documents', 'doc_id', 'text', _BQ)}) UNION ALL SELECT query_id, doc_id, 2.0 * score FROM ({bm25_sql('documents', 'doc_id', 'source', _BQ)})) WHERE query_id % 10 IN (SELECT label FROM embeddings) GROUP BY ALL"
_LANES = f"""
words AS ({_BEST.format(_WORDS)}), vector AS ({_BEST.format(_VEC.format(key='vec_id'))}),
filtered AS (SELECT v.* FROM ({_VEC.format(key='vec_id')}) v JOIN documents d ON d.doc_id = v.key WHERE query_id % 3 <> 0 OR source = 'src' || (query_id % 5)),
motif AS (SELECT item_id AS query_id, doc_id AS key, CAST(doc_id % 100 AS DOUBLE) / 100 AS score FROM benchmark b, documents WHERE b.item_id % 2 = 0 AND lang = 'fr' AND documents.text IS NOT NULL AND b.item_id % 10 IN (SELECT label FROM embeddings)),
hybrid AS (
  SELECT query_id, key, 0.65 * coalesce(v, 0) + (1 - CAST(0.65 AS DOUBLE)) * coalesce(l, 0) AS score
  FROM (SELECT query_id, key, {_STRETCH} AS v FROM vector WINDOW w AS (PARTITION BY query_id)) FULL JOIN (SELECT query_id, key, {_STRETCH} AS l FROM words WINDOW w AS (PARTITION BY query_id)) USING (query_id, key)),
lanes AS (
  SELECT 'words' AS strategy, * FROM words UNION ALL SELECT 'vector', * FROM vector
  UNION ALL SELECT 'fields', * FROM ({_BEST.format(_FIELDS)}) UNION ALL SELECT 'summary_vector', * FROM ({_BEST.format(_VEC.format(key='vec_id - 1'))})
  UNION ALL SELECT 'filtered_vector', * FROM ({_BEST.format('SELECT * FROM filtered')}) UNION ALL SELECT 'motif', * FROM ({_BEST.format('SELECT * FROM motif')})
  UNION ALL SELECT 'hybrid', * FROM ({_BEST.format('SELECT * FROM hybrid')}))"""
SQL = {
    "strategy_lanes": f"WITH {_LANES} SELECT query_id, strategy, key, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM lanes WHERE rank <= 10",
    "strategy_merged": f"""WITH {_LANES},
m AS (SELECT query_id, key, round(sum(CAST(1 AS DOUBLE) / (59 + rank)), 9) AS score, array_to_string(list_sort(list(DISTINCT strategy)), ',') AS strategies, CAST(min(rank) AS INTEGER) AS best_rank FROM lanes GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS place, key, score, strategies, best_rank FROM m QUALIFY place <= 10""",
    "random_sample": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= greatest(10, n // 100)",
    "query_set": f"""
WITH a AS (SELECT DISTINCT doc_id, motif_id, band, phrase FROM ({_RETRIEVAL_SQL['motif_dictionary'].strip()}) JOIN (SELECT motif_id, phrase FROM {_NAMES}) USING (motif_id)),
c AS (
  SELECT DISTINCT 'single_motif' AS category, 40 AS quota, motif_id || '/what' AS name, 'What is ' || phrase || '?' AS text, motif_id AS motifs FROM a
  UNION ALL SELECT DISTINCT 'single_motif', 40, motif_id || '/how', 'How does ' || phrase || ' show?', motif_id FROM a
  UNION ALL SELECT DISTINCT 'multi_motif', 30, x.motif_id || '+' || y.motif_id, 'How does ' || x.phrase || ' relate to ' || y.phrase || '?', x.motif_id || ',' || y.motif_id FROM a x JOIN a y ON x.doc_id = y.doc_id AND x.motif_id < y.motif_id
  UNION ALL SELECT DISTINCT 'thematic', 20, band || '/' || motif_id, 'Which ' || band || ' patterns come with ' || phrase || '?', motif_id FROM a
  UNION ALL SELECT 'adversarial', 10, CAST(item_id AS VARCHAR), text, '' FROM benchmark),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || category || '|' || name), name) - 1 AS r FROM c)
SELECT category || '_' || lpad(CAST(r AS VARCHAR), 3, '0') AS query_id, category, name, text, motifs FROM r WHERE r < quota""",
    "message_log": "SELECT event_id, event_type AS body, CAST(event_id % 7 = 0 AS BIGINT) AS tries FROM events",
    "sliding_windows": "SELECT s AS start, s + 21600 AS \"end\", event_type, count(*) AS n FROM (SELECT event_type, (CAST(epoch(ts) AS BIGINT) // 7200 - unnest([0, 1, 2])) * 7200 AS s FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events)) GROUP BY ALL",
    "event_intervals": "SELECT a.user_id, a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
}
