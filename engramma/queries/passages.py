"""Identity, de-duplication and passages of ``documents``; lexical and vector ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.functions import text as tx
from engramma.functions.vector import norm
from engramma.operators import search as se
from engramma.operators import tiling as ti
from engramma.session import table

QUERY = "the order of thin that eronthwh"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def dedup_exact_hash(spark, d):
    return _docs(spark, d).groupBy(tx.sha16(F.col("text")).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def content_hash(spark, d):
    return _docs(spark, d).select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


def normalised_exchange_hash(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.exchange_hash(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("hash"))


def content_uuid(spark, d):
    return _docs(spark, d).select("doc_id", tx.uuid5(F.concat(tx.sha16(F.col("text")), F.lit(":search_512:0"))).alias("uuid"))


def token_estimate(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.sum(tx.token_estimate(F.col("text"))).alias("tokens"))


def tile_starts_512(spark, d):
    chunk, step = ti.SCALES["search_512"]
    return ti.tile_grid(_docs(spark, d), chunk, step).select("doc_id", "tile_index", "start_char", "grid_end")


_GRID = """
  SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) <= {c} THEN 0 ELSE (length(text) - {s} // 2) // {s} END AS last FROM documents WHERE text IS NOT NULL"""


def grid_sql(c: int, s: int) -> str:
    return f"""
  SELECT doc_id, text, n, i AS tile_index, CASE WHEN n <= {c} THEN 0 ELSE i * {s} END AS start_char,
         CASE WHEN n <= {c} OR (i = last AND (last + 1) * {s} < n) THEN n ELSE least(i * {s} + {c}, n) END AS grid_end
  FROM (SELECT *, unnest(range(0, last + 1)) AS i FROM ({_GRID.format(c=c, s=s)}))"""


def tile_sql(scale: str) -> str:
    c, s = ti.SCALES[scale]
    t = int(0.8 * c)
    return f"""
  SELECT *, substring(text, CAST(start_char + 1 AS BIGINT), CAST(end_char - start_char AS BIGINT)) AS content, '{scale}' AS scale, (end_char - start_char) // 4 AS token_count FROM (
    SELECT *, CASE WHEN grid_end >= n THEN grid_end WHEN strpos(back, chr(10) || chr(10)) > 0 THEN grid_end - strpos(back, chr(10) || chr(10)) + 1
                   WHEN strpos(back, ' .') > 0 THEN grid_end - strpos(back, ' .') + 1 ELSE grid_end END AS end_char FROM (
      SELECT *, CASE WHEN grid_end - start_char - {t} > 0 THEN reverse(substring(text, CAST(start_char + {t} + 1 AS BIGINT), CAST(grid_end - start_char - {t} AS BIGINT))) ELSE '' END AS back FROM ({grid_sql(c, s)})))"""


def tile_boundaries_512(spark, d):
    return ti.tiles(_docs(spark, d), "search_512").select("doc_id", "tile_index", "start_char", "end_char", F.md5(F.encode("content", "utf-8")).alias("content_md5"), "token_count")


def tile_multi_scale_counts(spark, d):
    return ti.multi_scale(_docs(spark, d)).groupBy("scale").agg(F.count("*").alias("n_tiles"), F.count_distinct("doc_id").alias("n_docs"), F.sum(F.length("content")).alias("chars"))


ALL_TILES = " UNION ALL ".join(f"SELECT doc_id, text, tile_index, start_char, end_char, content, scale, token_count FROM ({tile_sql(s)})" for s in ti.SCALES)


def tile_parent_link(spark, d):
    docs = _docs(spark, d)
    return ti.with_parents(ti.tiles(docs, "search_512"), ti.tiles(docs, "context_2048"), "doc_id").select("doc_id", "tile_index", "parent_index")


def tile_rebuild(spark, d):
    return ti.rebuilt(ti.tiles(_docs(spark, d), "search_512"), "doc_id").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def tile_stats(spark, d):
    return ti.tile_stats(ti.tiles(_docs(spark, d), "search_512"), "lang")


def canonical_object(spark, d):
    t = ti.multi_scale(_docs(spark, d).withColumn("content_hash", tx.sha16(F.col("text"))))
    return ti.canonical_objects(t).select("content_hash", "tile_count_512", "tile_count_2048", "tile_count_4096", "total_tokens", F.md5(F.encode("representative", "utf-8")).alias("representative_md5"))


def bm25_topk(spark, d):
    """Tiles of de-duplicated documents by BM25, the best tile for each document, ten documents."""
    docs = _docs(spark, d)
    first = docs.groupBy(tx.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    t = ti.tiles(docs.join(first, "doc_id", "left_semi"), "search_512").withColumn("tile_id", F.concat_ws(":", "doc_id", "tile_index"))
    q = spark.range(1).select(F.lit("q").alias("query_id"), F.lit(QUERY).alias("query"))
    s = se.bm25(t, q, "tile_id", {"content": 1.0}).withColumn("doc_id", F.substring_index("tile_id", ":", 1).cast("long"))
    best = s.groupBy("doc_id").agg(F.round(F.max("score"), 6).alias("score"))
    return se.top_k(best, 10, "score", "doc_id").select("doc_id", "score", "rank")


_CANON = r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)[ \t\x0b\f]+$', '', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')"


def bm25_sql(rel: str, key: str, field: str, queries: str) -> str:
    return f"""
  SELECT query_id, {key}, sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM (
    SELECT p.*, count(*) OVER (PARTITION BY term, query_id) AS df FROM (
      SELECT {key}, len, term, query_id, count(*) AS tf FROM (
        SELECT w.{key}, w.len, t.term, q.query_id FROM (SELECT {key}, len(ws) AS len, unnest(ws) AS term FROM (SELECT {key}, regexp_extract_all(lower(coalesce({field}, '')), '\\p{{L}}+|\\p{{N}}+') AS ws FROM {rel})) w
        JOIN (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '\\p{{L}}+|\\p{{N}}+')) AS term FROM {queries}) q ON q.term = w.term, (SELECT w.term) t) GROUP BY ALL) p),
    (SELECT count(*) AS nd, avg(len(regexp_extract_all(lower(coalesce({field}, '')), '\\p{{L}}+|\\p{{N}}+'))) AS al FROM {rel}) GROUP BY query_id, {key}""".replace("\\\\", "\\")


def bm25_fields(spark, d):
    """Weighted fields: text once, source twice; every benchmark item's whole text is a query; three documents each."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "text", F.lit("src1")).alias("query"))
    s = se.bm25(_docs(spark, d), q, "doc_id", {"text": 1.0, "source": 2.0}, k=3).withColumn("score", F.round("score", 6))
    return se.top_k(s, 3, "score", "doc_id", ["query_id"]).select("query_id", "doc_id", "score", "rank")


_BQ = "(SELECT item_id AS query_id, text || ' src1' AS query FROM benchmark)"


def _anchors(spark, d):
    """The mean vector of each label."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    m = e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("av"))


ANCHORS = "(SELECT label, list(m ORDER BY pos) AS av FROM (SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 9) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"
_COS = "list_dot_product(CAST({a} AS DOUBLE[]), {b}) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product({b}, {b})))"
COS_ANCHOR = _COS.format(a="embedding", b="av")


def vector_topk(spark, d):
    q = _anchors(spark, d).select(F.col("label").alias("query_id"), F.col("av").alias("qv"))
    s = se.vector_search(table(spark, d, "embeddings").withColumn("embedding", F.col("embedding")), q, 8)
    return s.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def batch_vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    s = se.vector_search(e, q, 3)
    return s.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def vector_certainty_floor(spark, d):
    q = _anchors(spark, d).select(F.col("label").alias("query_id"), F.col("av").alias("qv"))
    return se.vector_search(table(spark, d, "embeddings"), q, 2**31 - 1, floor=0.7).groupBy("query_id").agg(F.count("*").alias("n"))


def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


LANES = 20


def _lane_queries(spark, d):
    """Every benchmark item as a query; its vector is the anchor of one of the labels, by its number."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return q.join(_anchors(spark, d), F.col("query_id") % 10 == F.col("label")).select("query_id", "query", F.col("av").alias("qv"))


def _lanes(spark, d):
    """Documents by words and by vectors (a document's vector is that of its number), the best ``LANES`` of each lane a query."""
    q = _lane_queries(spark, d)
    lex = se.top_k(se.bm25(_docs(spark, d), q, "doc_id", {"text": 1.0}, k=LANES).withColumn("score", F.round("score", 6)), LANES, "score", "doc_id", ["query_id"])
    held = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id").join(_docs(spark, d).select("doc_id"), "doc_id", "left_semi")
    vec = se.vector_search(held, q, LANES, key="doc_id").withColumn("score", F.round("similarity", 6))
    return lex.select("query_id", "doc_id", "score", "rank"), vec.select("query_id", "doc_id", "score", "rank")


_LQ = "(SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 10 IN (SELECT label FROM embeddings))"
LEX = f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM ({bm25_sql('documents', 'doc_id', 'text', _LQ)})) QUALIFY rank <= {LANES}"
VEC = f"SELECT query_id, vec_id AS doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT b.item_id AS query_id, vec_id, {COS_ANCHOR} AS s FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)), {ANCHORS} a, benchmark b WHERE a.label = b.item_id % 10) QUALIFY rank <= {LANES}"


def hybrid_relative(spark, d):
    lex, vec = _lanes(spark, d)
    return se.relative_fusion(vec, lex, "doc_id", 0.65).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def rrf_equal(spark, d):
    lex, vec = _lanes(spark, d)
    both = lex.withColumn("weight", F.lit(1.0)).unionByName(vec.withColumn("weight", F.lit(1.0)))
    return se.rrf(both, "doc_id").select("query_id", "doc_id", F.round("score", 9).alias("score"), F.col("n_lists").alias("n_lists"))


def rrf_weighted(spark, d):
    lex, vec = _lanes(spark, d)
    both = lex.withColumn("weight", F.lit(2.0)).unionByName(vec.withColumn("weight", F.lit(0.5)))
    return se.rrf(both, "doc_id", rank_base=0).select("query_id", "doc_id", F.round("score", 9).alias("score"), "best_rank")


def pool_cap(spark, d):
    lex, vec = _lanes(spark, d)
    pool = lex.withColumn("lane_order", F.lit(0)).withColumn("is_extra", F.lit(False)).unionByName(vec.withColumn("lane_order", F.lit(1)).withColumn("is_extra", F.col("rank") <= 10))
    return se.pool_cap(pool, 25, 10).select("query_id", "doc_id", "lane_order", "rank")


def keep_first_dedup(spark, d):
    r = _docs(spark, d).select("doc_id", F.when(F.length("text") > 20, F.md5(F.encode("text", "utf-8"))).otherwise("").alias("content_hash"), (-F.col("n_chars")).alias("rank"))
    return se.keep_first(r, "content_hash", "doc_id").select("doc_id", "content_hash")


def where_filter(spark, d):
    t = _docs(spark, d).withColumn("priority", F.length("text"))
    return t.where(se.where_filter(lang="en", source="src0", min_priority=1000)).select("doc_id", "priority")


def query_alpha(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.round(se.exact_alpha(F.col("text")), 6).alias("alpha"))


QUERIES = {f.__name__: f for f in (dedup_exact_hash, content_hash, normalised_exchange_hash, content_uuid, token_estimate, tile_starts_512, tile_boundaries_512, tile_multi_scale_counts, tile_parent_link, tile_rebuild, tile_stats, canonical_object, bm25_topk, bm25_fields, vector_topk, batch_vector_topk, vector_certainty_floor, vector_norms, hybrid_relative, rrf_equal, rrf_weighted, pool_cap, keep_first_dedup, where_filter, query_alpha)}

_T512 = tile_sql("search_512")
_STOP = ", ".join(f"'{w}'" for w in se.STOP_WORDS)
SQL = {
    "dedup_exact_hash": "SELECT substring(sha256(text), 1, 16) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "content_hash": f"SELECT doc_id, substring(sha256({_CANON}), 1, 16) AS hash FROM documents",
    "normalised_exchange_hash": r"SELECT conv_id, turn, substring(sha256(trim(regexp_replace(lower(coalesce(role, '')), '\s+', ' ', 'g')) || chr(10) || trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+', ' ', 'g'))), 1, 16) AS hash FROM conversations",
    "content_uuid": "SELECT doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', CAST(((strpos('0123456789abcdef', substring(h, 17, 1)) - 1) & 3) + 1 AS BIGINT), 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS uuid FROM (SELECT doc_id, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(substring(sha256(text), 1, 16) || ':search_512:0')) AS h FROM documents)",
    "token_estimate": "SELECT lang, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY lang",
    "tile_starts_512": f"SELECT doc_id, tile_index, start_char, grid_end FROM ({grid_sql(*ti.SCALES['search_512'])})",
    "tile_boundaries_512": f"SELECT doc_id, tile_index, start_char, end_char, md5(content) AS content_md5, token_count FROM ({_T512})",
    "tile_multi_scale_counts": f"SELECT scale, count(*) AS n_tiles, count(DISTINCT doc_id) AS n_docs, CAST(sum(length(content)) AS BIGINT) AS chars FROM ({ALL_TILES}) GROUP BY scale",
    "tile_parent_link": f"WITH c AS ({_T512}), p AS ({tile_sql('context_2048')}) SELECT c.doc_id, c.tile_index, min(p.tile_index) AS parent_index FROM c LEFT JOIN p ON p.doc_id = c.doc_id AND (c.start_char + c.end_char) // 2 >= p.start_char AND (c.start_char + c.end_char) // 2 < p.end_char GROUP BY 1, 2",
    "tile_rebuild": "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL",
    "tile_stats": f"SELECT lang, count(*) AS n_tiles, CAST(sum(token_count) AS BIGINT) AS total_tokens, CAST(sum(token_count) // count(*) AS BIGINT) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens FROM ({_T512}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang",
    "canonical_object": f"SELECT content_hash, count(*) FILTER (scale = 'search_512') AS tile_count_512, count(*) FILTER (scale = 'context_2048') AS tile_count_2048, count(*) FILTER (scale = 'full_4096') AS tile_count_4096, CAST(sum(token_count) AS BIGINT) AS total_tokens, md5(min_by(content, sr * 1000000 + tile_index)) AS representative_md5 FROM (SELECT *, substring(sha256(text), 1, 16) AS content_hash, CASE scale WHEN 'full_4096' THEN 0 WHEN 'context_2048' THEN 1 ELSE 2 END AS sr FROM ({ALL_TILES})) GROUP BY content_hash",
    "bm25_topk": f"WITH firsts AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256({_CANON})), t AS (SELECT doc_id || ':' || tile_index AS tile_id, content FROM ({_T512}) WHERE doc_id IN (SELECT doc_id FROM firsts)), q AS (SELECT 'q' AS query_id, '{QUERY}' AS query), s AS ({bm25_sql('t', 'tile_id', 'content', 'q')}), b AS (SELECT CAST(split_part(tile_id, ':', 1) AS BIGINT) AS doc_id, round(max(score), 6) AS score FROM s GROUP BY 1) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 10",
    "bm25_fields": f"WITH s AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM (SELECT query_id, doc_id, score FROM ({bm25_sql('documents', 'doc_id', 'text', _BQ)}) UNION ALL SELECT query_id, doc_id, 2.0 * score FROM ({bm25_sql('documents', 'doc_id', 'source', _BQ)})) GROUP BY ALL) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3",
    "vector_topk": f"SELECT label AS query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM (SELECT a.label, vec_id, {COS_ANCHOR} AS s FROM embeddings, {ANCHORS} a) QUALIFY rank <= 8",
    "batch_vector_topk": f"SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS.format(a='e.embedding', b='CAST(q.embedding AS DOUBLE[])')} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) QUALIFY rank <= 3",
    "vector_certainty_floor": f"SELECT label AS query_id, count(*) AS n FROM (SELECT a.label, {COS_ANCHOR} AS s FROM embeddings, {ANCHORS} a) WHERE (1 + s) / 2 >= 0.7 GROUP BY label",
    "vector_norms": "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings",
    "hybrid_relative": f"WITH l AS ({LEX}), v AS ({VEC}), ls AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS l FROM l WINDOW w AS (PARTITION BY query_id)), vs AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS v FROM v WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, round(CAST(0.65 AS DOUBLE) * coalesce(v, 0) + CAST(0.35 AS DOUBLE) * coalesce(l, 0), 6) AS score FROM vs FULL JOIN ls USING (query_id, doc_id)",
    "rrf_equal": f"SELECT query_id, doc_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score, count(*) AS n_lists FROM (SELECT query_id, doc_id, rank FROM ({LEX}) UNION ALL SELECT query_id, doc_id, rank FROM ({VEC})) GROUP BY query_id, doc_id",
    "rrf_weighted": f"SELECT query_id, doc_id, round(sum(w / (59 + rank)), 9) AS score, min(rank) AS best_rank FROM (SELECT query_id, doc_id, rank, CAST(2 AS DOUBLE) AS w FROM ({LEX}) UNION ALL SELECT query_id, doc_id, rank, CAST(0.5 AS DOUBLE) FROM ({VEC})) GROUP BY query_id, doc_id",
    "pool_cap": f"WITH p AS (SELECT query_id, doc_id, 0 AS lane_order, rank, FALSE AS x FROM ({LEX}) UNION ALL SELECT query_id, doc_id, 1, rank, rank <= 10 FROM ({VEC})), k AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY query_id) > 25 THEN greatest(25 - sum(x::INT) OVER (PARTITION BY query_id), 10) ELSE 999999 END AS keep, sum((NOT x)::INT) OVER (PARTITION BY query_id ORDER BY lane_order, rank ROWS UNBOUNDED PRECEDING) AS base FROM p) SELECT query_id, doc_id, lane_order, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lane_order, rank) AS rn FROM k WHERE x OR base <= keep) WHERE rn <= 25",
    "keep_first_dedup": "SELECT doc_id, content_hash FROM (SELECT doc_id, n_chars, CASE WHEN length(text) > 20 THEN md5(text) ELSE '' END AS content_hash FROM documents) QUALIFY row_number() OVER (PARTITION BY CASE WHEN content_hash = '' THEN 'id:' || doc_id ELSE content_hash END ORDER BY n_chars DESC, doc_id) = 1",
    "where_filter": "SELECT doc_id, length(text) AS priority FROM documents WHERE lang = 'en' AND source = 'src0' AND length(text) >= 1000",
    "query_alpha": rf"SELECT item_id, round(CASE WHEN len(w) = 0 THEN 0.3 ELSE least(CAST(0.65 AS DOUBLE), 0.3 + 0.7 * CAST(len(list_filter(w, lambda x: x IN ({_STOP}))) AS DOUBLE) / len(w)) END, 6) AS alpha FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)",
}
