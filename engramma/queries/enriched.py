"""Enrichment over the input tables: documents as contents, common words as motifs, labels as responders."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramma.operators import enrich as en
from engramma.operators import tiling as ti
from engramma.queries.memory import ASSIGNED, EDGES, WORDS, _assigned, _edges
from engramma.queries.passages import ALL_TILES, ANCHORS, COS_ANCHOR, _anchors
from engramma.session import table


def _contents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang", F.md5(F.encode("text", "utf-8")).alias("content_hash"))


def _answers(spark, d):
    """Motifs as two responders give them: amplitudes twice as high, some missing, some beyond 1, some of no dictionary."""
    a = _assigned(spark, d).join(_contents(spark, d).select("doc_id", "content_hash"), "doc_id")
    amp = F.when(F.col("hits") % 7 == 0, F.lit(None)).otherwise(F.col("amp") * 2 - 0.1)
    name = F.when(F.col("hits") % 11 == 0, F.concat("motif_id", F.lit("?"))).otherwise(F.col("motif_id"))
    return a.select("content_hash", name.alias("motif_id"), amp.alias("amp"), F.when(F.col("hits") % 5 != 0, F.col("confidence") - 0.8 * (F.col("hits") % 3 == 2).cast("double")).alias("confidence"))


def _bands(spark):
    return spark.createDataFrame([(k, band) for k, (_, band) in WORDS.items()], "motif_id string, band string")


def _valid(spark, d):
    return en.valid_assignments(_answers(spark, d), _bands(spark))


_A = f"SELECT content_hash, motif_id, band, hits, amp, confidence FROM ({ASSIGNED}) JOIN (SELECT doc_id, md5(text) AS content_hash FROM documents) USING (doc_id)"
_VALID = f"SELECT content_hash, motif_id, any_value(band) AS band, max(amp) AS amp, max_by(confidence, {{'a': amp, 'c': confidence}}) AS confidence FROM (SELECT content_hash, motif_id, band, round(least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CASE WHEN hits % 7 = 0 THEN 0.5 ELSE amp * 2 - 0.1 END)), 4) AS amp, round(least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CASE WHEN hits % 5 = 0 THEN 0.7 ELSE confidence - 0.8 * (hits % 3 = 2)::INT END)), 4) AS confidence FROM ({_A}) WHERE hits % 11 <> 0) WHERE amp >= 0.1 AND confidence >= 0.3 GROUP BY content_hash, motif_id"


def enrichment_valid(spark, d):
    return _valid(spark, d)


def _tables(spark, d):
    sources = _contents(spark, d).groupBy("content_hash").agg((F.count_distinct("source") - 1).alias("n_sources"))
    bad = _contents(spark, d).join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return en.enrichment(_valid(spark, d), sources, bad)


def enrichment_gates(spark, d):
    g = _tables(spark, d)["gates"]
    return g.select("content_hash", "phi", "trust", F.array_join("flags", ",").alias("flags"), "passes", "n_motifs")


def enrichment_fields(spark, d):
    return _tables(spark, d)["fields"]


def tier1_patch(spark, d):
    """Vectors as tiles, some of a later tier."""
    e = table(spark, d, "embeddings")
    t = e.select("vec_id", F.when(F.col("vec_id") % 3 == 0, "tier2_x").when(F.col("vec_id") % 3 == 1, "old").alias("hmm_version"), F.array(F.lit("was")).alias("dominant_motifs"))
    a = _anchors(spark, d).select(F.col("label").alias("anchor_id"), "av")
    return en.tier1(t, e, a, "vec_id").select("vec_id", "hmm_version", F.array_join("dominant_motifs", ",").alias("motifs"))


def batch_results(spark, d):
    """Results by the first 8 to 32 digits of a content's hash, or by more than the hash."""
    a = _assigned(spark, d).join(_contents(spark, d).select("doc_id", "content_hash"), "doc_id")
    name = F.when(F.col("doc_id") % 4 == 0, F.concat("content_hash", F.lit("ff"))).otherwise(F.substring("content_hash", F.lit(1), (7 + F.col("doc_id") % 26).cast("int")))
    r = a.select(name.alias("hash"), "motif_id", (F.col("amp") * 2).alias("amp"))
    return en.batch_store(r, _contents(spark, d).select("content_hash")).select("content_hash", F.array_join("dominant_motifs", ",").alias("motifs"))


def consensus_summary(spark, d):
    """Documents as responders about their language: summaries are their first words."""
    c = table(spark, d, "documents").where("doc_id % 3 <> 0")
    r = c.select(F.concat("lang", (F.col("doc_id") % 40).cast("string")).alias("content_hash"), F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("platform"), F.substring("text", F.lit(1), (F.col("doc_id") % 50).cast("int")).alias("summary"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("tone"), F.array("source", "lang").alias("suggestions"))
    return en.consensus_meta(r).select("content_hash", F.md5(F.encode("summary", "utf-8")).alias("summary_md5"), "tone", F.array_join("suggestions", ",").alias("suggestions"))


def bridge_columns(spark, d):
    c = _contents(spark, d)
    gates = c.where("doc_id % 2 = 0").groupBy("content_hash").agg((F.max("doc_id") / 100).alias("phi"), (F.min("doc_id") / 100).alias("trust"), F.lit(True).alias("consensus"))
    b = en.bridge(_valid(spark, d), c.select("content_hash", F.substring("text", 1, 40).alias("summary")), gates)
    return b.select("content_hash", F.array_join("dominant_motifs", ",").alias("motifs"), F.md5(F.encode("summary", "utf-8")).alias("summary_md5"), "phi", "trust", "consensus")


def graph_backfill(spark, d):
    a = _valid(spark, d).where("amp >= 0.3").groupBy("content_hash").agg(F.collect_set("motif_id").alias("dominant_motifs"))
    known = _contents(spark, d).where("doc_id % 3 = 0").select("content_hash")
    return en.graph_backfill(a, known)


def rosetta_tiles(spark, d):
    c = _contents(spark, d).select("content_hash", F.substring("text", F.lit(1), (F.col("doc_id") % 60).cast("int")).alias("summary"))
    return en.rosetta_tiles(c).select("content_hash", "scale", F.md5(F.encode("content", "utf-8")).alias("content_md5"), "token_count")


def cross_references(spark, d):
    """Each document refers to the one after it by the first twelve digits of their hashes."""
    c = _contents(spark, d).select("doc_id", "content_hash", F.substring("content_hash", 1, 12).alias("prefix"))
    r = c.select("doc_id", F.col("prefix").alias("src_prefix")).join(c.select((F.col("doc_id") - 1).alias("doc_id"), F.col("prefix").alias("dst_prefix")), "doc_id")
    r = r.withColumn("type", F.when(F.col("doc_id") % 4 == 0, "guesses").when(F.col("doc_id") % 4 == 1, "supports").otherwise("relates"))
    return en.cross_references(r, c.where("doc_id % 10 <> 7").select("prefix", "content_hash").distinct())


def document_objects(spark, d):
    t = ti.multi_scale(_contents(spark, d)).withColumn("tile_id", F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 9, "0"), "scale", F.lpad(F.col("tile_index").cast("string"), 5, "0")))
    t = t.withColumn("platform", F.when(F.col("tile_index") % 2 == 1, F.col("source")).otherwise("")).withColumn("source_file", F.col("lang")).withColumn("hmm_enriched", (F.col("doc_id") % 3 == 0) & (F.col("tile_index") == 1))
    ids = lambda n: F.md5(F.encode(F.array_join(f"tile_ids_{n}", ","), "utf-8")).alias(f"ids_{n}")
    return en.document_objects(t).select("content_hash", *(ids(n) for n in ("512", "2048", "4096")), "platform", "source_file", "hmm_enriched", "total_tokens")


def typed_neighbours(spark, d):
    """Parts as nodes: line items lead on by versions, contradictions or likeness, from every twentieth part."""
    e = _edges(spark, d)
    kind = (F.col("src") * 31 + F.col("dst")) % 5
    e = e.select("src", "dst", F.when(kind == 0, "SUPERSEDES").when(kind == 1, "CONTRADICTS").otherwise("RELATES_TO").alias("type"), ((F.col("src") + F.col("dst")) % 10 / 10).alias("jaccard"), (F.col("src") + F.col("dst") * 3).alias("at"))
    starts = e.select(F.col("src").alias("start")).where("start % 20 = 0").distinct()
    return en.typed_neighbours(e, starts, depth=1)


QUERIES = {f.__name__: f for f in (enrichment_valid, enrichment_gates, enrichment_fields, tier1_patch, batch_results, consensus_summary, bridge_columns, graph_backfill, rosetta_tiles, cross_references, document_objects, typed_neighbours)}


_ALL = f"SELECT *, md5(text) AS content_hash, lpad(CAST(doc_id AS VARCHAR), 9, '0') || ':' || scale || ':' || lpad(CAST(tile_index AS VARCHAR), 5, '0') AS tile_id FROM ({ALL_TILES}) JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id)"
_TYPED = f"SELECT src, dst, CASE (src * 31 + dst) % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'S' ELSE 'R' END AS type, (src + dst) % 10 AS j, src + dst * 3 AS at_ FROM ({EDGES})"
SQL = {
    "enrichment_valid": _VALID,
    "enrichment_gates": f"WITH g AS (SELECT content_hash, max(amp) AS co, avg(confidence) AS c, count(*) AS n FROM ({_VALID}) GROUP BY content_hash), s AS (SELECT md5(text) AS content_hash, count(DISTINCT source) - 1 AS k, bool_or(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS x FROM documents GROUP BY 1), t AS (SELECT *, c * CASE WHEN x THEN 0.5 ELSE 1.0 END * CASE WHEN k = 0 THEN 0.7 ELSE 1.0 END AS t FROM g JOIN s USING (content_hash)) SELECT content_hash, round(co, 6) AS phi, round(t, 6) AS trust, concat_ws(',', CASE WHEN k = 0 THEN 'no_provenance' END, CASE WHEN co < 0.809 THEN 'low_coherence' END, CASE WHEN x THEN 'contradiction' END, CASE WHEN t < 0.809 THEN 'low_trust' END) AS flags, co >= 0.809 AND t >= 0.809 AS passes, n AS n_motifs FROM t",
    "enrichment_fields": f"SELECT CASE band WHEN 'fast' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END AS k, motif_id, max(amp) AS amp FROM ({_VALID}) GROUP BY 1, 2",
    "tier1_patch": f"WITH f AS (SELECT vec_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS m FROM (SELECT vec_id, a.label, round({COS_ANCHOR}, 4) AS s FROM embeddings, {ANCHORS} a) WHERE s >= 0.6 GROUP BY vec_id) SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'tier2_x' WHEN m IS NOT NULL THEN 'tier1' WHEN vec_id % 3 = 1 THEN 'old' END AS hmm_version, CASE WHEN vec_id % 3 <> 0 AND m IS NOT NULL THEN m ELSE 'was' END AS motifs FROM embeddings LEFT JOIN f USING (vec_id)",
    "batch_results": f"""
WITH c AS (SELECT doc_id, md5(text) AS content_hash FROM documents),
r AS (SELECT CASE WHEN doc_id % 4 = 0 THEN content_hash || 'ff' ELSE left(content_hash, 7 + doc_id % 26) END AS hash, motif_id FROM ({ASSIGNED}) JOIN c USING (doc_id) WHERE amp * 2 >= 0.6),
m AS (SELECT hash, min(content_hash) AS content_hash FROM (SELECT DISTINCT hash FROM r WHERE length(hash) >= 8) n JOIN (SELECT DISTINCT content_hash FROM c) t ON left(hash, 8) = left(content_hash, 8) AND (starts_with(content_hash, hash) OR starts_with(hash, content_hash)) GROUP BY hash)
SELECT content_hash, string_agg(DISTINCT motif_id, ',' ORDER BY motif_id) AS motifs FROM r JOIN m USING (hash) GROUP BY content_hash""",
    "consensus_summary": "WITH r AS (SELECT lang || (doc_id % 40) AS content_hash, source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS platform, substring(text, 1, doc_id % 50) AS summary, CASE WHEN doc_id % 2 = 0 THEN source END AS tone, source, lang FROM documents WHERE doc_id % 3 <> 0), x AS (SELECT content_hash, string_agg(v, ',' ORDER BY v) AS s FROM (SELECT DISTINCT content_hash, v FROM (SELECT content_hash, source AS v FROM r UNION SELECT content_hash, lang FROM r) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY v) <= 5) GROUP BY content_hash) SELECT content_hash, md5(max_by(summary, {'l': length(summary), 's': encode(summary)})) AS summary_md5, min_by(tone, platform) FILTER (tone IS NOT NULL) AS tone, any_value(s) AS suggestions FROM r JOIN x USING (content_hash) GROUP BY content_hash",
    "bridge_columns": f"WITH m AS (SELECT content_hash, string_agg(motif_id, ',' ORDER BY motif_id) AS motifs FROM ({_VALID}) WHERE amp >= 0.7 GROUP BY content_hash), s AS (SELECT md5(text) AS content_hash, any_value(substring(text, 1, 40)) AS s, max(doc_id) FILTER (doc_id % 2 = 0) / CAST(100 AS DOUBLE) AS phi, min(doc_id) FILTER (doc_id % 2 = 0) / CAST(100 AS DOUBLE) AS trust FROM documents GROUP BY 1) SELECT content_hash, motifs, md5(s) AS summary_md5, phi, trust, phi IS NOT NULL AS consensus FROM m JOIN s USING (content_hash)",
    "graph_backfill": f"SELECT content_hash, motif_id, CAST(0.7 AS DOUBLE) AS amp, CAST(0.7 AS DOUBLE) AS confidence FROM ({_VALID}) WHERE amp >= 0.3 AND content_hash NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)",
    "rosetta_tiles": "SELECT content_hash, 'rosetta' AS scale, md5(s) AS content_md5, CAST(length(s) // 4 AS INTEGER) AS token_count FROM (SELECT md5(text) AS content_hash, max_by(substring(text, 1, doc_id % 60), doc_id % 60) AS s FROM documents WHERE length(substring(text, 1, doc_id % 60)) >= 10 GROUP BY 1)",
    "cross_references": "WITH c AS (SELECT doc_id, md5(text) AS h FROM documents), ok AS (SELECT DISTINCT h FROM c WHERE doc_id % 10 <> 7) SELECT DISTINCT a.h AS src, b.h AS dst, CASE a.doc_id % 4 WHEN 1 THEN 'supports' ELSE 'relates' END AS type FROM c a JOIN c b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 4 <> 0 AND a.h <> b.h AND a.h IN (SELECT h FROM ok) AND b.h IN (SELECT h FROM ok)",
    "document_objects": f"SELECT content_hash, " + ", ".join(f"md5(coalesce(string_agg(tile_id, ',' ORDER BY tile_index, tile_id) FILTER (scale = '{s}'), '')) AS ids_{s.rpartition('_')[2]}" for s in ("search_512", "context_2048", "full_4096")) + f", min_by(source, tile_id) FILTER (tile_index % 2 = 1) AS platform, min_by(lang, tile_id) AS source_file, bool_or(doc_id % 3 = 0 AND tile_index = 1) AS hmm_enriched, CAST(sum(token_count) AS BIGINT) AS total_tokens FROM ({_ALL}) GROUP BY content_hash",
    "typed_neighbours": f"WITH e AS ({_TYPED}), b AS (SELECT src, dst, type, j, at_ FROM e UNION ALL SELECT dst, src, type, j, at_ FROM e), t AS (SELECT dst AS node, max(at_) AS at_ FROM b WHERE type = 'S' GROUP BY dst), s AS (SELECT DISTINCT src AS start FROM e WHERE src % 20 = 0), v AS (SELECT start, node, row_number() OVER (PARTITION BY start ORDER BY at_ DESC, node) AS n FROM (SELECT DISTINCT start, dst AS node FROM s JOIN b ON b.src = start WHERE type = 'S' AND dst <> start) JOIN t USING (node) QUALIFY n <= 80), r AS (SELECT start, node, row_number() OVER (PARTITION BY start ORDER BY j DESC, node) AS n FROM (SELECT start, dst AS node, max(j) AS j FROM s JOIN b ON b.src = start WHERE type = 'R' AND j >= 6 AND dst <> start GROUP BY ALL) QUALIFY n <= 20), u AS (SELECT start, node, 0 AS l, n, 'versions' AS how FROM v UNION ALL SELECT start, node, 1, n, 'related' FROM r), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY l, n) = 1) SELECT start, node, how, 1 AS distance, row_number() OVER (PARTITION BY start ORDER BY l, n) AS place FROM f QUALIFY place <= 100",
}
