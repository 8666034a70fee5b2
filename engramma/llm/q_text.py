"""Queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from engramma.llm import decontaminate, mixing, near_dup, quality, simhash, tokens, toxicity
from engramma.session import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0))),
dw AS (
  SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selected(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _share_sql(nodes: str, parent: str, name: str, budget: str, keep: str) -> str:
    """Water-filling as in ``mixing``, for a node relation with w and cap."""
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
  SELECT {keep}, least(cap, CASE WHEN lev IS NULL OR isfull THEN cap ELSE CAST(floor(lev.l * w / lev.w) AS BIGINT) END) AS got FROM (
    SELECT *, min(CASE WHEN NOT isfull THEN {{'r': cap / w, 'k': {name}, 'l': lft, 'w': wr}} END) OVER ({part}) AS lev FROM (
      SELECT *, cap * wr <= lft * w AS isfull FROM (
        SELECT *, greatest(0, {budget} - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft,
               (sum(w) OVER ({part} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS wr FROM {nodes})))"""


OP2_SQL = rf"""
WITH slim AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, 'd' || (coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '(\d+)$', 1), '') AS INTEGER), 0) % 4) AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * 2)::BIGINT AS cap, 1::BIGINT AS w FROM slim GROUP BY ALL HAVING sum(tokens) > 0),
total AS (SELECT CAST(floor(coalesce(sum(tokens), 0) * 600 / 1000) AS BIGINT) AS want FROM leaf),
dom AS (SELECT domain, sum(cap)::BIGINT AS cap, CAST(CASE domain WHEN 'd0' THEN 40 WHEN 'd1' THEN 30 WHEN 'd2' THEN 20 WHEN 'd3' THEN 10 ELSE 10 END AS BIGINT) AS w, any_value(want) AS want FROM leaf, total GROUP BY domain),
dshare AS ({_share_sql("dom", "", "domain", "want", "domain")}),
lng AS (SELECT leaf.domain, lang, sum(cap)::BIGINT AS cap, CAST(CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 20 WHEN 'de' THEN 20 WHEN 'es' THEN 10 ELSE 10 END AS BIGINT) AS w, any_value(got) AS b1 FROM leaf JOIN dshare USING (domain) GROUP BY leaf.domain, lang),
lshare AS ({_share_sql("lng", "domain", "lang", "b1", "domain, lang")}),
lf AS (SELECT leaf.*, got AS b2 FROM leaf JOIN lshare USING (domain, lang)),
budget AS ({_share_sql("lf", "domain, lang", "source", "b2", "domain, lang, source, tokens")}),
plan AS (SELECT domain, lang, source, got // tokens AS nfull, got - (got // tokens) * tokens AS part FROM budget),
ranked AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM (
    SELECT slim.*, nfull, part, md5('17:' || nfull || ':' || key) AS k FROM slim JOIN plan USING (domain, lang, source))),
last AS (SELECT domain, lang, source, min(k) AS k FROM ranked WHERE upto >= part AND part > 0 GROUP BY ALL)
SELECT * FROM (
  SELECT doc_id, domain, lang, source, tokens, CAST(nfull + CASE WHEN part > 0 AND r.k <= last.k THEN 1 ELSE 0 END AS INTEGER) AS copies
  FROM ranked r LEFT JOIN last USING (domain, lang, source)) WHERE copies > 0
"""

def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_digests(spark, tokens.write_store(table(spark, sf_dir, "documents"), tokenizer_path()))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM reach GROUP BY v) r ON r.v = d.doc_id
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op13_simhash": op13_simhash, "op10_ngram_jaccard": op10_ngram_jaccard, "op5_quality": op5_quality, "op6_toxicity": op6_toxicity, "op8_token_store": op8_token_store, "op1_decontaminate": op1_decontaminate, "op2_mixing": op2_mixing}
SQL = {"op10_ngram_jaccard": OP10_SQL, "op1_decontaminate": OP1_SQL, "op2_mixing": OP2_SQL}
