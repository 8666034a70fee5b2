"""Queries that rank: phrases of each language, documents for each benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramma.llm import lexical, phrases
from engramma.session import table


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT doc_id, lang, row_number() OVER () AS piece, x FROM (
    SELECT doc_id, coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
w AS (SELECT lang, piece, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS ph FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, ph, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, k, ph, f AS a FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT *, unnest(range(1, k)) AS cp FROM c),
scored AS (
  SELECT cut.lang, cut.k, cut.ph, a, cp, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.k = cp AND x.ph = list_slice(cut.ph, 1, cp)
           JOIN f y ON y.lang = cut.lang AND y.k = cut.k - cp AND y.ph = list_slice(cut.ph, cp + 1, cut.k)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, ph ORDER BY score, cp) = 1),
inside AS (
  SELECT lang, m AS k, list_slice(ph, i, i + m - 1) AS ph, max(a) AS over FROM (
    SELECT lang, ph, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside i ON i.lang = best.lang AND i.k = best.k AND i.ph = best.ph WHERE over IS NULL OR 100 * over < 80 * a),
ranked AS (SELECT *, array_to_string(ph, ' ') AS phrase FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) JOIN total USING (lang) WHERE rank <= 2000
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, rid, w, len(w) AS n FROM (
    SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents) WHERE len(w) > 0),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
m AS (SELECT rid, doc_id, 100 - 90 + ((90 * n * nd) // nt) AS m FROM d, total),
s AS (
  SELECT item_id, rid, any_value(doc_id) AS doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY item_id, rid)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

QUERIES = {"op11_lexical_search": op11_lexical_search, "op12_collocations": op12_collocations}
SQL = {"op11_lexical_search": OP11_SQL, "op12_collocations": OP12_SQL}
