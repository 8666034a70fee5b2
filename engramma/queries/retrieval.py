"""Late interaction through the token index; the standard dictionary found in texts that hold its phrases; chunks and packages."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from engramma.operators import chunking as ck
from engramma.operators import dictionary as dc
from engramma.operators import maxsim
from engramma.operators import motifs as mo
from engramma.session import table

#: Vectors in a document, queries, and what each is given.
TOKENS, EVERY, BEST = 5, 20, 5


def _late(spark, d, exact):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / TOKENS).alias("doc"), F.col("embedding").alias("vector"))
    asked = e.where(F.col("doc") % EVERY == 0).withColumnRenamed("doc", "query_id")
    return maxsim.search(maxsim.build(e), asked, BEST, exact=exact)


def late_interaction(spark, d):
    """All vectors, five to a document; documents whose number is divisible by 20 as queries, exactly."""
    return _late(spark, d, True).select("query_id", "rank", "doc", F.round("score", 6).alias("score"))


def late_interaction_probed(spark, d):
    """The same with the first probes only, and how many documents were met and scored."""
    return _late(spark, d, False)


_EXAMPLES = [e for m in dc.STANDARD for e in m.examples]
_AGAINST = [a for m in dc.STANDARD for a in m.anti_examples]


def motif_dictionary(spark, d):
    """The standard dictionary over all documents, each with a phrase of it put at its end, every other with an anti-example too."""
    pick = lambda phrases: F.get(F.array(*map(F.lit, phrases)), (F.col("doc_id") % len(phrases)).cast("int"))
    against = F.when(F.col("doc_id") % 2 == 0, pick(_AGAINST)).otherwise("")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat("text", F.lit(". "), pick(_EXAMPLES), F.lit(". "), against).alias("text"))
    return mo.assign(docs, dc.standard_dictionary(), "doc_id")


#: Tokens in a chunk and carried over, characters of paragraphs, a package's budget.
CHUNK, OVERLAP, CHARS, BUDGET = 2000, 400, 400, 20_000


def budget_chunks(spark, d):
    """All documents of a source in order, packed into chunks."""
    c = ck.budget_chunks(table(spark, d, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text", CHUNK, OVERLAP)
    return c.select("source", "chunk_index", "first", "last", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def paragraph_chunks(spark, d):
    """The lines of every document as its paragraphs."""
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return ck.paragraph_chunks(docs, "doc_id", chunk_chars=CHARS).select("doc_id", "chunk_index", "content_hash")


def budget_packing(spark, d):
    return ck.packed(table(spark, d, "documents").where("text is not null"), "source", "doc_id", "n_chars", BUDGET)


QUERIES = {f.__name__: f for f in (late_interaction, late_interaction_probed, motif_dictionary, budget_chunks, paragraph_chunks, budget_packing)}
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_listed = lambda xs: "[" + ", ".join(map(_quoted, xs)) + "]"
_OUTSIDE = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]"
_PATTERNS = ", ".join(f"({_quoted(m.motif_id)}, '{m.band}', {_quoted(e.split()[0])}, {_quoted(r'\s+'.join(re.escape(w) for w in e.split()))})" for m in dc.STANDARD for e in m.examples)
_ANTI = ", ".join(f"({_quoted(m.motif_id)}, {_listed(m.anti_examples)})" for m in dc.STANDARD)
_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
SQL = {
    "late_interaction": f"""SELECT query_id, rank, doc, round(s, 6) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc) AS INTEGER) AS rank FROM (
    SELECT query_id, doc, sum(m) AS s FROM (
      SELECT q.vec_id // {TOKENS} AS query_id, q.vec_id AS token, e.vec_id // {TOKENS} AS doc, max({_DOT}) AS m
      FROM embeddings q, embeddings e WHERE (q.vec_id // {TOKENS}) % {EVERY} = 0 GROUP BY ALL) GROUP BY ALL)) WHERE rank <= {BEST}""",
    "motif_dictionary": f"""
WITH t AS (SELECT doc_id, text || '. ' || {_listed(_EXAMPLES)}[doc_id % {len(_EXAMPLES)} + 1] || '. ' || CASE WHEN doc_id % 2 = 0 THEN {_listed(_AGAINST)}[doc_id % {len(_AGAINST)} + 1] ELSE '' END AS text FROM documents WHERE text IS NOT NULL),
low AS (SELECT doc_id, length(text) AS n, lower(text) AS low FROM t),
pat AS (SELECT * FROM (VALUES {_PATTERNS}) v(motif_id, band, first, pattern)),
hit AS (
  SELECT doc_id, n, low, motif_id, band, CAST(sum(len(regexp_extract_all(low, '(?:^|{_OUTSIDE})' || pattern || '(?:$|{_OUTSIDE})'))) AS INTEGER) AS hits
  FROM low JOIN pat ON contains(low, first) GROUP BY ALL),
speak AS (SELECT * FROM (VALUES {_ANTI}) v(motif_id, against))
SELECT doc_id, motif_id, band, hits, round(least(CAST(1 AS DOUBLE), CAST(0.15 AS DOUBLE) * hits / (CAST(n AS DOUBLE) / 1000)), 4) AS amp,
       greatest(CAST(0.1 AS DOUBLE), 1 - CAST(0.3 AS DOUBLE) * len(list_filter(against, lambda a: contains(low, a)))) AS confidence
FROM hit JOIN speak USING (motif_id) WHERE hits > 0""",
    "budget_chunks": f"""
WITH RECURSIVE r AS (
  SELECT source, text, length(text) // 4 AS tok, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, (length(text) // 4 > {CHUNK})::INT AS giant
  FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
s AS (SELECT *, sum(giant) OVER (PARTITION BY source ORDER BY place) AS seg FROM r),
small AS (SELECT *, sum(tok) OVER w AS upto, sum(tok) OVER w - tok AS before, row_number() OVER w - 1 AS pos FROM s WHERE giant = 0 WINDOW w AS (PARTITION BY source, seg ORDER BY place)),
stop AS (SELECT a.source, a.seg, a.pos, min(e.pos) FILTER (e.upto - a.before >= {CHUNK}) AS stop, max(e.pos) AS tail FROM small a JOIN small e ON e.source = a.source AND e.seg = a.seg AND e.pos >= a.pos GROUP BY ALL),
nxt AS (SELECT t.source, t.seg, t.pos, min(k.pos) AS nxt FROM stop t JOIN small e ON e.source = t.source AND e.seg = t.seg AND e.pos = t.stop JOIN small k ON k.source = t.source AND k.seg = t.seg AND k.before >= e.upto - {OVERLAP} GROUP BY ALL),
c AS (SELECT source, seg, pos FROM small WHERE pos = 0 UNION SELECT c.source, c.seg, n.nxt FROM c JOIN nxt n ON n.source = c.source AND n.seg = c.seg AND n.pos = c.pos),
b AS (SELECT c.source, c.seg, c.pos, coalesce(stop, tail) AS stop FROM c JOIN stop t ON t.source = c.source AND t.seg = c.seg AND t.pos = c.pos),
chunk AS (
  SELECT b.source, min(x.place) AS first, max(x.place) AS last, string_agg(x.text, chr(10) || chr(10) ORDER BY x.pos) AS text FROM b JOIN small x ON x.source = b.source AND x.seg = b.seg AND x.pos BETWEEN b.pos AND b.stop GROUP BY b.source, b.seg, b.pos
  UNION ALL SELECT source, place, place, text FROM s WHERE giant = 1)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY first) - 1 AS INTEGER) AS chunk_index, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, md5(text) AS text_md5 FROM chunk""",
    "paragraph_chunks": f"""
WITH RECURSIVE p AS (SELECT doc_id, trim(x, E' \\t\\n\\r\\x0b\\x0c') AS x, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
q AS (SELECT doc_id, x, length(x) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM p WHERE x <> ''),
c AS (
  SELECT doc_id, k, 0 AS chunk, n AS held, x AS text, n AS tail_n, x AS tail, false AS done FROM q WHERE k = 1
  UNION ALL
  SELECT c.doc_id, q.k, c.chunk + (c.held + q.n > {CHARS})::INT, CASE WHEN c.held + q.n > {CHARS} THEN c.tail_n + q.n ELSE c.held + q.n END,
         CASE WHEN c.held + q.n > {CHARS} THEN c.tail ELSE c.text END || chr(10) || chr(10) || q.x, q.n, q.x, false
  FROM c JOIN q ON q.doc_id = c.doc_id AND q.k = c.k + 1)
SELECT doc_id, chunk AS chunk_index, substring(sha256(arg_max(text, k)), 1, 16) AS content_hash FROM c GROUP BY doc_id, chunk""",
    "budget_packing": f"""
WITH RECURSIVE r AS (SELECT source, doc_id, CAST(n_chars AS BIGINT) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT source, 0::BIGINT AS k, 0::BIGINT AS used, 0 AS missed, 0 AS taken, false AS took FROM r WHERE k = 1
  UNION ALL
  SELECT r.source, r.k, CASE WHEN ok THEN used + x.n ELSE used END, CASE WHEN ok THEN missed ELSE missed + 1 END, CASE WHEN ok THEN taken + 1 ELSE taken END, ok
  FROM (SELECT w.source, w.k, w.used, w.missed, w.taken, r.n, r.k AS rk, w.missed <= 20 AND w.used + r.n <= {BUDGET} AS ok FROM w JOIN r ON r.source = w.source AND r.k = w.k + 1) x JOIN r ON r.source = x.source AND r.k = x.rk)
SELECT w.source, taken - 1 AS place, r.doc_id, r.n AS n_chars FROM w JOIN r ON r.source = w.source AND r.k = w.k WHERE took""",
}
