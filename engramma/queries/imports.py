"""Conversations written out as every export format and read again; documents as files of a corpus; small text and time rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramma.functions import text as tx
from engramma.functions import timefn
from engramma.operators import events as el
from engramma.operators import exchanges as ex
from engramma.operators import graph as gr
from engramma.operators import tiling as ti
from engramma.queries.memory import EDGES, _edges
from engramma.queries.memory import SQL as _MEMORY_SQL
from engramma.queries.passages import tile_sql
from engramma.session import table
from engramma.sources import exports, files


def _turns(spark, d):
    """(conv_id, turn, role, t): messages on one line each, as formats that cut at lines need them."""
    c = table(spark, d, "conversations").where("role in ('user', 'assistant') and text is not null")
    return c.select("conv_id", "turn", "role", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t")).where("t <> ''")


_TURNS = r"SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role IN ('user', 'assistant') AND trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> ''"
_SAID = f"SELECT 'c' || conv_id AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role, md5(t) AS text_md5 FROM ({_TURNS})"


def _grouped(spark, d, one):
    """A row a conversation with its messages, made by ``one`` from turn, role and text, in order."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "t")))
    return _turns(spark, d).groupBy("conv_id").agg(rows.alias("m")).select("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.concat(F.lit("/x/claude/"), F.col("conv_id").cast("string"), F.lit(".json")).alias("path"), "m", F.transform("m", one).alias("r"))


def _read(df):
    return df.select("conversation_id", "position", "role", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def _date(seconds):
    return F.struct(F.struct(((seconds + 1_700_000_000) * 1000).cast("long").cast("string").alias("$numberLong")).alias("$date"))


def _tree(spark, d):
    name = lambda i: F.concat(F.lit("n"), F.lpad(i.cast("string"), 5, "0"))
    g = _grouped(spark, d, lambda x, i: F.struct(name(i + 1), F.struct(name(i + 1).alias("id"), name(i).alias("parent"), F.when(i + 1 < F.size("m"), F.array(name(i + 2))).otherwise(F.array().cast("array<string>")).alias("children"), F.struct(F.struct(x["role"].alias("role")).alias("author"), F.struct(F.array(x["t"]).alias("parts")).alias("content"), x["turn"].cast("double").alias("create_time")).alias("message"))))
    root = F.struct(F.lit("n00000"), F.struct(F.lit("n00000").alias("id"), F.lit(None).cast("string").alias("parent"), F.array(F.lit("n00001")).alias("children"), F.lit(None).cast("struct<author: struct<role: string>, content: struct<parts: array<string>>, create_time: double>").alias("message")))
    return g.select("path", F.to_json(F.array(F.struct(F.lit("t").alias("title"), F.col("id").alias("conversation_id"), F.map_from_entries(F.concat(F.array(root), "r")).alias("mapping")))).alias("text"))


def _blocks(spark, d):
    g = _grouped(spark, d, lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("assistant").alias("sender"), F.array(F.struct(F.lit("text").alias("type"), x["t"].alias("text"))).alias("content")))
    return g.select("path", F.to_json(F.array(F.struct(F.col("id").alias("uuid"), F.col("r").alias("chat_messages")))).alias("text"))


def _responses(spark, d):
    g = _grouped(spark, d, lambda x: F.struct(x["t"].alias("message"), F.when(x["role"] == "user", "human").otherwise("ASSISTANT").alias("sender"), _date(x["turn"]).alias("create_time")))
    return g.select("path", F.to_json(F.struct(F.struct(F.col("id").alias("id")).alias("conversation"), F.col("r").alias("responses"))).alias("text"))


def _bulk(spark, d):
    name = lambda i: F.concat(F.lit("r"), i.cast("string"))
    g = _grouped(spark, d, lambda x, i: F.struct(F.struct(name(i).alias("_id"), F.when(i > 0, name(i - 1)).alias("parent_response_id"), x["t"].alias("message"), F.when(x["role"] == "user", "human").otherwise("ASSISTANT").alias("sender"), _date(x["turn"]).alias("create_time")).alias("response")))
    return g.select("path", F.to_json(F.struct(F.array(F.struct(F.struct(F.col("id").alias("id")).alias("conversation"), F.reverse("r").alias("responses"))).alias("conversations"))).alias("text"))


def _single(spark, d):
    g = _grouped(spark, d, lambda x: F.struct(x["role"].alias("role"), x["t"].alias("content")))
    return g.select(F.concat(F.lit("/x/claude_"), F.col("conv_id").cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct(F.lit("t").alias("title"), F.col("id").alias("url"), F.col("r").alias("messages"))).alias("text"))


def _lines(spark, d):
    said = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("t").alias("content")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("t").alias("text"))).alias("content"))))
    return _turns(spark, d).select(F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("sessionId"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("timestamp"), F.try_parse_json(said).alias("message"))).alias("value"))


def _labelled(spark, d):
    g = _grouped(spark, d, lambda x: F.concat(F.when(x["role"] == "user", "You\n").otherwise("Claude:\n"), x["t"]))
    return g.select(F.col("id").alias("path"), F.array_join("r", "\n").alias("text"))


def export_tree(spark, d):
    return _read(exports.tree_messages(_tree(spark, d)))


def export_blocks(spark, d):
    return _read(exports.block_messages(_blocks(spark, d)))


def export_responses(spark, d):
    return _read(exports.response_messages(_responses(spark, d)))


def export_bulk(spark, d):
    return _read(exports.conversation_tree_messages(_bulk(spark, d)))


def export_single(spark, d):
    m = exports.individual_messages(_single(spark, d))
    return m.select("conversation_id", "platform", "position", "role", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def export_lines(spark, d):
    return _read(exports.agent_lines(_lines(spark, d)))


def export_labelled(spark, d):
    return _read(exports.labelled_text(_labelled(spark, d)))


def export_formats(spark, d):
    """How many of the files above are told to be of each format, with the platform of their folder."""
    every = None
    for f in (_tree, _blocks, _responses, _bulk, _single, _labelled):
        every = f(spark, d) if every is None else every.unionByName(f(spark, d))
    return every.groupBy(exports.detect_format(F.col("text")).alias("format"), exports.platform_of(F.col("path")).alias("platform")).agg(F.count("*").alias("n"))


def _pairs(spark, d):
    """Answered exchanges on one line a side."""
    return ex.exchanges(_turns(spark, d), "conv_id", "turn", text="t", keep_orphans=False).select("conv_id", "exchange_index", F.regexp_replace("prompt", r"\s+", " ").alias("p"), F.regexp_replace("response", r"\s+", " ").alias("r")).where("p <> ''")


def _pages(spark, d, entry, between):
    rows = F.array_sort(F.collect_list(F.struct("exchange_index", entry.alias("e"))))
    return _pairs(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["e"]), between).alias("text"))


def export_markdown(spark, d):
    f = _pages(spark, d, F.concat(F.lit("# "), "p", F.lit("\n"), "r"), "\n---\n")
    return _read(exports.divider_markdown(f.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), "text")))


def export_activity(spark, d):
    entry = F.concat(F.lit("Logo for Gemini Apps\nGemini Apps\nPrompted "), "p", F.lit("\nDetails\nevent\nMarch "), (F.col("exchange_index") + 1).cast("string"), F.lit(" at 1:05 PM\napps\nGemini Apps\nchat\n\n"), "r", F.lit("\n"))
    f = _pages(spark, d, entry, "").select(F.concat(F.lit("/x/c"), F.col("conv_id").cast("string"), F.lit("_2024_02_10.md")).alias("path"), "text")
    return exports.activity_log(f).select("path", "exchange_index", F.md5(F.encode("user_text", "utf-8")).alias("user_md5"), F.md5(F.encode("response_text", "utf-8")).alias("response_md5"), "created_at")


_PAIRS = rf"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY x) - 1 AS i, p, regexp_replace(r, '\s+', ' ', 'g') AS r FROM (SELECT conv_id, x, max(t) FILTER (role = 'user') AS p, string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant') AS r FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM ({_TURNS})) GROUP BY conv_id, x) WHERE p IS NOT NULL AND r IS NOT NULL"


def sharegpt_lines(spark, d):
    t = ex.sharegpt_json(ex.training_set(table(spark, d, "conversations"), "conv_id", "turn"), "s")
    j = F.from_json("value", "struct<source: string, conversations: array<struct<from: string, value: string>>>")
    return t.select(j.alias("j")).groupBy("j.source", F.get("j.conversations", F.lit(0))["from"].alias("first"), F.element_at("j.conversations", -1)["from"].alias("last")).agg(F.count("*").alias("n"), F.sum(F.size("j.conversations")).cast("long").alias("turns"))


#: Files of documents: a stage's folder, a day's folder, a name, a suffix.
_PATH = "concat('/c', element_at(array('/kernel', '/layer_0', '/chewy', '/expansion_md', '/layer_2/venv'), cast(doc_id % 5 + 1 as int)), '/202401', lpad(cast(doc_id % 28 + 1 as string), 2, '0'), '/', if(doc_id % 3 = 0, 'v0', 'd'), cast(doc_id as string), element_at(array('.md', '.txt', '.png', '', '.json'), cast(doc_id % 7 % 5 + 1 as int)))"
_PATH_SQL = "'/c' || ['/kernel', '/layer_0', '/chewy', '/expansion_md', '/layer_2/venv'][doc_id % 5 + 1] || '/202401' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '/' || CASE WHEN doc_id % 3 = 0 THEN 'v0' ELSE 'd' END || doc_id || ['.md', '.txt', '.png', '', '.json'][doc_id % 7 % 5 + 1]"


def _files(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_PATH).alias("path"), (F.col("n_chars") * 40).alias("length"), F.md5(F.encode("text", "utf-8")).alias("content_hash"))


def corpus_files(spark, d):
    """Files that a corpus takes, with their stage."""
    s = files.staged(_files(spark, d), files.stage_table(spark))
    return s.where(files.wanted(F.col("path"), F.col("length"), F.col("any_suffix"))).select("doc_id", "stage", "priority")


_STAGED = f"SELECT *, CASE doc_id % 5 WHEN 0 THEN 'kernel' WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'v0' ELSE 'layer_0' END WHEN 2 THEN 'chewy' WHEN 3 THEN 'expansion_md' ELSE 'layer_2' END AS stage FROM (SELECT doc_id, {_PATH_SQL} AS path, n_chars * 40 AS length, md5(text) AS content_hash FROM documents)"


def corpus_manifest(spark, d):
    """Each content's owner among the staged files, and how many files have it."""
    m = files.manifest(files.staged(_files(spark, d), files.stage_table(spark)))
    return m.select("content_hash", "owner", "n_files", F.md5(F.array_join("all_paths", ",")).alias("paths_md5"))


def corpus_owned(spark, d):
    s = files.staged(_files(spark, d), files.stage_table(spark))
    return files.owned(s, files.manifest(s)).select("doc_id")


def corpus_newest(spark, d):
    return files.newest_dated_folder(_files(spark, d)).select("doc_id")


def corpus_unseen(spark, d):
    f = _files(spark, d)
    return files.unseen(f, f.where("doc_id % 2 = 0")).select("doc_id")


def corpus_changed(spark, d):
    f = _files(spark, d).select("doc_id", "path", F.col("length").alias("modified"))
    return files.modified_since(f, f.where("doc_id % 3 <> 0").select("path", (F.col("modified") + F.col("doc_id") % 4 - 2).alias("modified"))).select("doc_id")


def path_dates(spark, d):
    return _files(spark, d).select("doc_id", timefn.path_date(F.col("path")).alias("day"))


def iso_times(spark, d):
    """Event times as seconds, as extended JSON and as text in four forms, read back."""
    e = table(spark, d, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))
    s = F.unix_seconds("at")
    text = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")
    form = F.col("event_id") % 4
    shown = F.when(form == 0, F.concat(text, F.lit("Z"))).when(form == 1, text).when(form == 2, F.date_format("at", "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(text, F.lit(".250")))
    ext = F.to_json(F.struct(F.struct((s * 1000).cast("string").alias("$numberLong")).alias("$date")))
    return e.select("event_id", timefn.unix_iso(s).alias("iso"), timefn.store_date_iso(ext).alias("stored"), F.unix_seconds(timefn.parse_time(shown)).alias("seconds"), timefn.parse_time(shown, strict=True).isNull().alias("unread"))


def cycle_window(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return e.where(timefn.in_cycle_window(F.col("at"))).select("event_id")


def event_layers(spark, d):
    return table(spark, d, "events").groupBy(el.event_layer(F.col("event_type"), ["purchase"], ["click", "view"]).alias("layer")).agg(F.count("*").alias("n"))


def symmetric_edges(spark, d):
    """Every part's edges in either direction, counted."""
    e = _edges(spark, d).withColumnRenamed("src", "a").withColumnRenamed("dst", "b")
    return gr.both_ways(e).groupBy("node", "direction").agg(F.count("*").alias("n"), F.max("other").alias("last"))


def pair_edges(spark, d):
    e = _edges(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"), ((F.col("src") * 7 + F.col("dst")) % 10 / 10).alias("jaccard"))
    return gr.merge_edges(e)


def markdown_context(spark, d):
    """Documents with headers put between their halves: tiles after a header begin with it as context."""
    plain = table(spark, d, "documents").withColumn("text", F.translate("text", "#", "+"))  # no headers of its own
    doc = plain.select("doc_id", F.concat(F.lit("# Top "), F.col("doc_id").cast("string"), F.lit("\n"), F.substring("text", 1, 1000), F.lit("\n## Second\n"), F.expr("substring(text, 1001)")).alias("text"))
    t = ti.with_context(ti.tiles(doc, "search_512"))
    return t.select("doc_id", "tile_index", F.when(F.col("content").startswith("[Context: "), F.regexp_extract("content", r"^\[Context: ([^\]]*)\]", 1)).alias("context"))


def footnotes(spark, d):
    b = table(spark, d, "benchmark")
    text = F.concat(F.lit("a [1] "), "text", F.lit(" [^2]\n\n\n\n[^1]: note\n[2]: other\nend[3_4]"))
    return b.select("item_id", F.md5(F.encode(tx.without_footnotes(text), "utf-8")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (export_tree, export_blocks, export_responses, export_bulk, export_single, export_lines, export_labelled, export_formats, export_markdown, export_activity, sharegpt_lines, corpus_files, corpus_manifest, corpus_owned, corpus_newest, corpus_unseen, corpus_changed, path_dates, iso_times, cycle_window, event_layers, symmetric_edges, pair_edges, markdown_context, footnotes)}

_ORDER = "CASE stage WHEN 'kernel' THEN 0 WHEN 'v0' THEN 1 WHEN 'layer_0' THEN 2 WHEN 'chewy' THEN 3 WHEN 'layer_2' THEN 6 ELSE 9 END"
_MAN = f"SELECT content_hash, min_by(path, {{'o': {_ORDER}, 'p': path}}) AS owner, count(*) AS n_files, md5(string_agg(path, ',' ORDER BY path)) AS paths_md5 FROM ({_STAGED}) GROUP BY content_hash"

_HEADED = "(SELECT doc_id, '# Top ' || doc_id || chr(10) || substring(text, 1, 1000) || chr(10) || '## Second' || chr(10) || substring(text, 1001) AS text FROM (SELECT doc_id, replace(text, '#', '+') AS text FROM documents WHERE text IS NOT NULL))"
SQL = {
    **dict.fromkeys(("export_tree", "export_blocks", "export_responses", "export_bulk", "export_lines", "export_labelled"), _SAID),
    "export_single": f"SELECT sha256(conversation_id) AS conversation_id, 'claude' AS platform, position, role, text_md5 FROM ({_SAID})",
    "export_formats": f"WITH n AS (SELECT count(DISTINCT conv_id) AS n FROM ({_TURNS})) SELECT f AS format, p AS platform, n FROM n, (VALUES ('tree', 'claude'), ('blocks', 'claude'), ('responses', 'claude'), ('conversations', 'claude'), ('individual', 'x'), ('text', 'unknown')) v(f, p)",
    "export_markdown": f"SELECT 'c' || conv_id AS conversation_id, i * 2 + k AS position, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END AS role, md5(CASE k WHEN 0 THEN p ELSE r END) AS text_md5 FROM ({_PAIRS}), (VALUES (0), (1)) v(k)",
    "export_activity": f"SELECT '/x/c' || conv_id || '_2024_02_10.md' AS path, i AS exchange_index, md5(p) AS user_md5, md5(r) AS response_md5, '2023-03-' || lpad(CAST(i + 1 AS VARCHAR), 2, '0') || 'T13:05:00Z' AS created_at FROM ({_PAIRS})",
    "sharegpt_lines": f"SELECT 's' AS source, 'human' AS first, 'gpt' AS last, count(*) AS n, CAST(sum(n_turns) AS BIGINT) AS turns FROM ({_MEMORY_SQL['training_export']})",
    "corpus_files": f"SELECT doc_id, stage, CAST(CASE stage WHEN 'kernel' THEN 1.0 WHEN 'v0' THEN 0.95 WHEN 'layer_0' THEN 0.9 WHEN 'chewy' THEN 0.85 ELSE 0.4 END AS DOUBLE) AS priority FROM ({_STAGED}) WHERE stage <> 'layer_2' AND length > 0 AND length <= 524288 AND (doc_id % 7 % 5 IN (0, 1, 4) OR (stage = 'chewy' AND doc_id % 7 % 5 = 3))",
    "corpus_manifest": _MAN,
    "corpus_owned": f"SELECT doc_id FROM ({_STAGED}) WHERE path IN (SELECT owner FROM ({_MAN}))",
    "corpus_newest": "SELECT doc_id FROM documents WHERE doc_id % 28 = (SELECT max(doc_id % 28) FROM documents)",
    "corpus_unseen": "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)",
    "corpus_changed": "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 - 2 < 0",
    "path_dates": "SELECT doc_id, make_date(2024, 1, CAST(doc_id % 28 + 1 AS INTEGER)) AS day FROM documents",
    "iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stored, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, event_id % 4 = 3 AS unread FROM events",
    "cycle_window": "SELECT event_id FROM (SELECT event_id, fmod(epoch_us(ts) / CAST(1000000 AS DOUBLE), CAST(3.236 AS DOUBLE)) / CAST(3.236 AS DOUBLE) AS p FROM events) WHERE p >= 0.236 AND p <= 0.618",
    "event_layers": "SELECT CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END AS layer, count(*) AS n FROM events GROUP BY 1",
    "symmetric_edges": f"SELECT node, direction, count(*) AS n, max(other) AS last FROM (SELECT src AS node, dst AS other, 'out' AS direction FROM ({EDGES}) UNION ALL SELECT dst, src, 'in' FROM ({EDGES})) GROUP BY 1, 2",
    "pair_edges": f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, max((src * 7 + dst) % 10 / CAST(10 AS DOUBLE)) AS jaccard FROM ({EDGES}) GROUP BY 1, 2",
    "markdown_context": f"SELECT doc_id, tile_index, CASE WHEN tile_index = 0 THEN NULL WHEN start_char >= 1000 + length('# Top ' || doc_id || '..## Second') THEN 'Second' ELSE 'Top ' || doc_id END AS context FROM ({tile_sql('search_512').replace('FROM documents WHERE text IS NOT NULL', 'FROM ' + _HEADED)})",
    "footnotes": r"SELECT item_id, md5('a  ' || text || ' ' || chr(10) || chr(10) || 'end') AS text_md5 FROM benchmark",
}
