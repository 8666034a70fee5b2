"""Keyed tables over the input tables: upserts, patches, lookups, expansions, links, leases, caches, entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramma.functions import text as tx
from engramma.operators import events as el
from engramma.operators import tables as tb
from engramma.operators import tiling as ti
from engramma.queries.passages import tile_sql
from engramma.session import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


def tile_upsert(spark, d):
    """Documents of even number arrive again, longer by one, some of them twice, and new ones with them."""
    t = _docs(spark, d)
    again = t.where("doc_id % 2 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    twice = again.where("doc_id % 4 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    new = again.withColumn("doc_id", -F.col("doc_id") - 1)
    return tb.upsert(t, again.unionByName(twice).unionByName(new), ["doc_id"], "n_chars")


def document_patch(spark, d):
    """Labels set the columns of documents that have none; those of one source are not touched."""
    t = _docs(spark, d).withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(-1))
    y = table(spark, d, "labels").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"), F.min(F.col("toxic").cast("int")).alias("toxic"))
    return tb.patch(t, y, "doc_id", ["quality", "toxic"], unless=F.col("source") == "src1").select("doc_id", "quality", "toxic")


def property_clear(spark, d):
    return tb.cleared(_docs(spark, d), F.col("source").isin("src0", "src1"), ["lang", "n_chars"]).select("doc_id", "lang", "n_chars")


def document_overlay(spark, d):
    """A third of the documents have richer metadata, half of it empty."""
    over = _docs(spark, d).where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.upper("lang")).alias("lang"), F.when(F.col("doc_id") % 5 != 0, F.lit("overlaid")).alias("source"))
    return tb.overlay(_docs(spark, d), over, "doc_id", ["lang", "source"])


def content_backfill(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    hollow = t.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.lit(None)).otherwise(F.col("text")))
    return tb.fill_empty(hollow, t, "doc_id", "text").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def tiles_of_hash(spark, d):
    """The tiles, by content hash, of every document labelled toxic."""
    docs = table(spark, d, "documents").select("doc_id", "text", tx.sha16(F.col("text")).alias("content_hash"))
    keys = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")
    first = docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    t = ti.tiles(docs.join(first, ["doc_id", "content_hash"], "left_semi"), "search_512")
    return tb.lookup(t, keys, "content_hash", scale="search_512").select("content_hash", "tile_index", "start_char", "end_char")


def hash_prefix(spark, d):
    """Prefixes of 8 to 12 digits, one a document, and one for each that no hash begins with."""
    h = table(spark, d, "documents").select("doc_id", tx.sha16(F.col("text")).alias("content_hash"))
    asked = h.select(F.substring("content_hash", F.lit(1), (8 + F.col("doc_id") % 5).cast("int")).alias("prefix")).unionByName(h.select(F.concat(F.lit("x"), F.substring("content_hash", 1, 7)).alias("prefix")))
    return tb.resolve_prefixes(asked, h, "content_hash")


def path_contains(spark, d):
    return tb.path_contains(table(spark, d, "pages"), "url", "/DE/").select("page_id", "url")


def session_expand(spark, d):
    """All messages of the conversations in which a system message was found."""
    c = table(spark, d, "conversations")
    return tb.expand(c.where("role = 'system'"), c, "conv_id").select("conv_id", "turn", "role")


def _linked(spark, d):
    """Turns as exchanges and tiles: (tiles, exchanges, sessions, links), every third link being there."""
    c = table(spark, d, "conversations").select("conv_id", "turn", tx.sha16(F.coalesce("text", F.lit(""))).alias("content_hash"))
    tiles = c.select(F.col("content_hash").alias("tile_id"), "content_hash").distinct()
    exchanges = c.select("content_hash", F.col("conv_id").alias("session_id"), F.col("turn").alias("exchange_index"))
    links = exchanges.where("exchange_index % 3 = 0").select(F.col("content_hash").alias("tile_id"), "session_id")
    return tiles, exchanges, exchanges.select("session_id"), links


_LINKED = "SELECT DISTINCT substring(sha256(coalesce(text, '')), 1, 16) AS tile_id, conv_id AS session_id, turn FROM conversations"


def session_backfill(spark, d):
    return tb.missing_links(*_linked(spark, d))


def session_reconstruct(spark, d):
    """Each session's turns that are no system messages, and how many earlier turns say the same."""
    c = table(spark, d, "conversations").withColumn("tile_id", F.concat_ws(":", "conv_id", "turn"))
    w = Window.partitionBy("conv_id", "text").orderBy("turn")
    older = c.withColumn("older", F.lag("tile_id").over(w)).where("older is not null").select(F.col("tile_id").alias("newer"), "older")
    return tb.reconstruct_session(c.select("tile_id", (F.col("role") == "system").alias("is_snapshot")), c.select("tile_id", F.col("conv_id").alias("session_id"), F.col("turn").alias("exchange_index")), older)


def pending_skip(spark, d):
    """Documents that are not done; what is done is noted by number, some with a prefix."""
    todo = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item"))
    done = table(spark, d, "labels").select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("item"))
    return tb.pending(todo, done, "item", strip="doc:")


_NOW = "2024-01-31 12:00:00"


def _leases(spark, d):
    """Leases of users, from their last event."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("item")).agg(F.max("ts").alias("last"), F.max("event_id").alias("n"))
    return e.select("item", F.concat(F.lit("w"), (F.col("item") % 3).cast("string")).alias("owner"), (F.col("last").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("expires_at"), (F.col("n") % 5 == 0).alias("done"))


_LEASES = "SELECT user_id AS item, 'w' || (user_id % 3) AS owner, max(ts) + INTERVAL 12 HOUR AS expires_at, max(event_id) % 5 = 0 AS done FROM events GROUP BY user_id"


def lease_take(spark, d):
    """Customers without a living lease, and users whose lease has run out, go to one worker."""
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("item"))
    return tb.take_leases(items, _leases(spark, d), "item", "w9", F.lit(_NOW).cast("timestamp"), 7200).groupBy("owner", "done").agg(F.count("*").alias("n"), F.min("item").alias("first"), F.max("item").alias("last"))


def lease_complete(spark, d):
    """A worker reports all users; only its own and those whose lease has run out are done."""
    l = _leases(spark, d)
    return tb.complete_leases(l, l.select("item"), "item", "w1", F.lit(_NOW).cast("timestamp")).select("item", "owner", "done")


def cache_lookup(spark, d):
    """Vectors of every twentieth number ask a cache of the others, the label being the scope; entries live by their number."""
    e = table(spark, d, "embeddings")
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    cache = e.where("vec_id % 20 <> 0").select(F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("key"), F.col("label").cast("string").alias("scope"), F.col("embedding").alias("vector"), F.lit("2024-01-01").cast("timestamp").alias("stored_at"), (F.col("vec_id") % 7 * 900).alias("ttl"))
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("k"), (F.col("vec_id") + F.col("vec_id") % 40 / 20).cast("long").cast("string")).alias("key"), F.col("label").cast("string").alias("scope"), F.col("embedding").alias("qv"))
    return tb.cache_hits(asked, cache, now, 0.6)


_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_SIM = f"{_DOT.format(a='q.qv', b='c.v')} / (sqrt({_DOT.format(a='q.qv', b='q.qv')}) * sqrt({_DOT.format(a='c.v', b='c.v')}))"


def query_cache_key(spark, d):
    b = table(spark, d, "benchmark")
    filters = F.create_map(F.lit("platform"), F.concat(F.lit("p"), (F.col("item_id") % 3).cast("string")), F.lit("lang"), F.lit("en"))
    return b.select("item_id", tb.query_key(F.col("text"), F.lit("exact"), filters).alias("key"))


def priority_dedup(spark, d):
    """Texts from three lists of falling urgency: labelled toxic, labelled, all; each once, from its most urgent list."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("content_hash"))
    y = table(spark, d, "labels")
    lists = docs.join(y.where("toxic = 1"), "doc_id", "left_semi").withColumn("priority", F.lit(1)).unionByName(docs.join(y, "doc_id", "left_semi").withColumn("priority", F.lit(2))).unionByName(docs.withColumn("priority", F.lit(3)))
    return tb.priority_first(lists, "content_hash", "priority", "doc_id")


def status_histogram(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return tb.status_counts(j, "quality")


def label_counts(spark, d):
    return tb.label_counts(**{n: table(spark, d, n) for n in ("documents", "conversations", "events", "pages", "labels")})


def _workspaces(spark, d):
    """Each user's events as a log: purchases set goals, clicks report steps, views come and go, some wipe all."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 37 == 0, "clear").when(F.col("event_type") == "purchase", "goal").when(F.col("event_type") == "click", "step").otherwise("agent")
    name = F.when(kind == "step", F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string"))).when(kind == "agent", F.concat(F.lit("a"), (F.col("event_id") % 5).cast("string")))
    value = F.when(kind == "goal", F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string"))).when(kind == "step", F.element_at(F.array(F.lit("open"), F.lit("done")), (F.col("event_id") % 2 + 1).cast("int"))).otherwise(F.element_at(F.array(F.lit("here"), F.lit("gone")), (F.col("event_id") % 11 % 2 + 1).cast("int")))
    return tb.workspace(e.select(F.col("user_id").alias("workspace_id"), F.col("event_id").alias("seq"), kind.alias("kind"), name.alias("name"), value.alias("value")))


_WORKSPACES = """
  SELECT workspace_id, max(value) FILTER (kind = 'goal') AS goal, coalesce(string_agg(name || '=' || value, ',' ORDER BY name) FILTER (kind = 'step'), '') AS steps, coalesce(string_agg(name, ',' ORDER BY name) FILTER (kind = 'agent' AND value <> 'gone'), '') AS agents FROM (
    SELECT * FROM (SELECT *, max(CASE WHEN kind = 'clear' THEN seq END) OVER (PARTITION BY workspace_id) AS c FROM (
      SELECT user_id AS workspace_id, event_id AS seq, kind, coalesce(CASE kind WHEN 'step' THEN 's' || (event_id % 4) WHEN 'agent' THEN 'a' || (event_id % 5) END, '') AS name,
             CASE kind WHEN 'goal' THEN 'g' || (event_id % 3) WHEN 'step' THEN CASE event_id % 2 WHEN 0 THEN 'open' ELSE 'done' END ELSE CASE event_id % 11 % 2 WHEN 0 THEN 'here' ELSE 'gone' END END AS value
      FROM (SELECT *, CASE WHEN event_id % 37 = 0 THEN 'clear' WHEN event_type = 'purchase' THEN 'goal' WHEN event_type = 'click' THEN 'step' ELSE 'agent' END AS kind FROM events)))
    WHERE kind <> 'clear' AND seq > coalesce(c, -1) QUALIFY row_number() OVER (PARTITION BY workspace_id, kind, name ORDER BY seq DESC) = 1)
  GROUP BY workspace_id"""


def workspace_state(spark, d):
    w = _workspaces(spark, d)
    steps = F.array_join(F.transform(F.array_sort(F.map_entries("plan_status")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return w.select("workspace_id", "goal", steps.alias("steps"), F.array_join("active_agents", ",").alias("agents"))


def workspace_fidelity(spark, d):
    """Each workspace against the next by number."""
    w = _workspaces(spark, d)
    s = w.select("workspace_id", F.struct("goal", "plan_status", "active_agents").alias("a"))
    n = w.select((F.col("workspace_id") - 1).alias("workspace_id"), F.struct("goal", "plan_status", "active_agents").alias("b"))
    return s.join(n, "workspace_id").select("workspace_id", F.round(tb.fidelity("a", "b"), 6).alias("fidelity"))


def _ledger(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("agent_id"), "event_type", F.to_json(F.struct(F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string"))).alias("platform"))).alias("data"))


def event_entities(spark, d):
    return el.event_entities(_ledger(spark, d))[0]


def event_relationships(spark, d):
    return el.event_entities(_ledger(spark, d))[1]


def gate_events(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("tile_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("phi"), F.when(F.col("event_id") % 4 == 0, F.col("value") / 2).alias("trust"), (F.col("event_id") % 50 == 0).alias("consensus"))
    return el.gate_from_events(e).select("tile_id", F.round("phi", 6).alias("phi"), F.round("trust", 6).alias("trust"), "consensus")


def event_replay(spark, d):
    return el.replay(table(spark, d, "events").withColumnRenamed("event_id", "seq"), ["click", "view", "purchase"])


def event_lookup(spark, d):
    """The events of every twentieth number, by their hash."""
    h = el.event_hash(F.col("event_id").cast("string"), F.col("event_type")).alias("hash")
    l = table(spark, d, "events").select("event_id", "user_id", "event_type", h)
    return el.event_by_hash(l, l.where("event_id % 20 = 0")).select("hash", "event_id", "user_id")


def greeting_sessions(spark, d):
    """Messages by their place in a conversation as minutes: a greeting opens a session sooner."""
    c = table(spark, d, "conversations").where("role = 'user'")
    at = F.when(F.col("turn") % 5 != 4, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("turn") * 20).cast("int")))
    t = c.select("conv_id", "turn", at.alias("at"), F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat(F.lit("Hello Gemini "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))
    return el.gap_sessions(t, "conv_id", "at", "turn", "2 hours", text="text").select("conv_id", "turn", "session_index")


QUERIES = {f.__name__: f for f in (tile_upsert, document_patch, property_clear, document_overlay, content_backfill, tiles_of_hash, hash_prefix, path_contains, session_expand, session_backfill, session_reconstruct, pending_skip, lease_take, lease_complete, cache_lookup, query_cache_key, priority_dedup, status_histogram, label_counts, workspace_state, workspace_fidelity, event_entities, event_relationships, gate_events, event_replay, event_lookup, greeting_sessions)}

_H = "substring(sha256(text), 1, 16)"
SQL = {
    "tile_upsert": "WITH t AS (SELECT doc_id, lang, source, n_chars FROM documents) SELECT doc_id, lang, source, CASE WHEN doc_id % 4 = 0 THEN n_chars + 2 WHEN doc_id % 2 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM t UNION ALL SELECT -doc_id - 1, lang, source, n_chars + 1 FROM t WHERE doc_id % 2 = 0",
    "document_patch": "SELECT doc_id, CASE WHEN source = 'src1' THEN NULL ELSE q END AS quality, CASE WHEN source = 'src1' OR x IS NULL THEN -1 ELSE x END AS toxic FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS q, min(toxic) AS x FROM labels GROUP BY doc_id) USING (doc_id)",
    "property_clear": "SELECT doc_id, CASE WHEN source NOT IN ('src0', 'src1') THEN lang END AS lang, CASE WHEN source NOT IN ('src0', 'src1') THEN n_chars END AS n_chars FROM documents",
    "document_overlay": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 <> 0 THEN upper(lang) ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 'overlaid' ELSE source END AS source, n_chars FROM documents",
    "content_backfill": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "tiles_of_hash": f"SELECT DISTINCT {_H} AS content_hash, tile_index, start_char, end_char FROM ({tile_sql('search_512')}) WHERE {_H} IN (SELECT {_H} FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)",
    "hash_prefix": f"WITH h AS (SELECT doc_id, {_H} AS c FROM documents), a AS (SELECT DISTINCT substring(c, 1, 8 + doc_id % 5) AS prefix FROM h UNION SELECT 'x' || substring(c, 1, 7) FROM h) SELECT prefix, min(c) AS content_hash FROM a LEFT JOIN h ON starts_with(c, prefix) GROUP BY prefix",
    "path_contains": "SELECT page_id, url FROM pages WHERE contains(lower(url), '/de/')",
    "session_expand": "SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')",
    "session_backfill": f"WITH l AS ({_LINKED}) SELECT tile_id, session_id, min(turn) AS exchange_index FROM l GROUP BY tile_id, session_id HAVING count(*) FILTER (turn % 3 = 0) = 0",
    "session_reconstruct": "SELECT conv_id AS session_id, turn AS exchange_index, conv_id || ':' || turn AS tile_id, (o > 1)::INT AS n_superseded FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS o FROM conversations) WHERE role <> 'system'",
    "pending_skip": "SELECT CAST(doc_id AS VARCHAR) AS item FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "lease_take": f"WITH l AS ({_LEASES}), held AS (SELECT item FROM l WHERE done OR expires_at > TIMESTAMP '{_NOW}'), n AS (SELECT c_custkey AS item FROM customer WHERE c_custkey NOT IN (SELECT item FROM held)) SELECT owner, done, count(*) AS n, min(item) AS first, max(item) AS last FROM (SELECT item, owner, done FROM l WHERE item NOT IN (SELECT item FROM n) UNION ALL SELECT item, 'w9', FALSE FROM n) GROUP BY owner, done",
    "lease_complete": f"SELECT item, owner, done OR owner = 'w1' OR expires_at <= TIMESTAMP '{_NOW}' AS done FROM ({_LEASES})",
    "cache_lookup": f"WITH q AS (SELECT vec_id AS query_id, 'k' || CAST(vec_id + vec_id % 40 // 20 AS BIGINT) AS key, label, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT 'k' || vec_id AS key, label, embedding AS v FROM embeddings WHERE vec_id % 20 <> 0 AND vec_id % 7 * 900 > 3600), e AS (SELECT query_id, q.key FROM q JOIN c USING (key)), n AS (SELECT query_id, min_by(c.key, {{'s': -({_SIM}), 'k': c.key}}) AS key FROM q JOIN c ON q.label = c.label WHERE query_id NOT IN (SELECT query_id FROM e) AND {_SIM} >= 0.6 GROUP BY query_id) SELECT query_id, coalesce(e.key, n.key) AS cached_key, CASE WHEN e.key IS NOT NULL THEN 'exact' WHEN n.key IS NOT NULL THEN 'similar' END AS how FROM q LEFT JOIN e USING (query_id) LEFT JOIN n USING (query_id)",
    "query_cache_key": "SELECT item_id, substring(sha256(lower(trim(text)) || '|exact|lang=en|platform=p' || (item_id % 3)), 1, 24) AS key FROM benchmark",
    "priority_dedup": "WITH l AS (SELECT doc_id, md5(text) AS content_hash, CASE WHEN toxic = 1 THEN 1 WHEN labels.doc_id IS NOT NULL THEN 2 ELSE 3 END AS priority FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, content_hash, priority FROM l QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY priority, doc_id) = 1",
    "status_histogram": "SELECT coalesce(CAST(quality AS VARCHAR), 'NULL') AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "label_counts": " UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n FROM {n}" for n in ("documents", "conversations", "events", "pages", "labels")),
    "workspace_state": _WORKSPACES,
    "workspace_fidelity": f"WITH w AS (SELECT workspace_id, goal, list_filter(string_split(steps, ','), lambda x: x <> '') AS s, list_filter(string_split(agents, ','), lambda x: x <> '') AS g FROM ({_WORKSPACES})) SELECT a.workspace_id, round(CAST(CASE WHEN a.goal IS NOT DISTINCT FROM b.goal THEN 0.4 ELSE 0 END AS DOUBLE) + CAST(0.4 AS DOUBLE) * CASE WHEN len(list_distinct(list_concat(list_transform(a.s, lambda x: split_part(x, '=', 1)), list_transform(b.s, lambda x: split_part(x, '=', 1))))) = 0 THEN 1 ELSE CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(list_transform(a.s, lambda x: split_part(x, '=', 1)), list_transform(b.s, lambda x: split_part(x, '=', 1))))) END + CAST(0.2 AS DOUBLE) * CASE WHEN len(list_distinct(list_concat(a.g, b.g))) = 0 THEN 1 ELSE CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / len(list_distinct(list_concat(a.g, b.g))) END, 6) AS fidelity FROM w a JOIN w b ON b.workspace_id = a.workspace_id + 1",
    "event_entities": "SELECT entity_type, name, min(event_id) AS first_seq FROM (SELECT event_id, 'agent' AS entity_type, CAST(user_id AS VARCHAR) AS name FROM events UNION ALL SELECT event_id, 'concept', event_type FROM events UNION ALL SELECT event_id, 'platform', 'p' || (event_id % 4) FROM events WHERE event_id % 3 <> 0) GROUP BY 1, 2",
    "event_relationships": "SELECT CAST(user_id AS VARCHAR) AS source, event_type AS target, count(*) AS n_events, max(event_id) AS last_seq, 'PERFORMED' AS type FROM events GROUP BY user_id, event_type",
    "gate_events": "SELECT user_id AS tile_id, round(max_by(value, event_id) FILTER (event_id % 3 = 0), 6) AS phi, round(max_by(value / 2, event_id) FILTER (event_id % 4 = 0), 6) AS trust, bool_or(event_id % 50 = 0) AS consensus FROM events GROUP BY user_id",
    "event_replay": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "view", "purchase")) + ", max(event_id) AS last_seq FROM events GROUP BY user_id",
    "event_lookup": "SELECT substring(sha256(event_id || '|' || event_type), 1, 16) AS hash, event_id, user_id FROM events WHERE event_id % 20 = 0",
    "greeting_sessions": "SELECT conv_id, turn, sum(g) OVER (PARTITION BY conv_id ORDER BY tm NULLS LAST, turn) AS session_index FROM (SELECT *, CASE WHEN tm IS NULL OR p IS NULL THEN 1 WHEN tm - p > INTERVAL 2 HOUR THEN 1 WHEN tm - p > INTERVAL 30 MINUTE AND (conv_id + turn) % 3 = 0 THEN 1 ELSE 0 END AS g FROM (SELECT *, lag(tm) OVER (PARTITION BY conv_id ORDER BY tm NULLS LAST, turn) AS p FROM (SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(turn * 20 AS BIGINT)) END AS tm FROM conversations WHERE role = 'user')))",
}
