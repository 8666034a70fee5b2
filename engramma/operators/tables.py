"""Keyed tables: upserts, patches, lookups, expansions, links, leases, expiry, a result cache.

A table is a DataFrame and a change gives a new one; ``publish`` writes it as the next version of a folder, so a reader
sees a whole version or the one before, and a job that fails leaves no half of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _whole(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def latest(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The last row of each key by ``order``. Rows are reduced before they are shuffled, so a key with many is no hot task."""
    last = rows.groupBy(*keys).agg(F.max_by(_whole(rows), F.struct(*order)).alias("__r"))
    return last.select("__r.*")


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """``table`` with ``changes`` laid over it by key: a changed row replaces the old one whole, a new one is added.

    Both have the same columns. Of several changes of a key the last by ``order`` counts (then the greatest row); a row
    that is written twice changes nothing, so a batch may run again. Null keys are keys.
    """
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.select(*table.columns).withColumn("__new", F.lit(1)))
    return latest(both, [f"`{k}`" for k in keys], "__new", *order, *(F.to_json(F.struct(F.col(f"`{c}`"))) for c in table.columns)).drop("__new")


def patch(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], unless: Column | None = None) -> DataFrame:
    """``table`` with ``columns`` set from ``changes`` (one row a key) where the key is there; nulls in a change leave the old value.

    Rows for which ``unless`` holds are not touched. Keys that only the changes have are left out: a patch adds no rows.
    """
    c = changes.select(F.col(key).alias("__k"), *(F.col(x).alias(f"__{x}") for x in columns))
    j = table.join(c, F.col(key) == F.col("__k"), "left")
    free = F.lit(True) if unless is None else ~F.coalesce(unless, F.lit(False))
    new = {x: F.when(free, F.coalesce(F.col(f"__{x}"), F.col(x))).otherwise(F.col(x)) for x in columns}
    return j.withColumns(new).select(*table.columns)


def cleared(table: DataFrame, where: Column, columns: Sequence[str]) -> DataFrame:
    """``table`` with ``columns`` null in the rows for which ``where`` holds."""
    return table.withColumns({c: F.when(~F.coalesce(where, F.lit(False)), F.col(c)) for c in columns})


def overlay(base: DataFrame, over: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``base`` with each of ``columns`` taken from ``over`` (one row a key) where that is neither null nor empty."""
    kind = dict(over.dtypes)
    filled = lambda c: F.when(F.size(f"__{c}") > 0, F.col(f"__{c}")) if kind[c].startswith("array") else F.when(F.col(f"__{c}").cast("string") != "", F.col(f"__{c}"))
    o = over.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    return base.join(o, F.col(key) == F.col("__k"), "left").withColumns({c: F.coalesce(filled(c), F.col(c)) for c in columns}).select(*base.columns)


def fill_empty(rows: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` taken from ``source`` (one row a key) where it is null or empty."""
    o = source.select(F.col(key).alias("__k"), F.col(column).alias("__v"))
    return rows.join(o, F.col(key) == F.col("__k"), "left").withColumn(column, F.coalesce(F.when(F.col(column) != "", F.col(column)), F.col("__v"), F.col(column))).select(*rows.columns)


def append_once(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with those of ``rows`` whose key it lacks, each key once: adding to a set."""
    new = rows.dropDuplicates([key]).join(table.select(key), key, "left_anti")
    return table.unionByName(new.select(*table.columns))


def bounded(rows: DataFrame, order: str, keep: int, by: Sequence[str] = ()) -> DataFrame:
    """The last ``keep`` rows, of each group if ``by`` is given."""
    if not by:
        return rows.orderBy(F.desc(order)).limit(keep)
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def lookup(table: DataFrame, keys: DataFrame, key: str, scale: str | None = None) -> DataFrame:
    """The rows of a list of keys (a table with the key's column), of one scale if given. Rows come once however often a key is asked."""
    t = table if scale is None else table.where(F.col("scale") == scale)
    return t.join(keys.select(key).distinct(), key, "left_semi")


def resolve_prefixes(prefixes: DataFrame, table: DataFrame, key: str, prefix: str = "prefix") -> DataFrame:
    """(prefix, key): the smallest key that begins with each prefix, null if none does. A join by equality for each length of prefix."""
    asked = prefixes.select(F.col(prefix).alias("prefix")).where("prefix is not null").distinct()
    lengths = [r["n"] for r in asked.select(F.length("prefix").alias("n")).distinct().collect()]  # as many as a key has characters
    keys = table.select(F.col(key).alias("__k")).where("__k is not null").distinct()
    heads = keys.select("__k", F.explode(F.array(*(F.substring("__k", 1, n) for n in lengths or [0]))).alias("prefix")).where(F.length("prefix") > 0)
    first = heads.groupBy("prefix").agg(F.min("__k").alias(key))
    return asked.join(first, "prefix", "left")


def path_contains(table: DataFrame, path: str, fragment: str) -> DataFrame:
    """All rows whose path holds a fragment, in any case."""
    return table.where(F.lower(path).contains(fragment.lower()))


def expand(results: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` that the results name: the sessions or documents of what was found, each once."""
    return table.join(results.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def missing_links(tiles: DataFrame, exchanges: DataFrame, sessions: DataFrame, links: DataFrame) -> DataFrame:
    """(tile_id, session_id, exchange_index) that ``links`` lacks: a tile belongs where its content hash is an exchange's."""
    e = exchanges.select("content_hash", "session_id", "exchange_index").join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    e = e.groupBy("content_hash", "session_id").agg(F.min("exchange_index").alias("exchange_index"))
    found = tiles.select("tile_id", "content_hash").distinct().join(e, "content_hash").select("tile_id", "session_id", "exchange_index")
    return found.join(links.select("tile_id", "session_id").distinct(), ["tile_id", "session_id"], "left_anti")


def reconstruct_session(tiles: DataFrame, links: DataFrame, superseded: DataFrame) -> DataFrame:
    """(session_id, exchange_index, tile_id, n_superseded): a session's tiles that are no snapshots, with how many versions each replaced."""
    n = superseded.groupBy(F.col("newer").alias("tile_id")).agg(F.count("*").alias("n_superseded"))
    t = tiles.where(~F.coalesce("is_snapshot", F.lit(False))).select("tile_id")
    return links.join(t, "tile_id").join(n, "tile_id", "left").select("session_id", "exchange_index", "tile_id", F.coalesce("n_superseded", F.lit(0)).alias("n_superseded"))


def pending(todo: DataFrame, done: DataFrame, key: str, strip: str = "") -> DataFrame:
    """What is left of ``todo``: keys that ``done`` lacks, both as they are and without the prefix ``strip``."""
    d = done.select(F.col(key).alias("__d"))
    d = d.unionByName(d.select(F.regexp_replace("__d", f"^{strip}", "").alias("__d"))) if strip else d
    return todo.join(d.distinct(), F.col(key) == F.col("__d"), "left_anti")


def take_leases(items: DataFrame, leases: DataFrame, key: str, owner: str, now: Column, seconds: int = 7200) -> DataFrame:
    """Leases (key, owner, expires_at, done) with one for each item that no one has done or holds, by ``owner`` until ``seconds`` from now."""
    held = leases.where(F.col("done") | (F.col("expires_at") > now)).select(key)
    new = items.select(key).distinct().join(held, key, "left_anti").select(key, F.lit(owner).alias("owner"), (now + F.expr(f"INTERVAL {seconds} SECONDS")).alias("expires_at"), F.lit(False).alias("done"))
    return leases.join(new.select(key), key, "left_anti").unionByName(new.select(*leases.columns))


def complete_leases(leases: DataFrame, finished: DataFrame, key: str, owner: str, now: Column) -> DataFrame:
    """Leases with the finished keys done, where the owner holds them or the lease has run out."""
    f = finished.select(F.col(key).alias("__f")).distinct()
    mine = F.col("__f").isNotNull() & ((F.col("owner") == owner) | (F.col("expires_at") <= now))
    return leases.join(f, F.col(key) == F.col("__f"), "left").withColumn("done", F.col("done") | mine).select(*leases.columns)


def alive(entries: DataFrame, at: str, ttl: str, now: Column) -> DataFrame:
    """Entries whose time to live, in seconds, has not run out."""
    return entries.where(F.col(at) + F.make_dt_interval(secs=F.col(ttl)) > now)


#: Seconds that results are kept, by kind of query. Fixed values.
RESULT_TTL = {"exact": 3600, "temporal": 900, "conceptual": 1800, "relational": 1800, "motif": 1800, "adaptive": 1800, "default": 1800}


def result_ttl(kind: Column) -> Column:
    c = F.lit(RESULT_TTL["default"])
    for k, v in RESULT_TTL.items():
        c = F.when(kind == k, F.lit(v)).otherwise(c)
    return c


def query_key(query: Column, kind: Column, filters: Column) -> Column:
    """The identity of a query for the cache: 24 hex digits over its trimmed lower case, its kind and its filters (a map) by name."""
    named = F.transform(F.array_sort(F.map_entries(filters)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.substring(F.sha2(F.encode(F.concat_ws("|", F.lower(F.trim(query)), kind, F.array_join(named, "|")), "utf-8"), 256), 1, 24)


def cache_hits(queries: DataFrame, cache: DataFrame, now: Column, least: float = 0.95) -> DataFrame:
    """(query_id, cached_key, how): for each query (query_id, key, scope, qv) the living entry of its key, else the most similar of its scope.

    A cache is (key, scope, vector, result, stored_at, ttl); ``scope`` is what must be equal (kind and filters). Every
    living entry of a scope is compared. Queries without a hit have nulls.
    """
    from engramma.functions.vector import cosine

    live = alive(cache, "stored_at", "ttl", now)
    exact = queries.select("query_id", "key").join(live.select("key").distinct(), "key").select("query_id", F.col("key").alias("cached_key"), F.lit("exact").alias("how"))
    rest = queries.join(exact.select("query_id"), "query_id", "left_anti").where("qv is not null")
    near = rest.select("query_id", "scope", "qv").join(live.select("key", "scope", "vector"), "scope").withColumn("s", cosine(F.col("qv"), F.col("vector"))).where(F.col("s") >= least)
    near = near.groupBy("query_id").agg(F.min_by("key", F.struct(-F.col("s"), "key")).alias("cached_key")).withColumn("how", F.lit("similar"))
    return queries.select("query_id").join(exact.unionByName(near), "query_id", "left")


def invalidated(cache: DataFrame, uses: DataFrame, changed: DataFrame) -> DataFrame:
    """The cache without entries whose results (uses: key, content_hash) hold changed content."""
    stale = uses.join(changed.select("content_hash").distinct(), "content_hash", "left_semi").select("key").distinct()
    return cache.join(stale, "key", "left_anti")


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(status).cast("string"), F.lit("NULL")).alias("status")).agg(F.count("*").alias("n"))


def label_counts(**tables: DataFrame) -> DataFrame:
    """(label, n): the number of rows of each table."""
    out = None
    for name, t in tables.items():
        c = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def priority_first(candidates: DataFrame, key: str, priority: str, tie: str, limit: int | None = None) -> DataFrame:
    """Each key once, from its most urgent list, in order of urgency; the first ``limit`` of them if given."""
    firsts = candidates.groupBy(key).agg(F.min_by(_whole(candidates), F.struct(priority, tie)).alias("__r")).select("__r.*")
    return firsts if limit is None else firsts.orderBy(priority, tie).limit(limit)


def workspace(changes: DataFrame) -> DataFrame:
    """(workspace_id, goal, plan_status, active_agents) from a log (workspace_id, seq, kind, name, value) of goals, steps and agents.

    Of a step's states and an agent's comings and goings the last counts; a cleared workspace forgets what came before.
    """
    wiped = changes.where("kind = 'clear'").groupBy("workspace_id").agg(F.max("seq").alias("__c"))
    c = changes.join(wiped, "workspace_id", "left").where((F.col("seq") > F.coalesce("__c", F.lit(-1))) & (F.col("kind") != "clear"))
    last = latest(c.select("workspace_id", "seq", "kind", F.coalesce("name", F.lit("")).alias("name"), "value"), ["workspace_id", "kind", "name"], "seq")
    steps = F.array_sort(F.collect_list(F.when(F.col("kind") == "step", F.struct("name", "value"))))
    agents = F.array_sort(F.collect_list(F.when((F.col("kind") == "agent") & (F.col("value") != "gone"), F.col("name"))))
    return last.groupBy("workspace_id").agg(F.max(F.when(F.col("kind") == "goal", F.col("value"))).alias("goal"), F.map_from_entries(steps).alias("plan_status"), agents.alias("active_agents"))


def fidelity(a: str, b: str) -> Column:
    """0.4 for the same goal, 0.4 times the share of equal steps, 0.2 times the Jaccard of agents, of two workspace structs; nothing to compare counts as equal."""
    goal = F.when(F.col(f"{a}.goal").eqNullSafe(F.col(f"{b}.goal")), 1.0).otherwise(0.0)
    steps = F.array_union(F.map_keys(f"{a}.plan_status"), F.map_keys(f"{b}.plan_status"))
    same = F.filter(steps, lambda s: F.element_at(f"{a}.plan_status", s).eqNullSafe(F.element_at(f"{b}.plan_status", s)))
    plan = F.when(F.size(steps) == 0, 1.0).otherwise(F.size(same) / F.size(steps))
    every = F.array_union(f"{a}.active_agents", f"{b}.active_agents")
    agents = F.when(F.size(every) == 0, 1.0).otherwise(F.size(F.array_intersect(f"{a}.active_agents", f"{b}.active_agents")) / F.size(every))
    return 0.4 * goal + 0.4 * plan + 0.2 * agents


def publish(df: DataFrame, folder: str, partition_by: Sequence[str] = ()) -> str:
    """Writes ``df`` as the next version of a table's folder and returns the version's path.

    A version counts once its marker of success is there, so readers never see half of one, and a failed write leaves
    the version before in place: no compensation is needed.
    """
    spark = df.sparkSession
    path = f"{folder}/version={_last_version(spark, folder) + 1:09d}"
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The last whole version of a table's folder."""
    n = _last_version(spark, folder)
    if n < 0:
        raise ValueError(f"{folder} has no whole version")
    return spark.read.parquet(f"{folder}/version={n:09d}")


def _last_version(spark: SparkSession, folder: str) -> int:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return -1
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    whole = [int(p.getName()[8:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(whole, default=-1)
