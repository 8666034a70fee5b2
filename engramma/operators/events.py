"""The event ledger: reads, branches, causes, sessions, entropy, coherence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.functions.text import sha16
from engramma.operators.graph import hops


def event_hash(*parts: Column) -> Column:
    return sha16(F.concat_ws("|", *parts))


def read_events(ledger: DataFrame, since: str | None = None, until: str | None = None, event_type: str | None = None, branch: str | None = None, limit: int | None = None, newest: bool = False, seq: str = "seq") -> DataFrame:
    """Events of a period (both ends included), a type and a branch, in log order, at most ``limit``; ``newest`` takes the last ones."""
    e = ledger
    if since is not None:
        e = e.where(F.col("ts") >= F.lit(since).cast(ledger.schema["ts"].dataType))
    if until is not None:
        e = e.where(F.col("ts") <= F.lit(until).cast(ledger.schema["ts"].dataType))
    if event_type is not None:
        e = e.where(F.col("event_type") == event_type)
    if branch is not None:
        e = e.where(F.col("branch") == branch)
    e = e.orderBy(F.desc(seq) if newest else F.asc(seq))
    return e.limit(limit) if limit else e


def fork(ledger: DataFrame, new_branch: str, from_branch: str = "main", up_to: int | None = None) -> DataFrame:
    """The ledger with a branch that begins as a copy of another, whole or up to a sequence number."""
    own = ledger.where(F.col("branch") == from_branch)
    if up_to is not None:
        own = own.where(F.col("seq") <= up_to)
    return ledger.unionByName(own.withColumn("branch", F.lit(new_branch)))


def merge(ledger: DataFrame, source: str, into: str = "main") -> DataFrame:
    """The ledger with what ``source`` has and ``into`` lacks, by hash, added to ``into``."""
    have = ledger.where(F.col("branch") == into).select("hash")
    new = ledger.where(F.col("branch") == source).join(have, "hash", "left_anti").select(*ledger.columns).withColumn("branch", F.lit(into))
    return ledger.unionByName(new)


def entropy(events: DataFrame, of: str = "event_type", by: tuple[str, ...] = ()) -> DataFrame:
    """Shannon entropy in bits of the shares of ``of``."""
    c = events.groupBy(*by, of).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else None
    if total is None:
        c = c.crossJoin(F.broadcast(events.agg(F.count("*").alias("t"))))
    else:
        c = c.withColumn("t", total)
    return c.withColumn("p", F.col("n") / F.col("t")).groupBy(*by).agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


# How a message begins that opens a conversation.
GREETINGS = ("start research", "hi gemini", "hey gemini", "gemini,", "hello gemini", "hi map")


def gap_sessions(events: DataFrame, user: str | Sequence[str], at: str, tie: str, gap: str = "2 hours", text: str | None = None, greeting_gap: str = "30 minutes") -> DataFrame:
    """Adds session_index: a new session begins where the time since the last event is longer than ``gap``.

    With ``text`` one begins after ``greeting_gap`` already if the text opens with a greeting, and where either time is
    unknown; events of unknown time come last.
    """
    users = [user] if isinstance(user, str) else list(user)
    w = Window.partitionBy(*users).orderBy(F.asc_nulls_last(at), tie)
    since = F.col(at) - F.lag(at).over(w)
    new = since > F.expr(f"INTERVAL {gap}")
    if text is not None:
        head = F.lower(F.substring(F.lower(text), 1, 50))
        greets = F.lit(False)
        for g in GREETINGS:
            greets = greets | head.startswith(g)
        new = F.coalesce(new | (greets & (since > F.expr(f"INTERVAL {greeting_gap}"))), F.lit(True))
    e = events.withColumn("__g", F.coalesce(new.cast("int"), F.lit(1)))
    return e.withColumn("session_index", F.sum("__g").over(w)).drop("__g")


def causes(ledger: DataFrame, starts: DataFrame, depth: int = 10, effects: bool = False) -> DataFrame:
    """(start, node, distance): what each event in ``starts`` goes back to by caused_by, or with ``effects`` leads to."""
    e = ledger.where("caused_by is not null")
    edges = e.select(F.col("caused_by").alias("src"), F.col("seq").alias("dst")) if effects else e.select(F.col("seq").alias("src"), F.col("caused_by").alias("dst"))
    return hops(edges, starts, depth)


def last_n(events: DataFrame, by: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return events.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def active_agents(events: DataFrame, agent: str, at: str, now: Column, within: str = "60 seconds") -> DataFrame:
    return events.groupBy(agent).agg(F.max(at).alias("last_active")).where(F.col("last_active") > now - F.expr(f"INTERVAL {within}"))


def graph_coherence(n_nodes: Column, n_edges: Column) -> Column:
    """min(1, 0.5 + 0.5 * edges / possible edges); 1 for an empty graph."""
    possible = n_nodes * (n_nodes - 1) / 2
    return F.when(n_nodes == 0, F.lit(1.0)).when(possible == 0, F.lit(0.5)).otherwise(F.least(F.lit(1.0), 0.5 + 0.5 * n_edges / possible))


def event_layer(event_type: Column, first: list[str], second: list[str]) -> Column:
    return F.when(event_type.isin(first), 0).when(event_type.isin(second), 1).otherwise(2)


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses == 0, F.lit(0.0)).otherwise(hits / (hits + misses))


def phi_coherence(temporal: float, relational: float, functional: float) -> float:
    """The second-smallest eigenvalue of the Laplacian of a triangle whose sides weigh the products of the three, by 3, at most 1."""
    a, b, c = temporal * relational, relational * functional, temporal * functional
    s = a + b + c
    return min(1.0, (s - max(0.0, a * a + b * b + c * c - a * b - b * c - a * c) ** 0.5) / 3)


def event_by_hash(ledger: DataFrame, hashes: DataFrame) -> DataFrame:
    """The ledger's events of a list of hashes."""
    return ledger.join(hashes.select("hash").distinct(), "hash", "left_semi")


def replay(ledger: DataFrame, kinds: list[str], seq: str = "seq") -> DataFrame:
    """(user_id, one column a kind, last_seq): the ledger folded into each user's counts of the kinds, whatever order it is read in."""
    return ledger.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds), F.max(seq).alias("last_seq"))


def event_entities(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) that events (seq, agent_id, event_type, data as JSON) tell of.

    An event's agent, its type as a concept and its data's platform are entities (entity_type, name, first_seq); an
    agent has PERFORMED a type (source, target, type, n_events, last_seq). Unreadable data names no platform.
    """
    name = lambda kind, c: F.struct(F.lit(kind).alias("entity_type"), c.alias("name"))
    found = F.array(name("agent", F.col("agent_id").cast("string")), name("concept", F.col("event_type")), name("platform", F.get_json_object("data", "$.platform")))
    e = events.select("seq", F.explode(found).alias("x")).where("x.name is not null")
    entities = e.groupBy("x.entity_type", "x.name").agg(F.min("seq").alias("first_seq"))
    acts = events.where("agent_id is not null and event_type is not null").groupBy(F.col("agent_id").cast("string").alias("source"), F.col("event_type").alias("target")).agg(F.count("*").alias("n_events"), F.max("seq").alias("last_seq")).withColumn("type", F.lit("PERFORMED"))
    return entities, acts


def gate_from_events(events: DataFrame) -> DataFrame:
    """(tile_id, phi, trust, consensus) of gate events (tile_id, seq, phi, trust, consensus): the last event with a value counts, consensus is that of any."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return events.groupBy("tile_id").agg(last("phi"), last("trust"), F.coalesce(F.bool_or("consensus"), F.lit(False)).alias("consensus"))
