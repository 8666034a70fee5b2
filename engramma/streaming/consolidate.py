"""Structured Streaming over event files, with the same expressions as the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engramma.operators import events as el


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once_each(events: DataFrame, key: str, at: str, within: str = "1 hour") -> DataFrame:
    """Each key once; state is kept for ``within`` of event time. ``at`` must be a timestamp."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def field_updates(events: DataFrame) -> DataFrame:
    """(k, motif_id, amp, at) of events (event_id, event_type, value, ts)."""
    return events.select((F.col("event_id") % 3).alias("k"), F.col("event_type").alias("motif_id"), F.least(F.lit(1.0), F.abs("value") / 100).alias("amp"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


def windowed_counts(events: DataFrame, at: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window of event time; later ones than ``late`` are not counted."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"))


def consolidate(events: DataFrame, out: str, checkpoint: str):
    """Starts a query that writes every micro-batch's events, entities and relationships under ``out``; a batch that is run again overwrites its own folder.

    Events are (event_id, user_id, event_type, props as JSON, …). What a batch tells of its own coherence (its type
    entropy and how densely its entities are related) goes to ``out/cycles``, a row a batch.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        place = lambda name: f"{out}/{name}/batch={batch_id}"
        df.write.mode("overwrite").parquet(place("events"))
        kept = df.sparkSession.read.schema(df.schema).parquet(place("events"))  # read once, told of three times
        e = kept.select(F.col("event_id").alias("seq"), F.col("user_id").alias("agent_id"), "event_type", F.col("props").alias("data"))
        entities, acts = el.event_entities(e)
        entities.write.mode("overwrite").parquet(place("entities"))
        acts.write.mode("overwrite").parquet(place("relationships"))
        counts = entities.agg(F.count("*").alias("n")).crossJoin(acts.agg(F.count("*").alias("m"))).crossJoin(el.entropy(kept))
        counts.select(F.lit(batch_id).alias("batch_id"), "entropy", el.graph_coherence(F.col("n"), F.col("m")).alias("coherence")).write.mode("overwrite").parquet(place("cycles"))

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entity_totals(spark: SparkSession, out: str) -> DataFrame:
    """(entity_type, name, first_seq) over all batches that were written."""
    e = spark.read.parquet(f"{out}/entities")
    return e.groupBy("entity_type", "name").agg(F.min("first_seq").alias("first_seq"))


def page_curve(cycles: DataFrame) -> DataFrame:
    """(batch_id, entropy, grows): whether a batch's entropy is at least that of the batch before."""
    w = Window.orderBy("batch_id")  # a row a batch
    return cycles.select("batch_id", "entropy", F.coalesce(F.col("entropy") >= F.lag("entropy").over(w), F.lit(True)).alias("grows"))


_FIELD = T.StructType([T.StructField("k", T.LongType()), T.StructField("motif_id", T.StringType()), T.StructField("amp", T.DoubleType()), T.StructField("at", T.LongType())])


def resonance_fields(updates: DataFrame, tau: dict[int, float], floor: float = 0.001) -> DataFrame:
    """A stream of each field's state, (k, motif_id, amp, at), after each batch of updates (k, motif_id, amp, at in seconds).

    A field keeps the largest of its decayed amplitude and its updates, each decayed to the latest time seen; a field
    below ``floor`` is dropped. State is two numbers a field.
    """
    import math

    import pandas as pd

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        amp, at = state.get if state.exists else (0.0, 0)
        for b in batches:
            now = max(at, int(b["at"].max()))
            down = lambda a, t: a * math.exp(-(now - t) / tau.get(int(key[0]), 86400.0))  # noqa: E731, B023
            amp = max([down(amp, at), *(down(a, t) for a, t in zip(b["amp"], b["at"]))])
            at = now
        if amp < floor:
            if state.exists:
                state.remove()
        else:
            state.update((amp, at))
            yield pd.DataFrame({"k": [key[0]], "motif_id": [key[1]], "amp": [amp], "at": [at]})

    return updates.groupBy("k", "motif_id").applyInPandasWithState(fold, _FIELD, "amp double, at long", "update", GroupStateTimeout.NoTimeout)


def living(events: DataFrame, key: str, at: str, ttl: str = "2 hours") -> DataFrame:
    """A stream of the keys whose time to live runs from their last event, told with its end; state goes when it has run out."""
    return events.withWatermark(at, ttl).groupBy(F.session_window(at, ttl), key).agg(F.max(at).alias("last")).select(key, "last", F.col("session_window.end").alias("expires_at"))
