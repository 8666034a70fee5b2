"""Windows, late rows, joins of two streams, and bounded logs a key with their own expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events that a bounded log keeps.
KEEP = 10_000


def sliding_counts(events: DataFrame, at: str, by: str, late: str = "10 minutes", width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """(start, end, by, n): rows in every sliding window of event time, batch or stream. A stream leaves out rows later than ``late``."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, width, slide).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", "w.end", by, "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, within: str, late: str = "10 minutes") -> DataFrame:
    """(key, left_at, right_at, left, right): every row of ``right`` that follows a row of ``left`` of the same key within an interval.

    Two streams or two tables (key, ``at``, and a column ``row``). Streams keep state for the interval and the lateness only.
    """
    a = left.select(F.col(key).alias("lk"), F.col(at).alias("left_at"), F.col("row").alias("left"))
    b = right.select(F.col(key).alias("rk"), F.col(at).alias("right_at"), F.col("row").alias("right"))
    if a.isStreaming:
        a, b = a.withWatermark("left_at", late), b.withWatermark("right_at", late)
    j = a.join(b, F.expr(f"lk = rk AND right_at >= left_at AND right_at <= left_at + INTERVAL {within}"))
    return j.select(F.col("lk").alias(key), "left_at", "right_at", "left", "right")


def split_late(events: DataFrame, at: str, late_seconds: int, out: str, checkpoint: str):
    """Starts a query that writes a stream's rows to ``out/on_time``, or to ``out/late`` if they are behind the watermark.

    The watermark of a batch is the latest time of the batches before it less the lateness, as Spark's own; each batch
    writes down its latest time, so one that is run again decides alike. Rows without a time are late.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        seen = [r["t"] for r in _marks(spark, out, df.schema[at].dataType).where(F.col("batch") < batch_id).agg(F.max("t").alias("t")).collect()]  # a row a batch
        path = f"{out}/arrived/batch={batch_id}"
        df.write.mode("overwrite").parquet(path)
        kept = spark.read.schema(df.schema).parquet(path)
        mark = F.lit(seen[0]).cast("timestamp") - F.expr(f"INTERVAL {late_seconds} SECONDS") if seen[0] is not None else F.lit(None).cast("timestamp")
        behind = F.col(at).isNull() | F.coalesce(F.col(at).cast("timestamp") < mark, F.lit(False))
        kept.where(~behind).write.mode("overwrite").parquet(f"{out}/on_time/batch={batch_id}")
        kept.where(behind).withColumn("watermark", mark).write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        kept.agg(F.max(at).alias("t")).write.mode("overwrite").parquet(f"{out}/marks/batch={batch_id}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _marks(spark: SparkSession, out: str, kind: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("t", kind), T.StructField("batch", T.LongType())])
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{out}/marks")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{out}/marks") if there else spark.createDataFrame([], schema)


class _BoundedLog(StatefulProcessor):
    """The last ``keep`` events of a key, each number once, until ``ttl`` seconds of event time have passed since the latest."""

    def __init__(self, keep: int, ttl_seconds: int):
        self.keep, self.ttl = keep, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "seq long, body string, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {r[0]: tuple(r) for r in self.events.get()} if self.events.exists() else {}
        now = timerValues.getCurrentWatermarkInMs() // 1000
        for pdf in rows:
            for seq, body, at in zip(pdf["seq"].tolist(), pdf["body"].tolist(), (pdf["at"].astype("int64") // 10**6 if pdf["at"].dtype == "datetime64[us]" else pdf["at"].astype("datetime64[s]").astype("int64")).tolist(), strict=True):
                if at + self.ttl > now:  # what has run out already does not come back
                    held.setdefault(seq, (seq, body, at))
        last = sorted(held.values())[-self.keep :]
        if not last:
            return
        self.events.put(last)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((max(at for _, _, at in last) + self.ttl) * 1000)
        yield pd.DataFrame({"key": [key[0]], "n": [len(last)], "first_seq": [last[0][0]], "last_seq": [last[-1][0]], "state": ["living"]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = sorted(tuple(r) for r in self.events.get()) if self.events.exists() else []
        self.events.clear()
        if last:
            yield pd.DataFrame({"key": [key[0]], "n": [0], "first_seq": [last[0][0]], "last_seq": [last[-1][0]], "state": ["expired"]})

    def close(self) -> None:
        pass


def bounded_log(events: DataFrame, key: str, keep: int = KEEP, ttl_seconds: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """A stream of each key's log after every batch that touches it: (key, n, first_seq, last_seq, state).

    Events are (``key``, seq, body, at). A key keeps its last ``keep`` events by seq, a seq once, and forgets them by its
    own timer, ``ttl_seconds`` of event time after its latest event (then a row says ``expired``). Needs the RocksDB
    state store.
    """
    kind = events.schema[key].dataType.simpleString()
    e = events.withWatermark("at", late).select(F.col(key).alias("key"), F.col("seq").cast("long").alias("seq"), F.col("body").cast("string").alias("body"), "at")
    return e.groupBy("key").transformWithStateInPandas(_BoundedLog(keep, ttl_seconds), f"key {kind}, n long, first_seq long, last_seq long, state string", "Update", "EventTime")
