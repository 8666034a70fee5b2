"""Message log with consumer groups, sliding windows, late rows, interval joins and bounded logs, each against batch."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from engramma.session import table
from engramma.storage import new_path
from engramma.streaming import log, windows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def run(q):
    q.awaitTermination()


def sink(df, spark, name, mode, path):
    run(df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start())
    return spark.table(name)


def test_a_group_loses_and_doubles_nothing(spark, tmp_path):
    folder, out = new_path(spark, "log"), str(tmp_path / "out")
    for k in range(4):
        log.append(spark.range(k * 50, k * 50 + 50).select(F.col("id"), F.concat(F.lit("m"), "id").alias("body")).repartition(2), folder)
    assert log.lag(folder, "g") == {"main": 4, "retry": 0}
    failing = {"once": True}

    def handle(df):
        if failing["once"] and df.where("id = '120'").limit(1).count():
            failing["once"] = False
            raise RuntimeError("the consumer dies in its second batch")
        # every seventh fails when it first comes, and 13 always
        return df.withColumn("ok", ~((F.col("id").cast("long") % 7 == 0) & (F.col("tries") == 0)) & (F.col("id") != "13"))

    def start():
        return log.consume(log.messages(spark, folder, "g", 2), handle, folder, out, str(tmp_path / "cp"))

    run(start())
    with pytest.raises(Exception, match="dies"):
        run(start())
    for _ in range(6):
        run(start())
    done = [r["id"] for r in spark.read.parquet(f"{out}/done").collect()]
    assert sorted(map(int, done)) == [k for k in range(200) if k != 13]
    assert [(r["id"], r["tries"]) for r in spark.read.parquet(f"{out}/dead").collect()] == [("13", 2)]
    tries = {int(r["id"]): r["tries"] for r in spark.read.parquet(f"{out}/done").collect()}
    assert all(t == (k % 7 == 0) for k, t in tries.items())
    # the group goes on where it was, even with a new checkpoint; another group begins at the beginning
    n = log.append(spark.createDataFrame([("new", "x")], "id string, body string"), folder)
    fresh = sink(log.messages(spark, folder, "g"), spark, "fresh", "append", tmp_path)
    assert n == 4 and "new" in {r["id"] for r in fresh.collect()} and fresh.where("try_cast(id as long) < 100 and tries = 0").count() == 0
    other = sink(log.messages(spark, folder, "other"), spark, "other", "append", tmp_path)
    assert other.where("tries = 0").count() == 201


def arrivals(spark, tmp_path, rows, schema, name="in", parts=3):
    """``rows`` as files that a stream takes one at a time, in an order of their own."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        time.sleep(1.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def test_sliding_windows_equal_batch(spark, sf, tmp_path):
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    e.orderBy(F.rand(3)).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sink(windows.sliding_counts(stream, "at", "event_type", late="400 days", width="6 hours", slide="2 hours"), spark, "sliding", "complete", tmp_path)
    want = windows.sliding_counts(e, "at", "event_type", width="6 hours", slide="2 hours")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and got.count() > 0


def test_late_rows_are_told(spark, tmp_path):
    rows = [(k, at(m)) for k, m in enumerate([0, 10, 100, 95, 20, 130, 89, 119, 5, 131])] + [(99, None)]
    schema = "k int, at timestamp"
    out = str(tmp_path / "out")
    batches = [rows[:3], rows[3:6], rows[6:]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.05)
    run(windows.split_late(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "at", 600, out, str(tmp_path / "cp")))
    late, seen = set(), None
    for b in batches:
        late |= {k for k, t in b if t is None or (seen and t < seen - datetime.timedelta(minutes=10))}
        seen = max([seen or at(0), *(t for _, t in b if t)])
    assert {r["k"] for r in spark.read.parquet(f"{out}/late").collect()} == late == {4, 6, 7, 8, 99}
    assert {r["k"] for r in spark.read.parquet(f"{out}/on_time").collect()} == {k for k, _ in rows} - late


def test_interval_join_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    schema = "user int, at timestamp, row int"
    left, right = ([(rng.randrange(5), at(rng.randrange(600)), k) for k in range(90)] for _ in range(2))
    streams = [arrivals(spark, tmp_path, rows, schema, name) for rows, name in ((left, "l"), (right, "r"))]
    got = sink(windows.interval_join(*streams, "user", "at", "30 MINUTES", late="20 hours"), spark, "joined", "append", tmp_path)
    want = windows.interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "user", "at", "30 MINUTES")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and got.count() > 0


def test_bounded_logs_equal_batch_and_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        schema = "user string, seq long, body string, at timestamp"
        rng = random.Random(4)
        first = [("a", k, f"b{k}", at(k)) for k in range(30)] + [("gone", k, "x", at(k)) for k in range(3)]
        first += rng.sample(first, 10)  # repeated
        second = [("a", k, f"b{k}", at(k)) for k in range(25, 60)] + [("late", 5, "x", at(50)), ("late", 4, "x", at(49))]
        third = [("late", 2, "x", at(48)), ("a", 58, "again", at(58)), ("clock", 1, "x", at(400))]
        fourth = [("clock", 2, "x", at(401))]
        for rows in (first, second, third, fourth):
            rng.shuffle(rows)
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(1.05)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = sink(windows.bounded_log(stream, "user", keep=20, ttl_seconds=3600), spark, "logs", "update", tmp_path).collect()
        living = {}
        for r in got:
            if r["state"] == "living":
                living.setdefault(r["key"], []).append((r["n"], r["first_seq"], r["last_seq"]))
        # the last 20 of each key, a number once: what a batch over all rows gives
        every = spark.createDataFrame(first + second + third, schema).dropDuplicates(["user", "seq"])
        want = {r["user"]: (r["n"], r["f"], r["l"]) for r in every.withColumn("r", F.expr("row_number() over (partition by user order by seq desc)")).where("r <= 20").groupBy("user").agg(F.count("*").alias("n"), F.min("seq").alias("f"), F.max("seq").alias("l")).collect()}
        assert {k: v[-1] for k, v in living.items() if k in ("a", "gone", "late")} == {k: want[k] for k in ("a", "gone", "late")}
        assert {r["key"] for r in got if r["state"] == "expired"} == {"a", "gone", "late"} and living["clock"][-1] == (2, 1, 2)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
