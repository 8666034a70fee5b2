import datetime
import math

from pyspark.sql import functions as F

from engramma.functions import register
from engramma.functions import text as tx
from engramma.operators import motifs
from engramma.session import table
from engramma.streaming import consolidate as st


def test_stream_equals_batch(spark, sf, tmp_path):
    e = table(spark, sf, "events")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    q = st.consolidate(st.event_stream(spark, str(tmp_path / "in"), e.schema, 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out/events"))
    assert back.count() == e.count() and len([p for p in (tmp_path / "out/events").iterdir() if p.name.startswith("batch=")]) == 3
    n = spark.read.parquet(str(tmp_path / "out/relationships")).groupBy("source", "target").agg(F.sum("n_events").alias("n"))
    assert n.exceptAll(e.groupBy(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("target")).agg(F.count("*").alias("n"))).count() == 0
    assert st.entity_totals(spark, str(tmp_path / "out")).where("entity_type = 'agent'").count() == e.select("user_id").distinct().count()
    cycles = st.page_curve(spark.read.parquet(str(tmp_path / "out/cycles"))).orderBy("batch_id").collect()
    assert len(cycles) == 3 and cycles[0]["grows"] and all(c["grows"] == (c["entropy"] >= p["entropy"]) for p, c in zip(cycles, cycles[1:]))


def test_fields_from_updates(spark, sf):
    u = st.field_updates(table(spark, sf, "events"))
    f = motifs.resonance(u, F.lit(1706745600), F.lit(1e9))
    assert f.where("amp > 1").count() == 0 and f.count() > 0


def _run(df, spark, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_keyed_fields_keep_the_decayed_maximum(spark, tmp_path):
    batches = [[(0, "a", 0.9, 100), (0, "b", 0.2, 100)], [(0, "a", 0.5, 200)], [(0, "a", 0.1, 5000), (1, "a", 0.3, 5000)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k long, motif_id string, amp double, at long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i < len(batches) - 1:
            __import__("time").sleep(1.1)  # files are taken in the order of their times
    stream = st.event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    got = _run(st.resonance_fields(stream, {0: 1000.0, 1: 1e9}), spark, "fields", "update", tmp_path)
    state = {(r["k"], r["motif_id"], r["at"]): r["amp"] for r in got.collect()}
    assert abs(state[0, "a", 200] - 0.9 * math.exp(-0.1)) < 1e-9 and abs(state[0, "a", 5000] - 0.1) < 1e-9
    assert state[0, "b", 100] == 0.2 and state[1, "a", 5000] == 0.3


def _at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_once_each_and_windows(spark, tmp_path):
    rows = [("a", "x", _at(0)), ("a", "x", _at(1)), ("b", "y", _at(70)), ("c", "x", _at(75))]
    s = _stream(spark, tmp_path, rows, "id string, event_type string, at timestamp")
    once = _run(st.once_each(s, "id", "at"), spark, "once", "append", tmp_path)
    assert sorted(r["id"] for r in once.collect()) == ["a", "b", "c"]
    counts = _run(st.windowed_counts(s, "at"), spark, "counts", "complete", tmp_path)
    assert sorted((r["window"]["start"].hour, r["event_type"], r["n"]) for r in counts.collect()) == [(0, "x", 2), (1, "x", 1), (1, "y", 1)]


def test_keys_live_from_their_last_event(spark, tmp_path):
    s = _stream(spark, tmp_path, [("a", _at(0)), ("a", _at(60)), ("b", _at(30))], "id string, at timestamp")
    got = _run(st.living(s, "id", "at"), spark, "alive_keys", "complete", tmp_path)
    assert {r["id"]: r["expires_at"] for r in got.collect()} == {"a": _at(180), "b": _at(150)}


def test_functions_for_sql(spark):
    assert register.register(spark) == ["em_token_estimate", "em_canonical", "em_sha16", "em_dot", "em_decay", "em_entropy", "em_jaccard", "em_tiles", "em_sessions"]
    assert spark.sql("SELECT em_entropy(array(1L, 1L, 2L, 0L)), em_entropy(array())").first()[:] == (1.5, 0.0)
    cut = spark.sql("SELECT x.* FROM em_tiles(repeat('ab. ', 1000), 2048, 752) x").collect()
    assert [r["start_char"] for r in cut] == [0, 752, 1504, 2256, 3008] and all(r["content"] == ("ab. " * 1000)[r["start_char"] : r["end_char"]] for r in cut) and cut[-1]["end_char"] == 4000
    assert [tuple(r) for r in spark.sql("SELECT x.* FROM em_tiles('', 2048, 752) x").collect()] == [(0, 0, 0, "")]
    d = spark.createDataFrame([("a  \r\nb\n\n\n\n\nc",)], "t string")
    d.createOrReplaceTempView("register_texts")
    r = spark.sql("SELECT em_canonical(t) AS c, em_sha16(t) AS h, em_token_estimate(t) AS n, em_dot(array(1D, 2D), array(3D, 4D)) AS d, em_decay(90D, 90D) AS y, em_jaccard(array('a'), array('a', 'b')) AS j FROM register_texts").first()
    want = d.select(tx.canonical(F.col("t")).alias("c"), tx.sha16(F.col("t")).alias("h")).first()
    assert (r["c"], r["h"], r["n"], r["d"], r["y"], r["j"]) == (want["c"], want["h"], 3, 11.0, 0.5, 0.5)
