"""Several tables changed as one, and the row-level changes between versions of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramma.operators.commits import Conflict, Store, replayed
from engramma.session import table
from engramma.storage import new_path


def _tiles(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def multi_commit(spark, d):
    """Tiles and their counts by source, committed together, moved together, and read from one snapshot; a writer that knows only the first state changes nothing."""
    s = Store(spark, new_path(spark, "commits"))
    counted = lambda t: t.groupBy("source").agg(F.count("*").alias("n"))
    first = s.change(lambda _: {"tiles": _tiles(spark, d), "sources": counted(_tiles(spark, d))})

    def move(at):
        moved = s.read("tiles", at).withColumn("source", F.when(F.col("doc_id") % 7 == 0, "moved").otherwise(F.col("source")))
        return {"tiles": moved, "sources": counted(moved)}

    last = s.change(move)
    try:
        s.commit({"tiles": s.read("tiles", first).limit(0)}, first)
        raise AssertionError("a commit on an old state must fail")
    except Conflict:
        pass
    have = s.read("tiles", last).groupBy("source").agg(F.count("*").alias("n_tiles"))
    return have.join(s.read("sources", last), "source", "full").select("source", "n_tiles", F.col("n").alias("n_counted"))


def _versions(spark, d):
    """A keyed store with two versions of the documents: some go, some come, some change."""
    s = Store(spark, new_path(spark, "feed"))
    t = _tiles(spark, d).drop("source")
    s.change(lambda _: {"tiles": t.where("doc_id % 5 <> 0")}, keys={"tiles": ["doc_id"]})
    s.change(lambda _: {"tiles": t.where("doc_id % 7 <> 0").withColumn("text_md5", F.when(F.col("doc_id") % 3 == 0, F.reverse("text_md5")).otherwise(F.col("text_md5")))})
    return s


def change_feed(spark, d):
    """What the second version changed, row by row."""
    return _versions(spark, d).feed("tiles", 1).select("version", "change", F.coalesce("after.doc_id", "before.doc_id").alias("doc_id"), F.col("before.text_md5").alias("old_md5"), F.col("after.text_md5").alias("new_md5"))


def feed_replay(spark, d):
    """The feed laid over the first version: the second one."""
    s = _versions(spark, d)
    return replayed(s.read("tiles", s.snapshot(1)), s.feed("tiles", 1), ["doc_id"])


QUERIES = {f.__name__: f for f in (multi_commit, change_feed, feed_replay)}
_SECOND = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN reverse(md5(text)) ELSE md5(text) END AS text_md5 FROM documents WHERE doc_id % 7 <> 0"
SQL = {
    "multi_commit": "SELECT CASE WHEN doc_id % 7 = 0 THEN 'moved' ELSE source END AS source, count(*) AS n_tiles, count(*) AS n_counted FROM documents GROUP BY 1",
    "change_feed": f"""SELECT CAST(2 AS BIGINT) AS version, CASE WHEN a.doc_id IS NULL THEN 'insert' WHEN b.doc_id IS NULL THEN 'delete' ELSE 'update' END AS change, coalesce(b.doc_id, a.doc_id) AS doc_id, a.text_md5 AS old_md5, b.text_md5 AS new_md5
FROM (SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN ({_SECOND}) b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.text_md5 IS DISTINCT FROM b.text_md5""",
    "feed_replay": _SECOND,
}
