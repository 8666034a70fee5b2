"""Several tables changed as one: snapshots, optimistic commits, row-level change feeds, retention.

A store is a folder. Each change of a table is written whole into a folder of its own, which nobody reads until a commit
record names it; a record lists the folder of every table, so a reader who takes one record sees all tables of one
moment. Records are numbered and put in place by a rename that fails if the number is taken (file systems where a rename
is not one step, such as plain object stores, need a locking layer). A writer who dies before that leaves the old state
and some folders that ``expire`` clears away.

A writer states the snapshot that it has read. If a table that it reads or writes was changed since, the commit fails
and the work is done again on the new state; changes of other tables do not disturb it.

Keyed tables keep, with each version, the rows that it inserted, updated or deleted. The feed between two versions, laid
over the first, gives the second, in whatever order its rows come.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.operators.tables import _whole


class Conflict(Exception):
    """A table that a commit reads or writes has changed since its snapshot."""


@dataclass(frozen=True)
class Snapshot:
    """One moment of a store: the folder of every table, and of every change feed that is kept."""

    version: int
    tables: Mapping[str, str]
    keys: Mapping[str, tuple[str, ...]]
    feeds: Mapping[str, str]


def row_changes(old: DataFrame, new: DataFrame, keys: Iterable[str]) -> DataFrame:
    """(change, before, after): a row for each key that is in one table only or has another row there; before and after are whole rows.

    Keys are unique in both tables; null keys are keys. Equal rows give nothing. Both have the columns of ``new``.
    """
    keys = list(keys)
    a = old.select(*(F.col(f"`{k}`").alias(f"__a{i}") for i, k in enumerate(keys)), _whole(old.select(*(F.col(f"`{c}`") for c in new.columns))).alias("before"))
    b = new.select(*(F.col(f"`{k}`").alias(f"__b{i}") for i, k in enumerate(keys)), _whole(new).alias("after"))
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}"))
    j = a.join(b, on, "full").where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return j.select(change.alias("change"), "before", "after")


def replayed(table: DataFrame, feed: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``table`` after the changes of ``feed`` (version, change, before, after): of a key's changes that of the highest version counts."""
    keys = list(keys)
    names = [f"__k{i}" for i in range(len(keys))]
    row = F.coalesce("after", "before")
    last = feed.select(*(row.getField(k).alias(n) for k, n in zip(keys, names, strict=True)), "version", "after").groupBy(*names).agg(F.max_by("after", "version").alias("after"), F.lit(True).alias("__touched"))
    on = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(f"__t.{k}").eqNullSafe(F.col(n))
    j = table.select(*(F.col(f"`{k}`").alias(f"__o{i}") for i, k in enumerate(keys)), _whole(table).alias("__t"), F.lit(True).alias("__here")).join(last, on, "full")
    kept = F.when(F.col("__touched"), F.col("after")).otherwise(F.col("__t"))
    return j.select(kept.alias("__r")).where("__r is not null").select("__r.*")


class Store:
    """Tables in a folder of a file system that Spark knows, changed together."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs_of = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._fs_of.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        log = self._path("_commits")
        names = [s.getPath().getName() for s in self._fs().listStatus(log)] if self._fs().exists(log) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last state, or that of a version that is kept."""
        if version is None:
            version = max(self._numbers(), default=0)
        if version == 0:
            return Snapshot(0, {}, {}, {})
        path = self._path("_commits", f"{version:012d}.json")
        if not self._fs().exists(path):
            raise ValueError(f"version {version} of {self.folder} is not kept")
        text = self.spark.read.text(path.toString(), wholetext=True).first()[0]
        r = json.loads(text)
        return Snapshot(version, r["tables"], {k: tuple(v) for k, v in r["keys"].items()}, r["feeds"])

    def read(self, table: str, at: Snapshot | None = None) -> DataFrame:
        """A table as of a snapshot. Tables read from one snapshot belong together."""
        return self.spark.read.parquet(f"{self.folder}/{(at or self.snapshot()).tables[table]}")

    def _put(self, name: str, text: str) -> bool:
        """Whether the file was put in place; not if the name is taken."""
        fs = self._fs()
        draft, final = self._path("_commits", f"draft-{uuid.uuid4().hex}"), self._path("_commits", name)
        out = fs.create(draft, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        context = self._fs_of.FileContext.getFileContext(final.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._fs_of.Options.Rename, 1)
        none[0] = self._fs_of.Options.Rename.NONE
        try:
            context.rename(draft, final, none)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                return False
            raise e
        return True

    def commit(self, writes: Mapping[str, DataFrame], base: Snapshot, reads: Iterable[str] = (), keys: Mapping[str, Iterable[str]] | None = None) -> Snapshot:
        """All of ``writes`` (table: its new content) as one change made from ``base``; ``reads`` are other tables it rests on.

        ``keys`` names the key columns of tables that are to have a change feed; a table keeps them. Raises Conflict if
        one of the tables differs from ``base`` by now; nothing is changed then.
        """
        known = {**base.keys, **{t: tuple(k) for t, k in (keys or {}).items()}}
        made, feeds = {}, {}
        for name, df in writes.items():
            made[name] = f"{name}/data-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{made[name]}")
            if name in known:
                new = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{made[name]}")
                old = self.read(name, base) if name in base.tables else new.limit(0)
                feeds[name] = f"{name}/feed-{uuid.uuid4().hex}"
                row_changes(old, new, known[name]).write.parquet(f"{self.folder}/{feeds[name]}")
        while True:
            now = self.snapshot()
            for t in {*writes, *reads}:
                if now.tables.get(t) != base.tables.get(t):
                    raise Conflict(f"{t} changed from version {base.version} to {now.version}")
            record = {"tables": {**now.tables, **made}, "keys": {**now.keys, **{t: known[t] for t in writes if t in known}}, "feeds": feeds, "at": time.time()}
            if self._put(f"{now.version + 1:012d}.json", json.dumps(record)):
                return self.snapshot(now.version + 1)

    def change(self, work: Callable[[Snapshot], Mapping[str, DataFrame]], reads: Iterable[str] = (), keys: Mapping[str, Iterable[str]] | None = None, attempts: int = 5) -> Snapshot:
        """``work`` on the last snapshot, committed; done again on the new state after a conflict."""
        for left in reversed(range(attempts)):
            base = self.snapshot()
            try:
                return self.commit(work(base), base, reads, keys)
            except Conflict:
                if not left:
                    raise
        raise ValueError("no attempts")

    def feed(self, table: str, after: int, upto: int | None = None) -> DataFrame:
        """(version, change, before, after) of a keyed table's changes behind one version, up to another (the last)."""
        upto = self.snapshot().version if upto is None else upto
        out = None
        for v in range(after + 1, upto + 1):
            at = self.snapshot(v).feeds.get(table)
            if at:
                part = self.spark.read.parquet(f"{self.folder}/{at}").select(F.lit(v).cast("long").alias("version"), "change", "before", "after")
                out = part if out is None else out.unionByName(part)
        if out is None:
            row = self.read(table, self.snapshot(upto)).schema.simpleString()
            out = self.spark.createDataFrame([], f"version bigint, change string, before {row}, after {row}")
        return out

    def expire(self, keep: int, grace_seconds: float = 86_400) -> int:
        """Forgets all versions but the last ``keep``, and deletes folders that no kept version names and that are older than the grace for work under way; their number."""
        numbers = self._numbers()
        fs = self._fs()
        for n in numbers[: max(0, len(numbers) - keep)]:
            fs.delete(self._path("_commits", f"{n:012d}.json"), False)
        named = set()
        for n in numbers[max(0, len(numbers) - keep) :]:
            s = self.snapshot(n)
            named |= {*s.tables.values(), *s.feeds.values()}
        gone, before = 0, (time.time() - grace_seconds) * 1000
        for t in fs.listStatus(self._path()):
            name = t.getPath().getName()
            if not name.startswith("_") and t.isDirectory():
                for f in fs.listStatus(t.getPath()):
                    if f"{name}/{f.getPath().getName()}" not in named and f.getModificationTime() < before:
                        gone += fs.delete(f.getPath(), True)
        return gone
