"""Commits over several tables, their conflicts, and change feeds."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from engramma.operators.commits import Conflict, Store, replayed, row_changes
from engramma.storage import new_path


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string")


def test_a_commit_shows_all_tables_or_none(spark, monkeypatch):
    s = Store(spark, new_path(spark, "store"))
    first = s.commit({"tiles": table(spark, [(1, "a")]), "graph": table(spark, [(1, "x")])}, s.snapshot())
    # a writer that dies after its first table
    with pytest.raises(ZeroDivisionError):
        s.commit({"tiles": table(spark, [(2, "b")]), "graph": Dying()}, first)
    assert s.snapshot() == first and rows(s.read("tiles")) == [(1, "a")] and rows(s.read("graph")) == [(1, "x")]
    # one that dies just before its record
    monkeypatch.setattr(Store, "_put", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        s.commit({"tiles": table(spark, [(2, "b")])}, first)
    monkeypatch.undo()
    assert s.snapshot() == first
    second = s.commit({"tiles": table(spark, [(2, "b")])}, first)
    assert rows(s.read("tiles", first)) == [(1, "a")] and rows(s.read("tiles")) == [(2, "b")] and rows(s.read("graph", second)) == [(1, "x")]
    assert s.expire(keep=1, grace_seconds=-60) >= 3  # what the dead left, and the first tiles
    assert rows(s.read("tiles")) == [(2, "b")] and rows(s.read("graph")) == [(1, "x")]
    with pytest.raises(ValueError):
        s.snapshot(1)


class Dying:
    schema = None

    @property
    def write(self):
        return 1 / 0


def test_of_two_writers_that_conflict_one_tries_again(spark):
    s = Store(spark, new_path(spark, "store"))
    base = s.commit({"a": table(spark, [(0, "0")]), "b": table(spark, [(0, "0")])}, s.snapshot())
    s.commit({"a": table(spark, [(1, "1")])}, base)
    with pytest.raises(Conflict):
        s.commit({"a": table(spark, [(2, "2")])}, base)
    with pytest.raises(Conflict):
        s.commit({"b": table(spark, [(2, "2")])}, base, reads=["a"])
    s.commit({"b": table(spark, [(3, "3")])}, base)  # another table: no conflict
    assert rows(s.read("a")) == [(1, "1")] and rows(s.read("b")) == [(3, "3")]
    tries = []

    def add(who):
        def work(at):
            tries.append(who)
            return {"a": s.read("a", at).unionByName(table(spark, [(who, "added")]))}

        s.change(work, attempts=20)

    threads = [threading.Thread(target=add, args=(k,)) for k in (10, 11, 12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [r[0] for r in rows(s.read("a"))] == [1, 10, 11, 12] and len(tries) >= 3


def test_feeds_replay_whatever_their_order(spark):
    rng = random.Random(1)
    s = Store(spark, new_path(spark, "store"))
    state, versions = {None: "null key", 1: "one", 2: None}, []
    for _ in range(4):
        df = table(spark, list(state.items()))
        versions.append((s.change(lambda _, df=df: {"t": df}, keys={"t": ["k"]}).version, dict(state)))
        state = {k: (v if rng.random() < 0.6 else f"new{rng.random()}") for k, v in state.items() if rng.random() < 0.8} | {rng.randrange(5, 30): "added" for _ in range(4)}
    for i, (v, old) in enumerate(versions):
        for w, new in versions[i:]:
            feed = s.feed("t", v, w)
            shuffled = feed.orderBy(F.rand(7)).repartition(3)
            assert rows(replayed(s.read("t", s.snapshot(v)), shuffled, ["k"])) == rows(table(spark, list(new.items()))) == rows(s.read("t", s.snapshot(w)))
            if w == v + 1:
                want = {("insert", k) for k in new if k not in old} | {("delete", k) for k in old if k not in new} | {("update", k) for k in new if k in old and new[k] != old[k]}
                assert {(r["change"], (r["after"] or r["before"])["k"]) for r in feed.collect()} == want
    s.expire(keep=2, grace_seconds=-60)
    with pytest.raises(ValueError):
        s.feed("t", 0)
    assert s.feed("t", versions[-2][0]).count() > 0


def test_equal_tables_have_no_changes(spark):
    t = table(spark, [(1, None), (None, "x")])
    assert row_changes(t, t, ["k"]).count() == 0 and row_changes(t.limit(0), t, ["k"]).count() == 2
