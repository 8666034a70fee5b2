"""Chunks and packages whose bounds depend on all rows before them, without a group in one place.

Where a chunk begins depends on where the one before it ended, which looks sequential. But where the *next* chunk begins
depends on the begin of this one only, so each row has a pointer to the row at which the next chunk would begin if one
began here. Running sums find these pointers. Rows are dealt to blocks of bounded size; in a block, pointers are
followed to where they leave it; what is left are a few pointers a block, and doubling them finds the rows at which the
chunks that begin with the group's first row enter each block. Then every block is cut by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.operators.ordered import running
from engramma.storage import written

#: Tokens (or characters) in a block, as a multiple of what a chunk may hold.
BLOCK = 64
#: Characters of a text whose paragraphs are packed where it stands; longer ones are dealt to blocks.
WHOLE = 1 << 20

#: (sums before each row and at the end, place of the first row, rows and total from it to the group's end, limit, carry) to
#: (row behind the chunk that begins at each row, begin of the next one or -1), counted from the first row.
Rule = Callable[[np.ndarray, int, int, int, int, int], tuple[np.ndarray, np.ndarray]]


def filled(sums: np.ndarray, at: int, left: int, total: int, limit: int, carry: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk goes on until it holds ``limit``; the next begins with the last rows that hold ``carry`` at most. What is left at the end is a chunk."""
    full = total - (sums[:-1] - sums[0]) >= limit
    stop = np.where(full, np.searchsorted(sums, sums[:-1] + limit, "left"), left)
    nxt = np.searchsorted(sums, sums[np.minimum(stop, len(sums) - 1)] - carry, "left")
    return stop, np.where(full & (nxt < left), nxt, -1)


def carried(sums: np.ndarray, at: int, left: int, total: int, limit: int, carry: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk holds ``limit`` at most, but two rows at least; the next begins with its last row."""
    stop = np.maximum(np.searchsorted(sums, sums[:-1] + limit, "right") - 1, np.arange(len(sums) - 1) + 2)
    return np.minimum(stop, left), np.where(stop >= left, -1, stop - 1)


def _in_block(pdf: pd.DataFrame, rule: Rule, limit: int, carry: int) -> tuple[pd.DataFrame, int, np.ndarray, np.ndarray]:
    """A block's rows in order and how many are its own, behind which stand rows that its chunks may reach; for each the row behind its chunk and the next begin, counted from the first."""
    pdf = pdf.sort_values("pos", ignore_index=True)
    before, size = pdf["before"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
    at = int(pdf["pos"].iloc[0])
    stop, nxt = rule(np.append(before, before[-1] + size[-1]), at, int(pdf["n"].iloc[0]) - at, int(pdf["total"].iloc[0]) - int(before[0]), limit, carry)
    return pdf, int((pdf["own"].to_numpy() == pdf["block"].to_numpy()).sum()), stop, nxt


def _bounds(sized: DataFrame, rule: Rule, limit: int, carry: int, block: int) -> DataFrame:
    """(g, chunk_index, first, last) of all chunks of ``sized`` (g, pos, before, size, n, total): positions in the group, both included."""
    size = block * limit
    own = F.floor(F.col("before") / size)
    halo = F.when((own > 0) & (F.col("before") < own * size + 2 * limit), F.array(own - 1, own)).otherwise(F.array(own))
    dealt = sized.withColumn("own", own)
    # numbers are few bytes, calls for a block take long: as many tasks as there are places for
    parts = 4 * sized.sparkSession.sparkContext.defaultParallelism
    blocks = lambda d: d.withColumn("block", F.explode(halo)).repartition(parts, "g", "block")

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own_rows, _, nxt = _in_block(pdf, rule, limit, carry)
        to, steps = nxt[:own_rows].copy(), np.ones(own_rows, np.int64)
        while (go := (to >= 0) & (to < own_rows)).any():
            steps[go] += steps[to[go]]
            to[go] = to[to[go]]
        at = int(pdf["pos"].iloc[0])
        out = pd.DataFrame({"g": pdf["g"].iloc[0], "pos": at + np.arange(own_rows), "to": at + to, "steps": steps})
        return out[to >= 0]

    # groups of one block have their first row as the one entry
    far = dealt.where(F.floor((F.col("total") - 1) / size) > 0)
    left = written(blocks(far).groupBy("g", "block").applyInPandas(leave, "g string, pos long, to long, steps long"), "chunk-pointers")
    reached = left.select("g", F.col("to").alias("pos")).distinct()
    jump = written(left.where("pos = 0").unionByName(left.where("pos > 0").join(reached, ["g", "pos"], "left_semi")), "chunk-jumps")
    entries = written(sized.where("pos = 0").select("g", "pos", F.lit(0).cast("long").alias("index")), "chunk-entries")
    n = -1
    while n != (now := entries.count()):
        n = now
        on = entries.join(jump, ["g", "pos"]).select("g", F.col("to").alias("pos"), (F.col("index") + F.col("steps")).alias("index"))
        entries = written(entries.unionByName(on).distinct(), "chunk-entries")
        b = jump.select("g", F.col("pos").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        jump = written(jump.join(b, ["g", "to"]).select("g", "pos", F.col("to2").alias("to"), (F.col("steps") + F.col("steps2")).alias("steps")), "chunk-jumps")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own_rows, stop, nxt = _in_block(pdf, rule, limit, carry)
        entry = pdf["index"].to_numpy(float)[:own_rows]
        found, first, out = np.flatnonzero(~np.isnan(entry)), int(pdf["pos"].iloc[0]), []
        if len(found):  # chunks enter a block once
            at, index = int(found[0]), int(entry[found[0]])
            while 0 <= at < own_rows:
                out.append((pdf["g"].iloc[0], index, first + at, first + int(stop[at]) - 1))
                at, index = int(nxt[at]), index + 1
        return pd.DataFrame(out, columns=["g", "chunk_index", "first", "last"])

    return blocks(dealt.join(entries, ["g", "pos"], "left")).groupBy("g", "block").applyInPandas(cut, "g string, chunk_index long, first long, last long")


def _joined(bounds: DataFrame, rows: DataFrame, separator: str) -> DataFrame:
    """(g, chunk_index, first, last, text): the texts of each chunk's rows in order; ``rows`` is (g, pos, text)."""
    at = bounds.select("*", F.explode(F.sequence("first", "last")).alias("pos")).join(rows, ["g", "pos"])
    texts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return at.groupBy("g", "chunk_index", "first", "last").agg(F.array_join(F.transform(texts, lambda r: r["text"]), separator).alias("text"))


def budget_chunks(rows: DataFrame, group: str, order: str, text: str, chunk_tokens: int, overlap_tokens: int, separator: str = "\n\n", block: int = BLOCK) -> DataFrame:
    """(group, chunk_index, text, first, last): rows packed until a chunk holds ``chunk_tokens``, the next one beginning with the last rows that hold ``overlap_tokens`` at most.

    A token is four characters. A row of more than ``chunk_tokens`` is a chunk of its own, before and after which
    packing begins anew; what is left at the end, carried rows included, is a chunk. Null and blank texts are left out;
    first and last are the places (from 0, in ``order``) of the group's other rows. A null group is a group; rows of
    equal order take some order among themselves; an empty table gives no chunk.
    """
    if not 0 <= overlap_tokens < chunk_tokens:
        raise ValueError("the overlap must be less than a chunk")
    t = rows.where(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")) != "")
    t = t.select(F.col(group).alias("group"), F.to_json(F.struct(F.col(group).alias("g"))).alias("g0"), F.col(order).alias("o"), F.col(text).alias("text"), F.floor(F.length(text) / 4).alias("tokens"))
    t = t.withColumn("giant", (F.col("tokens") > chunk_tokens).cast("long"))
    # texts are written once and moved when their chunk is known; until then their numbers stand for them
    texts = written(t.withColumn("id", F.monotonically_increasing_id()), "chunk-texts")
    t = written(running(texts.select("id", "g0", "o", "tokens", "giant"), "g0", ["o"], {"segment": "giant"}, "place"), "chunk-rows")
    # between giants rows are packed; a segment is the run behind so many of them
    small = t.where("giant = 0").select("id", "g0", "place", "tokens", F.concat_ws("|", "segment", "g0").alias("g"))
    small = written(running(small, "g", ["place"], {"before": "tokens"}, "pos"), "chunk-sized")
    totals = small.groupBy("g").agg(F.count("*").alias("n"), F.sum("tokens").alias("total"))
    sized = written(small.select("g", "pos", "before", F.col("tokens").alias("size")).join(totals, "g"), "chunk-sums")
    bounds = written(_bounds(sized, filled, chunk_tokens, overlap_tokens, block), "chunk-bounds")
    names = small.where("pos = 0").select("g", "g0", F.col("place").alias("base"))
    place = lambda c: (F.col(c) + F.col("base")).alias(c)
    packed_ = bounds.join(names, "g").select("g0", place("first"), place("last"), F.lit(0).cast("long").alias("giant"))
    giants = t.where("giant = 1").select("g0", F.col("place").alias("first"), F.col("place").alias("last"), "giant")
    both = written(running(packed_.unionByName(giants), "g0", ["first"], {}, "chunk_index"), "chunk-numbers")

    def held(giant: int) -> DataFrame:
        """(id, place, g0, chunk_index, first, last, group, text): the rows of chunks that giants are, or of the others; texts stream past their numbers."""
        at = both.where(F.col("giant") == giant).select("g0", "chunk_index", "first", "last", F.explode(F.sequence("first", "last")).alias("place"))
        at = at.join(t.select("g0", "place", "id"), ["g0", "place"])
        return texts.where(F.col("giant") == giant).select("id", "group", "text").join(at.hint("shuffle_hash"), "id")

    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    joined = held(0).groupBy("g0", "chunk_index", "first", "last").agg(F.first("group").alias("group"), F.array_join(F.transform(parts, lambda r: r["text"]), separator).alias("text"))
    out = joined.drop("g0").unionByName(held(1).select("chunk_index", "first", "last", "group", "text"))
    return out.select(F.col("group").alias(group), F.col("chunk_index").cast("int").alias("chunk_index"), "text", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


def paragraph_chunks(docs: DataFrame, key: str, text: str = "text", chunk_chars: int = 2000, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """(key, chunk_index, text, content_hash): paragraphs packed up to ``chunk_chars``, the next chunk beginning with the last paragraph of the one before.

    Paragraphs are what blank lines part, trimmed, blank ones left out; only their characters count, and a chunk takes a
    second paragraph whatever its size, but for a text's first chunk (the second then begins with the same one). Null and blank texts have no chunk. Keys are
    taken to be distinct; a null key is a text like others. Texts of up to ``whole`` characters are packed where they
    stand, without a shuffle.
    """
    short = F.length(text) <= whole
    out = _packed_whole(docs.where(short), key, text, chunk_chars).unionByName(_packed_blocks(docs.where(~short), key, text, chunk_chars, block))
    return out.select(key, "chunk_index", "text", F.substring(F.sha2(F.encode("text", "utf-8"), 256), 1, 16).alias("content_hash"))


def _paragraphs(text: str) -> Column:
    return F.filter(F.transform(F.split(F.col(text), "\n\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def _packed_whole(docs: DataFrame, key: str, text: str, chunk_chars: int) -> DataFrame:
    """(key, chunk_index, text) of texts that a task packs one by one."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, index, texts = [], [], []
            for i, parts in enumerate(b.column(1)):
                n, held, inside = 0, 0, []
                for p in parts.as_py():
                    if inside and held + len(p) > chunk_chars:
                        at.append(i), index.append(n), texts.append("\n\n".join(inside))
                        n, held, inside = n + 1, len(inside[-1]), inside[-1:]
                    inside.append(p)
                    held += len(p)
                if inside:
                    at.append(i), index.append(n), texts.append("\n\n".join(inside))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(texts, pa.string())], [key, "chunk_index", "text"])

    return docs.select(key, _paragraphs(text).alias("parts")).mapInArrow(chunks, f"`{key}` {docs.schema[key].dataType.simpleString()}, chunk_index int, text string")


def _packed_blocks(docs: DataFrame, key: str, text: str, chunk_chars: int, block: int) -> DataFrame:
    """(key, chunk_index, text) of texts of any length, by running sums and pointers."""
    parts = _paragraphs(text)
    p = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.to_json(F.struct(F.col(key).alias("g"))).alias("g"), F.posexplode(parts).alias("pos", "text"))
    p = p.withColumn("size", F.length("text").cast("long")).withColumn("pos", F.col("pos").cast("long"))
    p = written(running(p, "g", ["pos"], {"before": "size"}, "place").drop("place"), "chunk-paragraphs")
    totals = p.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    bounds = _bounds(written(p.select("g", "pos", "before", "size").join(totals, "g"), "chunk-sums"), carried, chunk_chars, 0, block)
    # where the second paragraph does not fit, the first is a chunk, and the next one begins with it again
    alone = p.where((F.col("pos") == 1) & (F.col("before") + F.col("size") > chunk_chars)).select("g", F.lit(1).cast("long").alias("one"))
    zero = F.lit(0).cast("long")
    bounds = bounds.join(alone, "g", "left").select("g", (F.col("chunk_index") + F.coalesce("one", zero)).alias("chunk_index"), "first", "last")
    bounds = bounds.unionByName(alone.select("g", zero.alias("chunk_index"), zero.alias("first"), zero.alias("last")))
    out = _joined(bounds, p.select("g", "pos", "text"), "\n\n").join(p.where("pos = 0").select("g", "key"), "g")
    return out.select(F.col("key").alias(key), F.col("chunk_index").cast("int").alias("chunk_index"), "text")


def packed(items: DataFrame, group: str, order: str, size: str, budget: int, misses: int = 20) -> DataFrame:
    """(group, place, order, size): the items of each group that a package takes, in order: those that still fit the budget, until more than ``misses`` did not.

    An item with a size is taken, and uses up some of the budget, or is missed; so what becomes of a group shows in its
    first ``budget`` + ``misses`` + 1 items that have a size, however many it has. Of these, a call for each group finds
    the misses, a run between two of them at a time. Sizes are not negative. Null sizes count as 0, items without an
    order come first, a null group is a group.
    """
    name = F.to_json(F.struct(F.col(group).alias("g")))
    t = items.select(F.col(group).alias("group"), name.alias("g"), F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("s"))
    t = t.withColumn("sized", (F.col("s") > 0).cast("long"))
    t = written(running(t, "g", ["o"], {"nth": "sized"}, "pos"), "package-items")

    def missed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, sums = pdf["pos"].to_numpy(np.int64), np.append(0, np.cumsum(pdf["s"].to_numpy(np.int64)))
        at, used, out = 0, 0, []
        while len(out) <= misses:
            # the first item from ``at`` on with which the run no longer fits
            over = int(np.searchsorted(sums, sums[at] + budget - used, "right")) - 1
            if over >= len(pos):
                break
            used += int(sums[over] - sums[at])
            out.append(int(pos[over]))
            at = over + 1
        stop = out[misses] if len(out) > misses else None
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "misses": [out], "stop": pd.array([stop], "Int64")})

    known = t.where((F.col("s") > 0) & (F.col("nth") <= budget + misses)).select("g", "pos", "s")
    cut = known.groupBy("g").applyInPandas(missed, "g string, misses array<long>, stop long")
    j = t.join(cut, "g", "left").withColumn("misses", F.coalesce("misses", F.array().cast("array<long>")))
    j = j.where((F.col("stop").isNull() | (F.col("pos") < F.col("stop"))) & ~F.array_contains("misses", F.col("pos")))
    place = F.col("pos") - F.size(F.filter("misses", lambda m: m < F.col("pos")))
    return j.select(F.col("group").alias(group), place.cast("int").alias("place"), F.col("o").alias(order), F.col("s").alias(size))
