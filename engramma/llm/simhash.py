"""SimHash near-duplicates found with pivot distance tables.

A fingerprint has 64 bits; two link if at most two differ. Every fingerprint gets a row of Hamming distances to fixed
reference fingerprints (pivots). By the triangle inequality the coordinates of two that link differ by 2 at most, so a
pair with a larger coordinate difference is discarded without a look at the fingerprints; the others are verified.

The pivots are chosen so that the table can also say which pairs to look at. Pivot 0 is zero, the next 32 have one pair
of neighbouring bits each: distances to zero and to a pair's pivot tell how many bits of that pair are set. The 32
counts are dealt into five groups. Two changed bits touch two groups at most, so fingerprints that link agree in the
counts of three groups: they meet in one of ten keys of some 27 bits. The last 63 pivots are Walsh words: the squares of
the 64 coordinate differences they give (with zero) add up to 64 times the number of different bits, so pairs that the
whole table lets pass differ in four bits at most.

A key that more than ``limit`` fingerprints share is not compared pair by pair. Two fingerprints link if and only if
both are within one bit of some third word; those of such keys are grouped by all words within one bit of them, at most
65 to a word, whatever the number of fingerprints. So no group is quadratic in its size and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramma.llm.bytekit import ASCII_LOWER, NOT_SPACE, U, buffers, frugal, pieces, spans
from engramma.llm.components import components
from engramma.storage import written

SEED = 42
#: Shingles whose bits are spread out at a time, 64 bytes each.
SPREAD = 100_000
#: Fingerprints of a key up to which its pairs are compared.
LIMIT = 512
#: Keys shared by too many that may be broadcast, 8 bytes each.
BROADCAST_KEYS = 1_000_000
PAIRS = 32
GROUPS = [list(range(g, PAIRS, 5)) for g in range(5)]
KEYS = [sorted(GROUPS[a] + GROUPS[b] + GROUPS[c]) for a, b, c in combinations(range(5), 3)]


def _pivots() -> np.ndarray:
    bits = np.arange(64)
    walsh = [sum(1 << int(b) for b in bits if bin(i & int(b)).count("1") % 2) for i in range(1, 64)]
    return np.array([0, *(3 << 2 * p for p in range(PAIRS)), *walsh], U)


PIVOTS = _pivots()


def distance_table(prints: np.ndarray) -> np.ndarray:
    """A row of distances to all pivots for each fingerprint."""
    return np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def table_keys(table: np.ndarray) -> np.ndarray:
    """The ten keys of each row of a distance table: which groups, and how many bits of their pairs are set."""
    held = (table[:, :1].astype(np.int64) - table[:, 1 : PAIRS + 1] + 2) // 2
    return np.stack([k * 3**21 + held[:, cols] @ 3 ** np.arange(len(cols), dtype=np.int64) for k, cols in enumerate(KEYS)], 1)


def text_prints(texts: pa.Array, n: int = 3) -> np.ndarray:
    """The fingerprint of each text: A-Z lower-cased, words ended by ASCII white space, all shingles of ``n`` words, repeats included."""
    data, offs = buffers(texts)
    out = np.zeros(len(offs) - 1, U)
    for a, b in pieces(offs):
        d = ASCII_LOWER[data[offs[a] : offs[b]]]
        starts, ends, first = spans(d, offs[a : b + 1] - offs[a], NOT_SPACE)
        if not len(starts):
            continue
        # words of a text one space apart: the byte after a word that another follows stays as that space
        keep = NOT_SPACE[d]
        more = np.ones(len(starts), bool)
        more[first[1:][np.diff(first) > 0] - 1] = False
        d[ends[more]] = 32
        keep[ends[more]] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        joined, starts, ends = d[keep].tobytes(), at[starts], at[ends]
        words = np.diff(first)
        count = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
        row = np.repeat(np.arange(b - a), count)
        begin = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        last = np.minimum(begin + n, first[1:][row]) - 1
        hashed = xxhash.xxh64_intdigest
        h = np.fromiter((hashed(joined[x:y], SEED) for x, y in zip(starts[begin].tolist(), ends[last].tolist(), strict=True)), U, len(begin))
        ones = np.zeros((b - a, 64), np.int64)
        for k in range(0, len(h), SPREAD):
            bits = np.unpackbits(h[k : k + SPREAD].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r = row[k : k + SPREAD]
            head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            ones[r[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int64)
        out[a:b] = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, the 64 bits as a long. Null and empty texts, and those of white space only, have zero."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text_prints(b.column(1), n).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, fp bigint")


def _keyed(prints: DataFrame) -> DataFrame:
    """(key, fp, rep): each fingerprint under its ten keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = table_keys(distance_table(b.column(0).to_numpy(zero_copy_only=False).view(U)))
            of = pa.array(np.repeat(np.arange(len(keys)), len(KEYS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column(0).take(of), b.column(1).take(of)], ["key", "fp", "rep"])

    return prints.select("fp", "rep").mapInArrow(run, "key bigint, fp bigint, rep bigint")


def match_runs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of the pairs with equal keys, sorted by them, that pass the pivots and differ in two bits at most."""
    table = distance_table(fp)
    found = []
    at = np.arange(len(key))
    j = 1
    while len(at := at[at + j < len(key)]) and len(at := at[key[at] == key[at + j]]):
        # pairs that stand j apart; a row whose run has ended stays out
        near = at[np.abs(table[at, 0] - table[at + j, 0]) <= 2]
        near = near[np.abs(table[near] - table[near + j]).max(1) <= 2]
        near = near[np.bitwise_count(fp[near] ^ fp[near + j]) <= 2]
        found.append((near, near + j))
        j += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same components as (a, b), one a vertex: each with its component's smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(ids))
    return ids[label[other]], ids[other]


def _matched(keyed: DataFrame) -> DataFrame:
    """(a, b): links among the fingerprints of each key, by their representatives; the same components, an edge a vertex and batch."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            key, fp, rep = (np.concatenate([r.column(c).to_numpy(zero_copy_only=False) for r in rows]) for c in range(3))
            a, b = match_runs(key, fp.view(U))
            a, b = _stars(rep[a], rep[b])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(key, key[-1]))  # the last key's run may go on in the next batch
            if cut or (held and held[-1].column(0)[0].as_py() != key[0]):
                yield edges([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield edges(held)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def _through_words(prints: DataFrame) -> DataFrame:
    """(a, b): links among ``prints`` by the words within one bit of both."""
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")) for i in range(64)))
    groups = prints.select("rep", F.explode(near).alias("word")).groupBy("word").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("bs"))
    return groups.where(F.size("bs") > 1).select("a", F.explode("bs").alias("b")).where("a <> b").distinct()


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): edges between representatives whose components are those of all pairs of ``prints`` (fp, rep) at two bits or fewer."""
    keyed = _keyed(prints)
    hot = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("key"), "simhash-hot")
    n_hot = hot.count()
    if not n_hot:
        return _matched(keyed)
    hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    crowded = keyed.join(hot, "key", "left_semi").select("fp", "rep").distinct()
    return _matched(keyed.join(hot, "key", "left_anti")).unionByName(_through_words(crowded))


def near_duplicates(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row.

    component_id is the smallest id reachable by links of two bits or fewer, a row's own included. Null and empty texts
    have fingerprint zero and link like any other. Rows that repeat an id have each their own fingerprint; one id in two
    components does not join them. A null id links with nothing and has a null component. An empty table gives no row;
    other columns are not read.
    """
    rows = written(fingerprints(docs, n, id_col, text_col), "simhash-rows")
    prints = written(rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-prints")
    found = components(links(prints, limit), "simhash").select(F.col("id").alias("rep"), "component")
    of = written(prints.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component")), "simhash-components")
    out = rows.join(of, "fp", "left")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
