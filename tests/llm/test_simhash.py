"""SimHash near-duplicates against plain Python."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from engramma.llm import simhash


def plain_print(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    """(id, print) to the smallest id of each print's component."""
    prints = sorted({p for i, p in rows if i is not None})
    low = {p: min(i for i, q in rows if q == p and i is not None) for p in prints}
    links = [(p, q) for p, q in itertools.combinations(prints, 2) if (p ^ q).bit_count() <= 2]
    moved = True
    while moved:
        moved = False
        for p, q in links:
            m = min(low[p], low[q])
            if low[p] != m or low[q] != m:
                low[p] = low[q] = m
                moved = True
    return low


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, id string, component string")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df, **kw).collect()), key=str)
    prints = [(r[0], plain_print(r[1])) for r in rows]
    low = plain_components(prints)
    assert got == sorted(((i, f"{p:016x}", None if i is None else low[p]) for i, p in prints), key=str)
    return got


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(400)]
    rows = []
    for k in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        for _ in range(4):
            edited = list(words)
            if len(edited) > 100:
                edited[rng.randrange(len(edited))] = "changed"
            rows.append((len(rows) + 10, rng.choice([" ", "\n", "  \t"]).join(edited)))
    rows += [(3, None), (4, ""), (5, " \n\t"), (None, "null id"), (None, None), (6, "A b"), (6, "a B"), (7, "same id"), (7, "other text of it"), (8, "x " * 150_000)]
    return [(*r, "clash", "clash", "clash") for r in rows]


@pytest.mark.parametrize("limit", [simhash.LIMIT, 1])
def test_equals_plain_python(spark, limit):
    got = check(spark, fixture(), limit=limit)
    assert {c for i, _, c in got if i in (3, 4, 5)} == {3}
    assert len({c for i, _, c in got}) < len({p for _, p, _ in got})


def test_table_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    prints = [(i, plain_print(t)) for i, t in rows]
    low = plain_components(prints)
    assert got == sorted((i, f"{p:016x}", low[p]) for i, p in prints)


@pytest.mark.parametrize("limit", [simhash.LIMIT, 2])
def test_every_link_of_crowded_prints_is_found(spark, limit):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:40]:
        for _ in range(12):
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
            prints.add(p ^ (1 << rng.randrange(64)))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s, k) for k, s in enumerate(signed)], "fp long, rep long")
    label = {k: k for k in range(len(prints))}
    edges = [(r["a"], r["b"]) for r in simhash.links(df, limit).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 64 for a, b in edges)
    for _ in range(len(prints)):
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    low = plain_components([(k, p) for k, p in enumerate(prints)])
    assert [label[k] for k in range(len(prints))] == [low[p] for p in prints]


def test_pivots_never_discard_a_link_and_bound_the_rest():
    rng = np.random.RandomState(3)
    x = rng.randint(0, 2**63, 500, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for flips in (0, 1, 2, 5, 6, 20):
        y = x.copy()
        for k in range(len(x)):
            for b in rng.choice(64, flips, replace=False):
                y[k] ^= np.uint64(1 << int(b))
        most = np.abs(simhash.distance_table(x) - simhash.distance_table(y)).max(1)
        assert (most <= 2).all() if flips <= 2 else (most > 2).all()
        if flips <= 2:
            assert (simhash.table_keys(simhash.distance_table(x)) == simhash.table_keys(simhash.distance_table(y))).any(1).all()


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
