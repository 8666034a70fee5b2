"""Ranked lexical search against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from engramma.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, k=10):
    vec = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(vec), sum(sum(v.values()) for _, v in vec)
    df = Counter(t for _, v in vec for t in v)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for d, v in vec:
            m = 10 + (90 * sum(v.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * v[t]) // (1000 * v[t] + 8 * m)) for t in ts if t in v)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, score string, item_id int").repartition(3)
    i = spark.createDataFrame([(*x, "clash", 1) for x in items], "item_id long, text string, rank string, doc_id int")
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(d, i, **kw).collect()), key=str)


def fixture(n=400):
    rng = random.Random(8)
    vocabulary = [("É" if k % 6 == 0 else "T") + f"erm{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    text = lambda m: " ".join(rng.choices(vocabulary, weights, k=m)) + rng.choice(["", "!", " x-y", "\n"])
    docs = [(k, text(rng.choice([1, 5, 30, 200]))) for k in range(n)]
    docs += [(7, docs[3][1]), (n, docs[3][1]), (None, docs[3][1]), (n + 1, None), (n + 2, ""), (n + 3, "--- !!"), (n + 4, (vocabulary[5] + " ") * 50_000)]
    docs += [(n + 10 + k, "one same text of many copies term7 term9") for k in range(100)]
    items = [(k, text(rng.choice([1, 3, 12, 40]))) for k in range(25)] + [(100, None), (101, "..."), (102, "nowhere"), (103, "SAME copies"), (3, "terms of an item whose id repeats term7"), (None, "term1 term2")]
    return docs, items


@pytest.mark.parametrize("kw", [{}, {"sample_docs": 50}, {"k": 3, "pass_terms": 40}])
def test_equals_plain_python(spark, kw):
    docs, items = fixture()
    assert found(spark, docs, items, **kw) == plain(docs, items, kw.get("k", 10))


def test_weights_that_are_nothing(spark):
    docs = [(k, "all") for k in range(3)] + [(9, "all rare")]
    assert found(spark, docs, [(1, "all"), (2, "rare"), (3, "missing")]) == plain(docs, [(1, "all"), (2, "rare"), (3, "missing")])
    assert found(spark, [], [(1, "all")]) == [] == found(spark, docs, [])


def test_bounds_hold_in_every_subtree():
    rng = np.random.RandomState(1)
    size = rng.randint(0, 12, 500)
    terms_ = np.concatenate([np.sort(rng.choice(40, s, replace=False)) for s in size]) if size.sum() else np.zeros(0, int)
    tree = lexical.Tree(pa.array(np.arange(500)), rng.randint(10, 300, 500), np.concatenate([[0], np.cumsum(size)]), terms_, rng.randint(1, 9, len(terms_)), rng.permutation(40))
    nodes, seen = [tree.root], 0
    while nodes:
        n = nodes.pop()
        nodes += n.children
        seen += not n.children and n.hi - n.lo
        assert not n.children or [c.lo for c in n.children] == [n.lo, *(c.hi for c in n.children[:-1])] and n.children[-1].hi == n.hi
        x, y = tree.first[n.lo], tree.first[n.hi]
        assert n.m == tree.m[n.lo : n.hi].min()
        assert dict(zip(n.terms.tolist(), n.most.tolist(), strict=True)) == {int(t): int(tree.tfs[x:y][tree.terms[x:y] == t].max()) for t in tree.terms[x:y]}
    assert seen == 500 and tree.root.children


def test_nested_term_sets_make_a_flat_tree():
    n = 3000
    first = np.concatenate([[0], np.cumsum(np.arange(n) % 900)])
    terms_ = np.concatenate([np.arange(k % 900) for k in range(n)])
    tree = lexical.Tree(pa.array(np.arange(n)), np.full(n, 10), first, terms_, np.ones(len(terms_), np.int64), np.arange(900))
    nodes, leaves = [tree.root], []
    while nodes:
        node = nodes.pop()
        nodes += node.children
        leaves += [] if node.children else [(node.lo, node.hi)]
    assert sorted(leaves)[0][0] == 0 and sum(y - x for x, y in leaves) == n and len(leaves) < 300
