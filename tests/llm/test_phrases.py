"""Collocations over a prefix-free parse, against plain Python."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from compare import same
from engramma.llm import phrases, q_rank


def pieces(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", x) for x in re.split(r"[.,;:!?\x0A-\x0D]", t)]


def plain(rows, least, inside=80, keep=2000):
    out = []
    for lang in {lang or "und" for lang, _ in rows}:
        f, n = Counter(), 0
        for x, t in rows:
            if (x or "und") == lang:
                for ws in pieces(t):
                    n += len(ws)
                    f.update(tuple(ws[i : i + k]) for k in range(1, 5) for i in range(len(ws) - k + 1))
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        over = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    over[p[i : i + m]] = max(over[p[i : i + m]], a)
        found = []
        for p, a in cand.items():
            if 100 * over[p] < inside * a or p not in over:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(found[:keep])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def fixture():
    rng = random.Random(4)
    ws = ["é%d" % k if k % 5 == 0 else "Wd%d" % k for k in range(12)]
    rows = []
    for _ in range(60):
        t = "".join(rng.choice(ws) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "."]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "fr", None, "und"]), t))
    passage = "a long passage that many documents share word for word without any stop until its very end is reached here"
    rows += [("en", passage + " " + rng.choice(ws)) for _ in range(40)] + [("fr", None), ("xx", ""), ("en", "repeat " * 30_000), (None, " \t . ,")]
    rows += [(x, f"{x} as a word {x} and {y}") for x in ("en", "fr") for y in ("en", "fr")]
    return rows


@pytest.mark.parametrize("least,trigger", [(2, phrases.TRIGGER), (30, 2), (7, 1), (3, 10**9)])
def test_equals_plain_python(spark, least, trigger):
    rows = fixture()
    df = spark.createDataFrame([(k if k % 9 else None, lang, t, "x", "y") for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n string")
    assert rows_of(phrases.collocations(df.repartition(3), least=least, trigger=trigger)) == plain(rows, least)


def test_few_kept_and_a_full_bitmap(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(phrases.collocations(df, least=5, keep=7, bitmap_bits=6)) == plain(rows, 5, keep=7)


def test_chunks_overlap_and_own_each_word_once():
    text = "one two three four five six seven. eight nine\tten"
    for trigger in (1, 2, 3, 100):
        got = [(c.decode().split(), n) for _, chunk, core in phrases.text_chunks(pa.array([text]), trigger) for c, n in zip(chunk, core, strict=True)]
        assert [w for ws, n in got for w in ws[:n]] == text.replace(".", "").split()
        assert all(len(ws) - n <= 3 for ws, n in got)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


@pytest.mark.parametrize("name", sorted(q_rank.SQL))
def test_query_equals_its_sql(name, spark, sf, duck):
    same(q_rank.QUERIES[name](spark, sf), duck.sql(q_rank.SQL[name]))
