from itertools import combinations

import numpy as np
import pytest

from engramma.llm import near_dup, tokens
from engramma.llm.q_text import tokenizer_path


def test_no_marks_before_the_hash_is_full():
    for n in range(tokens.ROLL + 1):
        assert len(tokens.cut_marks(np.arange(n, dtype=np.int64))) == 0


@pytest.mark.parametrize("text", ["", "word"])
def test_few_short_documents_in_a_partition(text, spark):
    for n in range(1, 9):
        rows = spark.createDataFrame([(i, text) for i in range(n)], "doc_id long, text string").coalesce(1)
        assert [len(r["addresses"]) for r in tokens.encode_documents(rows, tokenizer_path()).collect()] == [1] * n


def test_store_of_five_empty_documents(spark):
    rows = spark.createDataFrame([(i, "") for i in range(5)], "doc_id long, text string").coalesce(1)
    folder = tokens.write_store(rows, tokenizer_path())
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in tokens.read_digests(spark, folder).orderBy("doc_id").collect()] == [(i, i, 1) for i in range(5)]
    assert tokens.verify_manifest(spark, folder).count() == 0


def test_keep_first_keeps_one_of_repeated_rows(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, a, "x")] * 5 + [(1, a, "w"), (2, a, "x"), (3, b, "y"), (3, b, "y"), (4, "", "z"), (4, "", "z"), (5, "zz other words of another text", "m"), (5, "aa entirely different words here again", "n"), (None, a, "k"), (None, a, "k"), (6, b, "y")]
    got = near_dup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["source"]) for r in got) == sorted([(0, a, "k"), (0, a, "k"), (1, a, "w"), (3, b, "y"), (4, "", "z"), (5, "aa entirely different words here again", "n")])


def test_similar_pairs_are_the_whole_join(spark):
    words = [f"w{i}" for i in range(60)]
    texts = {k: " ".join(words[: 60 - k] + [f"x{k}_{j}" for j in range(k % 3)]) for k in range(24)} | {100 + k: " ".join(f"v{k}_{j}" for j in range(20)) for k in range(5)} | {50: " ".join(words)}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in texts.items()}
    want = {(a, b) for (a, x), (b, y) in combinations(sorted(sets.items()), 2) if 100 * len(x & y) >= 75 * len(x | y) and 50 not in (a, b)}  # 50 is a copy of 0
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = [(r["a"], r["b"]) for r in near_dup.similar_pairs(docs).collect()]
    assert len(got) == len(want) and set(got) == want
