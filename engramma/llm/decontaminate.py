"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows become a small table of n-grams and their hashes, broadcast when its measured size allows.
Every window has a key word, the one that the fewest windows hold; a text can only match a window where it holds its key
word, so only places around key words are tried, and none is missed. Each text is cut into words once; its windows at
those places, of every length that the benchmark has, come out of one array expression, a row each of place and n-gram
and nothing else, so the work is linear in a text's length. Those whose hash meets a benchmark hash are compared whole.
Only the hits and one marker row per document are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramma.storage import written

#: Word bytes are digits, letters a-z after lower-casing and everything outside ASCII.
_UPPER = "".join(map(chr, range(65, 91)))
_BREAKS = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows that may be broadcast: at about 200 bytes each, 100 MB at most. Beyond it the windows are joined by shuffle.
BROADCAST_WINDOWS = 500_000
#: Key words that may be part of the plan; with more of them every place is tried.
KEY_WORDS = 20_000


def fold_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    t = F.translate(F.coalesce(text, F.lit("")), _BREAKS + _UPPER, " " * len(_BREAKS) + _UPPER.lower())
    return F.array_remove(F.split(t, " "), "")


def benchmark_windows(benchmark: DataFrame, n: int = 10, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Distinct windows as (len, hash, window, items). An item of fewer than ``n`` words, but not none, is one window."""
    w = benchmark.select(F.col(item_id).alias("item"), fold_words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    w = w.select("item", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    w = w.select("item", "len", F.array_join(F.slice("w", F.col("i"), F.col("len")), " ").alias("window"))  # words hold no blank
    return w.groupBy("len", "window").agg(F.collect_set(F.col("item").cast("string")).alias("items")).withColumn("hash", F.xxhash64("window"))


def key_words(windows: DataFrame) -> DataFrame:
    """(word): for every window the word that the fewest windows hold, of those the longest."""
    words = windows.select("window", F.explode(F.array_distinct(F.split("window", " "))).alias("word"))
    held = words.groupBy("word").agg(F.count("*").alias("n"))
    return words.join(held, "word").groupBy("window").agg(F.min_by("word", F.struct("n", -F.length("word"), "word")).alias("word")).select("word").distinct()


def _windows(size: int, keyed: bool) -> Column:
    """array<struct<p, k, window>>: windows of ``size`` of the words ``w``, by their place from 1; if ``keyed`` those that hold a place in ``at``."""
    n = F.size("w")
    places = F.sequence(F.lit(1), n - size + 1)
    if keyed:
        places = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(F.greatest(F.lit(1), i - size + 1), F.least(i, n - size + 1)))))
    places = F.when(n >= size, places).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("p"), F.lit(size).alias("k"), F.array_join(F.slice("w", i, size), " ").alias("window")))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, most_keys: int = KEY_WORDS) -> DataFrame:
    """One row per input row: the id, its number of words, the covered word positions (from 1), and the items hit.

    Null text has no words; rows that repeat an id are judged one by one; an empty benchmark hits nothing; items that
    repeat a text are all named; texts of any length are read whole; extra columns of ``docs`` are not read, whatever
    their names; an empty table gives no rows.
    """
    windows = written(benchmark_windows(benchmark, n, item_id, item_text), "benchmark-windows")
    sizes = {r["len"]: r["count"] for r in windows.groupBy("len").count().collect()}  # at most n rows
    known = windows.select(F.col("len").alias("k"), "hash", "window", "items")
    known = F.broadcast(known) if sum(sizes.values()) <= broadcast_windows else known
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), fold_words(F.col(text_col)).alias("w"))
    # the marker, at place 0, keeps documents without hits
    every = [F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("k"), F.lit("").alias("window")))]
    keys = [r["word"] for r in key_words(windows).limit(most_keys + 1).collect()]
    keyed = len(keys) <= most_keys
    if keyed:
        base = base.withColumn("at", F.when(F.size("w") > 0, F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.get("w", i - 1).isin(keys))).otherwise(F.array().cast("array<int>")))
    every += [_windows(size, keyed) for size in sorted(sizes)]
    rows = base.select("rid", "id", F.size("w").alias("n"), F.explode(F.concat(*every)).alias("x")).select("rid", "id", "n", "x.*").withColumn("hash", F.xxhash64("window"))
    rows = rows.join(known, ["k", "hash", "window"], "left").where(F.col("items").isNotNull() | (F.col("p") == 0))
    rows = rows.select("rid", "id", "n", F.when(F.col("p") > 0, F.struct("p", "k")).alias("hit"), "items")
    rows = rows.groupBy("rid", "id").agg(F.max("n").alias("n_words"), F.collect_list("hit").alias("hits"), F.collect_set("items").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["p"], h["p"] + h["k"] - 1))))
    return rows.select("rid", "id", F.col("n_words").cast("long").alias("n_words"), covered.alias("covered"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The digest of ``find_hits``: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    h = find_hits(docs, benchmark, **kw)
    return h.select(
        "id",
        "n_words",
        F.size("covered").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("covered") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without its contaminated documents, or (``action="spans"``) with the covered words cut out of their texts.

    Cutting removes each covered word and what stands between it and the next word. Columns stay as they are. Rows that
    share an id are removed together; a null id counts as an id.
    """
    if action == "documents":
        bad = find_hits(docs, benchmark, id_col=id_col, text_col=text_col, **kw).where(F.size("covered") > 0).select(F.col("id").alias("__bad")).distinct()
        return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")), "left_anti")
    if action != "spans":
        raise ValueError(f"unknown action {action!r}")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    keyed = docs.withColumn("__key", key)
    # equal texts have equal hits, so one row of each key is enough
    hit = find_hits(keyed.select("__key", F.col(text_col).alias("__text")).dropDuplicates(["__key"]), benchmark, id_col="__key", text_col="__text", **kw).where(F.size("covered") > 0)
    hit = hit.select(F.col("id").alias("__hit_key"), F.col("covered").alias("__covered"))
    out = keyed.join(hit, F.col("__key").eqNullSafe(F.col("__hit_key")), "left")
    gaps, words = F.split(F.col(text_col), _WORD), F.regexp_extract_all(F.col(text_col), F.lit(f"({_WORD})"), F.lit(1))
    pieces = F.transform(words, lambda w, i: F.when(F.array_contains("__covered", i + 1), F.lit("")).otherwise(F.concat(w, F.get(gaps, i + 1))))
    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(pieces, ""))
    return out.withColumn(text_col, F.when(F.col("__covered").isNull(), F.col(text_col)).otherwise(cut)).select(*docs.columns)
