"""Seeded samples of strata, the same for any partitioning, and sets of test queries with fixed shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.operators.motifs import Dictionary
from engramma.storage import written


def seeded(key: Column, seed: int) -> Column:
    """What rows are drawn by: 32 hex digits of seed and key; a null key counts as empty text."""
    return F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "utf-8"))


def sample(rows: DataFrame, key: str, size: Column, by: str, seed: int = 42, room: int = 20) -> DataFrame:
    """``rows`` of a sample: of each stratum those that draw the smallest, as many as ``size`` says of its number of rows, ``n``.

    What a row draws depends on the seed and its key alone, so a sample does not change with partitions or order, and a
    smaller one is part of a larger. A stratum's rows are not sorted whole: those that draw too much for it to matter,
    by a bound that leaves room for chance (six deviations and ``room`` rows), are left out where they are read; a
    stratum that chance leaves short is drawn again from all its rows. A stratum with fewer rows gives all; a null stratum is one; rows of equal keys are
    drawn together as far as they fit, in some order.
    """
    stratum = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    drawn = rows.withColumn("__s", stratum).withColumn("__h", seeded(F.col(key), seed))
    n = drawn.groupBy("__s").agg(F.count("*").alias("n"))
    n = written(n.select("__s", "n", F.least(F.greatest(size, F.lit(0)).cast("long"), "n").alias("__k")), "sample-sizes")
    share = F.least((F.col("__k") + 6 * F.sqrt("__k") + room) / F.col("n"), F.lit(1.0))
    # the first 28 bits as a share
    bound = n.select("__s", "__k", F.when(share < 1, F.lpad(F.lower(F.hex(F.floor(share * (1 << 28)))), 7, "0")).otherwise("g").alias("__cut"))
    w = Window.partitionBy("__s").orderBy("__h", F.col(key))
    near = drawn.join(bound, "__s").where(F.substring("__h", 1, 7) < F.col("__cut"))
    got = written(near.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= F.col("__k")), "sample")
    short = n.join(got.groupBy("__s").agg(F.count("*").alias("__got")), "__s", "left").where(F.coalesce("__got", F.lit(0)) < F.col("__k")).select("__s", "__k")
    if short.limit(1).count():
        again = drawn.join(short, "__s").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= F.col("__k"))
        got = got.join(short.select("__s"), "__s", "left_anti").unionByName(again.withColumn("__cut", F.lit("g")))
    return got.select(*rows.columns)


def quotas(total: int, shares: dict[str, int]) -> dict[str, int]:
    """``total`` dealt out in exact shares; what rounding leaves goes to the largest remainders, ties to the first by name."""
    whole = sum(shares.values())
    out = {k: total * s // whole for k, s in shares.items()}
    rest = sorted(shares, key=lambda k: (-(total * shares[k] % whole), k))[: total - sum(out.values())]
    return {k: v + (k in rest) for k, v in out.items()}


#: Shares of the kinds of test queries.
SHARES = {"single_motif": 40, "multi_motif": 30, "thematic": 20, "adversarial": 10}


def query_candidates(assignments: DataFrame, dictionary: Dictionary, off_topic: DataFrame) -> DataFrame:
    """(category, name, text, expected_motifs): every query that can be made of motifs found in texts (key, motif_id).

    Two for each motif that occurs, one for each two that occur in a text together, one for each band and motif (the
    band's theme seen from it), and one for each text of ``off_topic`` (name, text), which expects none.
    """
    spark = assignments.sparkSession
    names = spark.createDataFrame([(m.motif_id, m.band, m.motif_id.partition(".")[2].lower().replace("_", " ")) for m in dictionary.motifs], "motif_id string, band string, phrase string")
    # texts with the same motifs give the same queries
    sets = written(assignments.groupBy("key").agg(F.array_sort(F.collect_set("motif_id")).alias("set")).select("set").distinct(), "query-motifs")
    a = sets.select("set", F.explode("set").alias("motif_id")).join(F.broadcast(names), "motif_id")
    asked = F.array(F.struct(F.lit("/what").alias("n"), F.concat(F.lit("What is "), "phrase", F.lit("?")).alias("t")), F.struct(F.lit("/how").alias("n"), F.concat(F.lit("How does "), "phrase", F.lit(" show?")).alias("t")))
    single = a.select("motif_id", "phrase").distinct().select("motif_id", F.explode(asked).alias("q")).select(F.lit("single_motif").alias("category"), F.concat("motif_id", "q.n").alias("name"), F.col("q.t").alias("text"), F.array("motif_id").alias("expected_motifs"))
    # the pairs of motifs in a text; a text has at most as many motifs as the dictionary
    held = a.groupBy("set").agg(F.array_sort(F.collect_set(F.struct("motif_id", "phrase"))).alias("ms"))
    pair = F.expr("flatten(transform(ms, (x, i) -> transform(slice(ms, i + 2, size(ms)), y -> struct(x as x, y as y))))")
    multi = held.select(F.explode(pair).alias("p")).distinct().select(F.lit("multi_motif").alias("category"), F.concat_ws("+", "p.x.motif_id", "p.y.motif_id").alias("name"), F.concat(F.lit("How does "), "p.x.phrase", F.lit(" relate to "), "p.y.phrase", F.lit("?")).alias("text"), F.array("p.x.motif_id", "p.y.motif_id").alias("expected_motifs"))
    theme = a.select("band", "motif_id", "phrase").distinct().select(F.lit("thematic").alias("category"), F.concat_ws("/", "band", "motif_id").alias("name"), F.concat(F.lit("Which "), "band", F.lit(" patterns come with "), "phrase", F.lit("?")).alias("text"), F.array("motif_id").alias("expected_motifs"))
    other = off_topic.select(F.lit("adversarial").alias("category"), "name", "text", F.array().cast("array<string>").alias("expected_motifs"))
    return single.unionByName(multi).unionByName(theme).unionByName(other)


def query_set(candidates: DataFrame, total: int = 100, seed: int = 42, shares: dict[str, int] | None = None) -> DataFrame:
    """(query_id, category, name, text, expected_motifs): a drawn set of test queries in exact shares, numbered in the order drawn. A kind with fewer candidates gives all it has."""
    wanted = quotas(total, shares or SHARES)
    c = written(candidates.where(F.col("category").isin(list(wanted))).withColumn("__key", F.concat_ws("|", "category", "name")), "query-candidates")
    w = Window.partitionBy("category").orderBy(seeded(F.col("__key"), seed), "__key")
    out = None
    for k, n in wanted.items():
        part = sample(c.where(F.col("category") == k), "__key", F.lit(n), "category", seed)
        out = part if out is None else out.unionByName(part)
    number = F.lpad((F.row_number().over(w) - 1).cast("string"), 3, "0")  # as many as were asked for
    return out.select(F.concat_ws("_", "category", number).alias("query_id"), "category", "name", "text", "expected_motifs")
