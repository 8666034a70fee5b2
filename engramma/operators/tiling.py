"""Overlapping multi-scale passages (tiles) of documents.

A text of ``n`` characters that fits a chunk is one tile. Otherwise tiles start on a fixed grid of steps, as many as
leave half a step for the last one; each ends at a paragraph or sentence break in its last fifth, and the last tile
takes what is left. Starts never depend on earlier cuts, so every tile is found by an expression on its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramma.functions.text import last_header, token_estimate

#: Chunk and step in characters: 512, 2048 and 4096 tokens of four characters, steps by the golden ratio's square.
SCALES = {"search_512": (2048, 752), "context_2048": (8192, 3012), "full_4096": (16384, 6024)}


def tile_grid(docs: DataFrame, chunk: int, step: int, text: str = "text") -> DataFrame:
    """Adds tile_index, start_char and grid_end to each tile of each row; null text has no tile, empty text one empty tile."""
    n = F.length(text)
    last = F.when(n <= chunk, F.lit(0)).otherwise(F.floor((n - step // 2) / step).cast("int"))
    d = docs.where(F.col(text).isNotNull()).withColumn("__n", n).withColumn("__last", last)
    d = d.withColumn("tile_index", F.explode(F.sequence(F.lit(0), F.col("__last"))))
    start = F.when(F.col("__n") <= chunk, F.lit(0)).otherwise(F.col("tile_index") * step)
    d = d.withColumn("start_char", start.cast("int"))
    stretched = (F.col("tile_index") == F.col("__last")) & ((F.col("__last") + 1) * step < F.col("__n"))
    end = F.when((F.col("__n") <= chunk) | stretched, F.col("__n")).otherwise(F.least(F.col("start_char") + chunk, F.col("__n")))
    return d.withColumn("grid_end", end.cast("int")).drop("__last")


def tiles(docs: DataFrame, scale: str, text: str = "text") -> DataFrame:
    """Tiles of one scale: scale, tile_index, start_char, end_char, content, token_count; the document's other columns stay.

    A text is cut once into cells as long as a step; every tile is made of the few cells that begin with its own, so the
    work is linear in the text's length.
    """
    chunk, step = SCALES[scale]
    cells = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    d = docs.where(F.col(text).isNotNull()).withColumn("__n", F.length(text)).withColumn("__cells", cells)
    last = F.when(F.col("__n") <= chunk, F.lit(0)).otherwise(F.floor((F.col("__n") - step // 2) / step).cast("int"))
    neighbours = lambda i: F.concat(*(F.coalesce(F.get("__cells", i + k), F.lit("")) for k in range(-(-chunk // step))))
    d = d.withColumn("__last", last).select("*", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("tile_index"), neighbours(i).alias("raw")))).alias("__t"))
    i, raw, n = F.col("__t.tile_index"), F.col("__t.raw"), F.col("__n")
    start = F.when(n <= chunk, F.lit(0)).otherwise(i * step).cast("int")
    stretched = (i == F.col("__last")) & ((F.col("__last") + 1) * step < n)
    stop = F.when((n <= chunk) | stretched, n).otherwise(F.least(i * step + chunk, n)).cast("int")
    d = d.select(*docs.columns, i.alias("tile_index"), start.alias("start_char"), stop.alias("__stop"), "__n", raw.alias("__raw"))
    tail_at = int(0.8 * chunk)
    d = d.withColumn("__back", F.reverse(F.substring("__raw", F.lit(tail_at + 1), F.col("__stop") - F.col("start_char") - tail_at)))
    para, sentence = F.locate("\n\n", F.col("__back")), F.locate(" .", F.col("__back"))
    end = F.when(F.col("__stop") >= F.col("__n"), F.col("__stop")).when(para > 0, F.col("__stop") - para + 1).when(sentence > 0, F.col("__stop") - sentence + 1).otherwise(F.col("__stop"))
    d = d.withColumn("end_char", end.cast("int")).withColumn("content", F.substring("__raw", F.lit(1), F.col("end_char") - F.col("start_char")))
    return d.select(*docs.columns, "tile_index", "start_char", "end_char", "content", F.lit(scale).alias("scale"), token_estimate(F.col("content")).alias("token_count"))


def multi_scale(docs: DataFrame, text: str = "text") -> DataFrame:
    out = None
    for scale in SCALES:
        t = tiles(docs, scale, text)
        out = t if out is None else out.unionByName(t)
    return out


def with_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Adds parent_index: the first parent tile of the document that holds the child's midpoint, or null."""
    p = parents.select(F.col(key).alias("__k"), F.col("start_char").alias("__s"), F.col("end_char").alias("__e"), F.col("tile_index").alias("__i"))
    mid = F.floor((F.col("start_char") + F.col("end_char")) / 2)
    hit = children.select(key, "tile_index", mid.alias("__m")).join(p, (F.col(key) == F.col("__k")) & (F.col("__m") >= F.col("__s")) & (F.col("__m") < F.col("__e")))
    first = hit.groupBy(key, "tile_index").agg(F.min("__i").alias("parent_index"))
    return children.join(first, [key, "tile_index"], "left")


def rebuilt(t: DataFrame, key: str) -> DataFrame:
    """(key, text): each document's text again, every tile giving only what no earlier tile has covered."""
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy("start_char", "tile_index").rowsBetween(Window.unboundedPreceding, -1)
    c = t.withColumn("__seen", F.coalesce(F.max("end_char").over(before), F.lit(0)))
    new = F.when(F.col("end_char") > F.col("__seen"), F.substring(F.col("content"), F.greatest(F.lit(0), F.col("__seen") - F.col("start_char")) + 1, F.length("content"))).otherwise("")
    rows = c.select(key, F.struct("start_char", "tile_index", new.alias("x")).alias("r")).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return rows.select(key, F.array_join(F.transform("rs", lambda r: r["x"]), "").alias("text"))


def with_context(t: DataFrame, text: str = "text") -> DataFrame:
    """Tiles of markdown that don't begin with a header get the last header before them as a first line."""
    head = last_header(F.substring(F.col(text), F.lit(1), F.col("start_char")))
    needs = ~F.col("content").startswith("#") & head.isNotNull()
    return t.withColumn("content", F.when(needs, F.concat(F.lit("[Context: "), head, F.lit("]\n\n"), F.col("content"))).otherwise(F.col("content")))


def tile_stats(t: DataFrame, *by: str) -> DataFrame:
    return t.groupBy(*by).agg(F.count("*").alias("n_tiles"), F.sum("token_count").alias("total_tokens"), F.floor(F.sum("token_count") / F.count("*")).cast("long").alias("avg_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"))


def full_text(t: DataFrame, key: str, order: str = "tile_index", content: str = "content") -> DataFrame:
    """Tiles of a group joined by blank lines in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c"))))
    return t.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["c"]), "\n\n").alias("full_text"))


def canonical_objects(t: DataFrame, content_hash: str = "content_hash") -> DataFrame:
    """One object per content hash: tile counts and ids by scale, tokens, whether any tile is enriched, the representative tile."""
    count = lambda s: F.count_if(F.col("scale") == s).alias(f"tile_count_{s.rpartition('_')[2]}")
    return t.groupBy(content_hash).agg(*(count(s) for s in SCALES), F.sum("token_count").alias("total_tokens"), F.min_by("content", F.struct("scale_rank", "tile_index")).alias("representative")) if "scale_rank" in t.columns else canonical_objects(t.withColumn("scale_rank", scale_rank(F.col("scale"))), content_hash)


def scale_rank(scale: Column) -> Column:
    """Largest passages first."""
    return F.when(scale == "full_4096", 0).when(scale == "context_2048", 1).otherwise(2)
