"""Enrichment of contents by motifs: validated answers, gates, postings and fields; columns of tiles; links back to a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.operators import motifs as mo
from engramma.operators.tables import latest, patch

# The field of each band; what rules call a dominant motif; types of references.
BAND_FIELD = {"fast": 0, "mid": 1, "slow": 2}
BRIDGE_AMP, BATCH_AMP, BACKFILL = 0.7, 0.6, 0.7
REFERENCES = ("supports", "contradicts", "extends", "relates")


def band_field(band: Column) -> Column:
    c = F.lit(0)
    for name, k in BAND_FIELD.items():
        c = F.when(band == name, F.lit(k)).otherwise(c)
    return c


def valid_assignments(answers: DataFrame, bands: DataFrame) -> DataFrame:
    """(content_hash, motif_id, band, amp, confidence) of answers' motifs (content_hash, motif_id, amp, confidence).

    Motifs that the dictionary (motif_id, band) lacks are left out; a missing amplitude is 0.5, a missing confidence
    0.7; both are held between 0 and 1; what is then below 0.10 or 0.30 is left out. Of a motif given twice the
    strongest stays.
    """
    held = lambda c, otherwise: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(otherwise))))
    a = answers.join(bands.select("motif_id", "band"), "motif_id").select("content_hash", "motif_id", "band", F.round(held("amp", 0.5), 4).alias("amp"), F.round(held("confidence", 0.7), 4).alias("confidence"))
    return latest(a.where("amp >= 0.10 and confidence >= 0.30"), ["content_hash", "motif_id"], "amp", "confidence")


def enrichment(assignments: DataFrame, sources: DataFrame, contradicted: DataFrame) -> dict[str, DataFrame]:
    """The tables that a batch of valid assignments becomes: gates, postings, fields, events.

    ``sources`` (content_hash, n_sources) and ``contradicted`` (content_hash) decide the gates: coherence is the
    strongest amplitude, trust the mean confidence. Fields keep the largest amplitude by band. The tables are written
    together as one version, so nothing has to be undone when a write fails.
    """
    g = assignments.groupBy("content_hash").agg(F.max("amp").alias("coherence"), F.avg("confidence").alias("c"), F.count("*").alias("n_motifs"))
    g = g.join(sources, "content_hash", "left").join(contradicted.select("content_hash", F.lit(True).alias("x")).distinct(), "content_hash", "left")
    trust, flags, passes = mo.gate(F.col("coherence"), F.col("c"), F.coalesce("x", F.lit(False)), F.coalesce("n_sources", F.lit(0)))
    gates = g.select("content_hash", F.round("coherence", 6).alias("phi"), F.round(trust, 6).alias("trust"), flags.alias("flags"), passes.alias("passes"), "n_motifs")
    return {
        "gates": gates,
        "postings": assignments.select("motif_id", "content_hash").distinct(),
        "fields": assignments.groupBy(band_field(F.col("band")).alias("k"), "motif_id").agg(F.max("amp").alias("amp")),
        "events": gates.select(F.lit("enriched").alias("event_type"), "content_hash", "n_motifs", "passes"),
    }


def tier1(tiles: DataFrame, vectors: DataFrame, anchors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """``tiles`` (key, hmm_version, dominant_motifs, …) with the motifs of the nearest anchors, unless a later tier has them."""
    found = mo.classify_by_anchor(vectors, anchors, key, vector).where("is_dominant").groupBy(key).agg(F.array_sort(F.collect_list(F.col("anchor_id").cast("string"))).alias("dominant_motifs"))
    return patch(tiles, found.withColumn("hmm_version", F.lit("tier1")), key, ["dominant_motifs", "hmm_version"], unless=F.col("hmm_version").startswith("tier2"))


def batch_store(results: DataFrame, tiles: DataFrame) -> DataFrame:
    """(content_hash, dominant_motifs) of batch results (hash, motif_id, amp): the tile whose hash begins with the result's, or the result's with the tile's.

    Motifs of at least 0.6 are dominant. Of several tiles that fit the smallest hash is taken; prefixes of fewer than
    eight characters fit nothing.
    """
    r = results.where((F.length("hash") >= 8) & (F.col("amp") >= BATCH_AMP))
    head = lambda c: F.substring(c, 1, 8)
    t = tiles.select("content_hash", head(F.col("content_hash")).alias("__h")).where("length(content_hash) >= 8").distinct()
    names = r.select("hash", head(F.col("hash")).alias("__h")).distinct()
    fits = F.col("content_hash").startswith(F.col("hash")) | F.col("hash").startswith(F.col("content_hash"))
    met = names.join(t, "__h").where(fits).groupBy("hash").agg(F.min("content_hash").alias("content_hash"))
    return r.join(met, "hash").groupBy("content_hash").agg(F.array_sort(F.collect_set("motif_id")).alias("dominant_motifs"))


def consensus_meta(responses: DataFrame, most: int = 5) -> DataFrame:
    """(content_hash, summary, tone, suggestions) over responses (content_hash, platform, summary, tone, suggestions).

    The longest summary, the tone of the first platform that gives one, and at most ``most`` different suggestions in
    alphabetical order.
    """
    g = responses.groupBy("content_hash").agg(
        F.max_by("summary", F.struct(F.length("summary"), "summary")).alias("summary"),
        F.min_by("tone", F.when(F.coalesce("tone", F.lit("")) != "", F.col("platform"))).alias("tone"),
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("suggestions", F.array().cast("array<string>"))))).alias("s"),
    )
    return g.select("content_hash", "summary", "tone", F.slice(F.array_sort("s"), 1, most).alias("suggestions"))


def bridge(assignments: DataFrame, summaries: DataFrame, gates: DataFrame) -> DataFrame:
    """(content_hash, dominant_motifs, summary, phi, trust, consensus): what a tile's columns become, for contents with a motif of at least 0.7.

    ``summaries`` (content_hash, summary): the longest; ``gates`` (content_hash, phi, trust, consensus).
    """
    d = assignments.where(F.col("amp") >= BRIDGE_AMP).groupBy("content_hash").agg(F.array_sort(F.collect_set("motif_id")).alias("dominant_motifs"))
    s = summaries.groupBy("content_hash").agg(F.max_by("summary", F.struct(F.length("summary"), "summary")).alias("summary"))
    return d.join(s, "content_hash", "left").join(gates, "content_hash", "left").select("content_hash", "dominant_motifs", "summary", "phi", "trust", F.coalesce("consensus", F.lit(False)).alias("consensus"))


def graph_backfill(tiles: DataFrame, known: DataFrame) -> DataFrame:
    """(content_hash, motif_id, amp, confidence) edges for enriched tiles (content_hash, dominant_motifs) that the graph lacks."""
    t = tiles.join(known.select("content_hash"), "content_hash", "left_anti")
    return t.select("content_hash", F.explode("dominant_motifs").alias("motif_id")).distinct().select("content_hash", "motif_id", F.lit(BACKFILL).alias("amp"), F.lit(BACKFILL).alias("confidence"))


def rosetta_tiles(summaries: DataFrame) -> DataFrame:
    """A tile of scale rosetta for each content's summary of ten characters or more: (content_hash, scale, content, token_count)."""
    s = summaries.where(F.length("summary") >= 10).groupBy("content_hash").agg(F.max_by("summary", F.struct(F.length("summary"), "summary")).alias("content"))
    return s.select("content_hash", F.lit("rosetta").alias("scale"), "content", F.floor(F.length("content") / 4).cast("int").alias("token_count"))


def cross_references(references: DataFrame, full: DataFrame, types: tuple[str, ...] = REFERENCES) -> DataFrame:
    """(src, dst, type) of references between prefixes (src_prefix, dst_prefix, type), by the map ``full`` (prefix, content_hash); itself, unknown ends and types are left out."""
    f = lambda name: full.select(F.col("prefix").alias(f"{name}_prefix"), F.col("content_hash").alias(name))
    r = references.where(F.col("type").isin(*types)).join(f("src"), "src_prefix").join(f("dst"), "dst_prefix")
    return r.where("src <> dst").select("src", "dst", "type").distinct()


def document_objects(tiles: DataFrame, columns: tuple[str, ...] = ("platform", "source_file")) -> DataFrame:
    """One row a content: tile ids by scale in order, the first metadata that is not empty by tile id, whether any tile is enriched, tokens.

    Tiles are (content_hash, tile_id, tile_index, scale, token_count, hmm_enriched, …).
    """
    ids = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("scale") == s, F.struct("tile_index", "tile_id")))), lambda x: x["tile_id"]).alias(f"tile_ids_{s.rpartition('_')[2]}")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("tile_id"))).alias(c)
    return tiles.groupBy("content_hash").agg(*(ids(s) for s in ("search_512", "context_2048", "full_4096")), *(first(c) for c in columns), F.coalesce(F.bool_or("hmm_enriched"), F.lit(False)).alias("hmm_enriched"), F.sum("token_count").alias("total_tokens"))


def typed_neighbours(edges: DataFrame, starts: DataFrame, depth: int = 2, jaccard: float = 0.6, most_versions: int = 80, most_related: int = 20, most: int = 100) -> DataFrame:
    """(start, node, how, distance, place): what versions and contradictions reach in any direction, newest first, then what is related closely.

    Edges are (src, dst, type, jaccard, at). The limits are the lists' own: ``most_versions``, ``most_related`` and
    ``most`` rows a start; a node comes once, from the first list that has it.
    """
    from engramma.operators.graph import hops

    strong = edges.where("type in ('SUPERSEDES', 'CONTRADICTS')")
    both = strong.select("src", "dst", "at").unionByName(strong.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "at"))
    newest = both.groupBy(F.col("dst").alias("node")).agg(F.max("at").alias("at"))
    a = hops(strong.select("src", "dst"), starts, depth, directed=False).where("node <> start").join(newest, "node")
    w = Window.partitionBy("start").orderBy(F.desc("at"), "distance", "node")
    a = a.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_versions).select("start", "node", F.lit("versions").alias("how"), "distance", F.lit(0).alias("list"), "n")
    near = edges.where((F.col("type") == "RELATES_TO") & (F.col("jaccard") >= jaccard))
    near = near.select(F.col("src").alias("start"), F.col("dst").alias("node"), "jaccard").unionByName(near.select(F.col("dst").alias("start"), F.col("src").alias("node"), "jaccard")).join(starts, "start", "left_semi").where("node <> start")
    near = near.groupBy("start", "node").agg(F.max("jaccard").alias("j"))
    b = near.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("j"), "node"))).where(F.col("n") <= most_related).select("start", "node", F.lit("related").alias("how"), F.lit(1).alias("distance"), F.lit(1).alias("list"), "n")
    c = a.unionByName(b).groupBy("start", "node").agg(F.min(F.struct("list", "n", "how", "distance")).alias("r"))
    place = F.row_number().over(Window.partitionBy("start").orderBy("r.list", "r.n"))
    return c.withColumn("place", place).where(F.col("place") <= most).select("start", "node", "r.how", "r.distance", "place")
