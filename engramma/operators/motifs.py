"""Motifs: assignment by pattern and by anchor vectors, postings, gates, consensus, propagation."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.operators.search import cosine_pairs


@dataclass(frozen=True)
class Motif:
    """A dictionary entry: examples are searched as whole words, anti-examples as substrings."""

    motif_id: str
    band: str
    examples: tuple[str, ...]
    anti_examples: tuple[str, ...] = ()
    definition: str = ""

    def patterns(self) -> list[str]:
        out = []
        for e in self.examples:
            words = r"\s+".join("".join(c if c.isalnum() else "\\" + c for c in w) for w in e.split())
            out.append(rf"(?iU)\b{words}\b")
        return out


@dataclass
class Dictionary:
    motifs: list[Motif] = field(default_factory=list)

    def ids(self, band: str | None = None) -> list[str]:
        return sorted(m.motif_id for m in self.motifs if band is None or m.band == band)

    def band_or_all(self, wanted: list[str], band: str) -> list[str]:
        """The wanted motifs of a band; if none of them is in it, the whole band."""
        own = self.ids(band)
        return [m for m in wanted if m in own] or own


#: Letters that case folding takes for ASCII ones.
_FOLDED = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}
#: Bytes of a text to lower-case ASCII word characters and blanks.
_WORD_BYTES = bytes(ord(c.lower()) if (c := chr(b)).isascii() and (c.isalnum() or c == "_") else 32 for b in range(256))


def _runs(text: str) -> set[bytes]:
    """The runs of ASCII word characters in a text, folded. Where a phrase stands as whole words, each of its runs is a whole run of the text."""
    data = text.encode()
    if not data.isascii():
        for letter, plain in _FOLDED.items():
            data = data.replace(letter.encode(), plain.encode())
    return set(data.translate(_WORD_BYTES).split())


def _possible(texts: Column, phrases: list[str]) -> Column:
    """The numbers of the phrases that have all their runs in a text; a phrase without any is always one."""
    runs = [_runs(p) for p in phrases]
    always = [i for i, r in enumerate(runs) if not r]
    by_run: dict[bytes, list[int]] = {}
    for i, r in enumerate(runs):
        if r:
            by_run.setdefault(max(r, key=len), []).append(i)
    keys = frozenset(by_run)

    @F.arrow_udf("array<int>")
    def possible(text: pa.Array) -> pa.Array:
        out = []
        for t in text:
            held = _runs(t.as_py() or "")
            out.append(always + [i for k in keys & held for i in by_run[k] if runs[i] <= held])
        return pa.array(out, pa.list_(pa.int32()))

    return possible(texts)


def assign(docs: DataFrame, dictionary: Dictionary, key: str, text: str = "text", density: float = 0.15) -> DataFrame:
    """(key, motif_id, band, hits, amp, confidence): motifs whose examples occur in a text.

    amp = min(1, density * hits / (characters / 1000)), rounded to 4 places; each anti-example takes 0.3 of the
    confidence, which is 0.1 at least. The dictionary is part of the expression. A text is cut into runs of word
    characters once; a pattern is only looked for in texts that have all runs of its example.
    """
    n, low = F.length(text), F.col("__low")
    phrases = [(i, e, p) for i, m in enumerate(dictionary.motifs) for e, p in zip(m.examples, m.patterns(), strict=True)]
    entries = F.array(*(F.struct(F.lit(i).alias("motif"), F.lit(e.split()[0].lower()).alias("first"), F.lit(p).alias("pattern")) for i, e, p in phrases))
    # of those, where its first word stands
    count = lambda e: F.when(low.contains(e["first"]), F.regexp_count(F.col(text), e["pattern"])).otherwise(0)
    hits = F.transform(F.col("__possible"), lambda k: F.struct(F.get(entries, k)["motif"].alias("motif"), count(F.get(entries, k)).alias("hits")))
    hits = F.filter(hits, lambda h: h["hits"] > 0)
    motifs = F.array(*(F.struct(F.lit(m.motif_id).alias("motif_id"), F.lit(m.band).alias("band"), F.array(*(F.lit(a.lower()) for a in m.anti_examples)).cast("array<string>").alias("against")) for m in dictionary.motifs))
    total = lambda i: F.aggregate(F.filter(F.col("__hits"), lambda h: h["motif"] == i), F.lit(0), lambda s, h: s + h["hits"])
    against = lambda i: F.size(F.filter(F.get(motifs, i)["against"], lambda a: low.contains(a)))
    found = F.transform(F.array_distinct(F.col("__hits")["motif"]), lambda i: F.struct(F.get(motifs, i)["motif_id"].alias("motif_id"), F.get(motifs, i)["band"].alias("band"), total(i).alias("hits"), against(i).alias("anti")))
    d = docs.where(F.col(text).isNotNull() & (n > 0)).select(key, text, n.alias("n"), F.lower(F.col(text)).alias("__low"), _possible(F.col(text), [e for _, e, _ in phrases]).alias("__possible"))
    d = d.withColumn("__hits", hits).select(key, "n", "__low", "__hits").select(key, "n", F.explode(found).alias("m"))
    amp = F.round(F.least(F.lit(1.0), F.lit(density) * F.col("m.hits") / (F.col("n") / 1000)), 4)
    conf = F.greatest(F.lit(0.1), 1 - 0.3 * F.col("m.anti"))
    return d.select(key, "m.motif_id", "m.band", "m.hits", amp.alias("amp"), conf.alias("confidence"))


def dominant(assignments: DataFrame, key: str, top: int = 5, min_amp: float = 0.10, min_confidence: float = 0.30) -> DataFrame:
    """(key, dominant_motifs): the strongest motifs of each row that pass the thresholds, sorted by name."""
    w = Window.partitionBy(key).orderBy(F.desc("amp"), "motif_id")
    a = assignments.where((F.col("amp") >= min_amp) & (F.col("confidence") >= min_confidence)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    return a.groupBy(key).agg(F.array_sort(F.collect_list("motif_id")).alias("dominant_motifs"))


def classify_by_anchor(vectors: DataFrame, anchors: DataFrame, key: str, vector: str = "embedding", record: float = 0.4, dominate: float = 0.6) -> DataFrame:
    """(key, anchor_id, similarity, is_dominant) for every anchor (anchor_id, av) near enough, the similarity to four places."""
    s = cosine_pairs(vectors, anchors.select(F.col("anchor_id").alias("query_id"), F.col("av").alias("qv")), key, vector, floor=record - 0.001)
    s = s.select(key, F.col("query_id").alias("anchor_id"), F.round("similarity", 4).alias("similarity")).where(F.col("similarity") >= record)
    return s.withColumn("is_dominant", F.col("similarity") >= dominate)


def posting_union(postings: DataFrame, motifs: list[str], key: str) -> DataFrame:
    return postings.where(F.col("motif_id").isin(motifs)).select(key).distinct()


def posting_intersect(postings: DataFrame, motifs: list[str], key: str) -> DataFrame:
    p = postings.where(F.col("motif_id").isin(motifs)).groupBy(key).agg(F.count_distinct("motif_id").alias("n"))
    return p.where(F.col("n") == len(set(motifs))).select(key)


def overlap_scores(assignments: DataFrame, query: DataFrame, key: str) -> DataFrame:
    """(key, score): the query's motif amplitudes met by a tile's, over their sum. ``query`` is (motif_id, q_amp)."""
    total = query.agg(F.sum("q_amp").alias("total"))
    met = assignments.join(F.broadcast(query), "motif_id").groupBy(key).agg(F.sum(F.least("q_amp", "amp")).alias("met"))
    return met.crossJoin(F.broadcast(total)).select(key, (F.col("met") / F.col("total")).alias("score"))


GATE = 0.809


def gate(coherence: Column, mean_confidence: Column, contradicts: Column, sources: Column) -> tuple[Column, Column, Column]:
    """(trust, flags, passes) of a write: trust is halved by a contradiction and cut to 0.7 without sources."""
    trust = mean_confidence * F.when(contradicts, 0.5).otherwise(1.0) * F.when(sources == 0, 0.7).otherwise(1.0)
    flags = F.array_compact(F.array(F.when(sources == 0, F.lit("no_provenance")), F.when(coherence < GATE, F.lit("low_coherence")), F.when(contradicts, F.lit("contradiction")), F.when(trust < GATE, F.lit("low_trust"))))
    return trust, flags, (coherence >= GATE) & (trust >= GATE)


def consensus(responses: DataFrame, content_hash: str = "content_hash") -> DataFrame:
    """(hash, motif_id, amp, confidence, n, platforms) merged over responders: mean amp, mean confidence plus 0.05 for each further one."""
    g = responses.groupBy(content_hash, "motif_id").agg(F.avg("amp").alias("amp"), F.avg("confidence").alias("c"), F.count("*").alias("n"), F.array_sort(F.collect_set("platform")).alias("platforms"))
    return g.select(content_hash, "motif_id", "amp", F.least(F.lit(1.0), F.col("c") + 0.05 * (F.col("n") - 1)).alias("confidence"), "n", "platforms")


def propagate(child_motifs: DataFrame, parent_of: DataFrame, child: str, parent: str) -> DataFrame:
    """(parent, motif_id, similarity): each parent's motifs are its children's, at their highest similarity."""
    return child_motifs.join(parent_of, child).groupBy(parent, "motif_id").agg(F.max("similarity").alias("similarity"))


def resonance(updates: DataFrame, now: Column, tau: Column, floor: float = 0.001) -> DataFrame:
    """(k, motif_id, amp): for every field the largest update, decayed to ``now`` by exp(-dt / tau); what is below ``floor`` is gone.

    Updates are (k, motif_id, amp, at) with ``at`` in seconds. Decay is taken when reading, so state is a maximum only.
    """
    now_amp = F.col("amp") * F.exp(-(now - F.col("at")) / tau)
    return updates.groupBy("k", "motif_id").agg(F.round(F.max(now_amp), 6).alias("amp")).where(F.col("amp") >= floor)
