"""Phrase collocations mined over a prefix-free parse.

Texts are cut into pieces at punctuation and line ends, pieces into words. The parse cuts a piece wherever a word's hash
is a trigger: equal passages are cut alike wherever they stand, so copies come to the same chunks. A chunk also holds
the three words that follow it in its piece, so every phrase of up to four words lies whole inside the chunk in which it
begins; there, and only there, it is counted. The dictionary of distinct chunks with their frequencies replaces the
texts: a passage that thousands of documents share is looked at once, and weighs its frequency.

A phrase that occurs ``least`` times is made of pairs that do. So the dictionary is read twice. First the pairs are
counted under short hashes, counts up to ``least`` only; hashes that reach it are kept in a bitmap of fixed size. Then
phrases all of whose pairs are in the bitmap are counted as text. Equal hashes, or a bitmap that fills up, let phrases
pass that need not, and these are counted, exactly, for nothing; no phrase is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.llm.bytekit import ASCII_LOWER, U, buffers, frugal, mix, pieces, span_hashes, spans, table_of
from engramma.llm.near_dup import _by_bucket
from engramma.storage import written

#: A word in so many is a trigger.
TRIGGER = 16
#: Words of the longest phrase.
LONGEST = 4
#: Pairs under their hashes in one bucket, on average.
BUCKET_PAIRS = 1_000_000
#: Bits of the bitmap of frequent pairs, as a power of two: 16 MB.
BITMAP = 27
#: Bytes of chunks that are counted together.
SLICE_BYTES = 8_000_000
_BREAK = table_of(b".,;:!?\n\x0b\x0c\r")
_WORD = ~(_BREAK | table_of(b" \t"))
_NOT_BLANK = ~table_of(b" ")


def text_chunks(texts: pa.Array, trigger: int = TRIGGER) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(row, chunk, core) of all texts: a chunk's words are one space apart, phrases that begin in its first ``core`` words are its own."""
    data, offs = buffers(texts)
    for a, b in pieces(offs):
        d = ASCII_LOWER[data[offs[a] : offs[b]]]
        starts, ends, first = spans(d, offs[a : b + 1] - offs[a], _WORD)
        if not len(starts):
            continue
        row = np.repeat(np.arange(b - a), np.diff(first))
        breaks = np.cumsum(_BREAK[d])[starts]
        head = np.ones(len(starts), bool)
        head[1:] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
        # words of a piece one space apart: the byte after a word that another follows stays as that space
        keep = _WORD[d]
        inner = np.flatnonzero(~head) - 1
        d[ends[inner]] = 32
        keep[ends[inner]] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        joined, js, je = d[keep].tobytes(), at[starts], at[ends]
        cut = np.flatnonzero(head | (span_hashes(d, starts, ends) % U(trigger) == 0))
        stop = np.append(cut[1:], len(starts))
        piece = np.cumsum(head)
        last_of_piece = np.searchsorted(piece, piece[cut], "right")
        last = np.minimum(stop + LONGEST - 1, last_of_piece) - 1
        yield a + row[cut], [joined[x:y] for x, y in zip(js[cut].tolist(), je[last].tolist(), strict=True)], stop - cut


def chunk_table(docs: DataFrame, lang: Column, text: Column, trigger: int = TRIGGER) -> DataFrame:
    """(lang, core, chunk, n): the distinct chunks of each language and how often the texts hold them."""

    @frugal
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, chunk, core in text_chunks(b.column(1), trigger):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(core), pa.array(chunk, pa.binary()).cast(pa.string())], ["lang", "core", "chunk"])

    rows = docs.select(lang.alias("lang"), text.alias("text")).where("text is not null")
    return rows.mapInArrow(parse, "lang string, core bigint, chunk string").groupBy("lang", "core", "chunk").agg(F.count("*").alias("n"))


class Words:
    """The words of a slice of the dictionary, their places in its bytes, and which of them begin phrases of the chunk."""

    def __init__(self, lang: pa.Array, core: np.ndarray, chunk: pa.Array, n: np.ndarray):
        self.data, offs = buffers(chunk)
        self.starts, self.ends, first = spans(self.data, offs, _NOT_BLANK)
        size = np.diff(first)
        self.chunk = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(self.chunk)) - first[:-1][self.chunk]
        self.own = place < core[self.chunk]
        self.left = size[self.chunk] - place  # words to the chunk's end, this one included
        self.n = n
        ldata, loffs = buffers(lang)
        self.seed = mix(~span_hashes(ldata, loffs[:-1], loffs[1:]))  # unlike the hash of a word that is the language's name

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The places at which pairs begin that this slice may see, and the pairs' hashes."""
        at = np.flatnonzero(self.left >= 2)
        return at, self.phrases(at, 2)

    def phrases(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the phrases of ``k`` words that begin there, by language."""
        return mix(span_hashes(self.data, self.starts[at], self.ends[at + k - 1]) ^ self.seed[self.chunk[at]])

    def text(self, at: np.ndarray, k: int) -> pa.Array:
        raw = self.data.tobytes()
        return pa.array([raw[x:y] for x, y in zip(self.starts[at].tolist(), self.ends[at + k - 1].tolist(), strict=True)], pa.binary()).cast(pa.string())


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(lang, core, chunk, n) rows of at least ``size`` bytes together, but for the last."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 40)[0]
            held, total = [], 0
    if total:
        yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 40)[0]


def _words(b: pa.RecordBatch) -> Words:
    number = lambda k: b.column(k).to_numpy(zero_copy_only=False)
    return Words(b.column(0), number(1), b.column(2), number(3))


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the first place of each, and the sum of ``n`` over it."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[head], order[head], np.add.reduceat(n[order], head) if len(s) else n[:0]


def _place(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each hash, and the 32 bits that stand for it there."""
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int32), h.astype(np.uint32)


def _bit(bucket: np.ndarray | int, short: np.ndarray, bits: int) -> np.ndarray:
    return (mix(np.asarray(bucket).astype(U) << U(32) | short.astype(U)) >> U(64 - bits)).astype(np.int64)


def frequent_pairs(chunks: DataFrame, least: int, buckets: int, bitmap_bits: int) -> np.ndarray:
    """The bitmap in which every pair of words that occurs at least ``least`` times in its language has its bit set."""
    count = np.uint8 if least < 256 else np.int64

    @frugal
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, SLICE_BYTES):
            w = _words(b)
            at, h = w.pairs()
            own = w.own[at]
            h, _, n = _summed(h[own], w.n[w.chunk[at[own]]])
            bucket, short = _place(h, buckets)  # sorted, as the hashes are
            n = np.minimum(n, least).astype(count)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            ends = [*cuts[1:], len(bucket)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]) if len(bucket) else pa.array([], pa.int32()), pa.array([short[x:y].tobytes() for x, y in zip(cuts, ends, strict=False)], pa.binary()), pa.array([n[x:y].tobytes() for x, y in zip(cuts, ends, strict=False)], pa.binary())], ["bucket", "shorts", "counts"])

    @frugal
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            bucket = rows[0].column(0)[0].as_py()
            short = np.concatenate([buffers(r.column(1))[0].view(np.uint32) for r in rows])
            n = np.concatenate([buffers(r.column(2))[0].view(count) for r in rows]).astype(np.int64)
            short, _, n = _summed(short, n)
            bit = np.sort(_bit(bucket, short[n >= least], bitmap_bits))
            word = bit >> 6
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(bit) else np.zeros(0, np.int64)
            bits = np.bitwise_or.reduceat(U(1) << (bit & 63).astype(U), head) if len(bit) else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([pa.array(word[head]), pa.array(bits.view(np.int64))], ["word", "bits"])

    dealt = chunks.mapInArrow(deal, "bucket int, shorts binary, counts binary")
    found = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "word bigint, bits bigint")
    got = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bitmap_bits - 6), U)
    bitmap[got["word"].to_numpy()] = got["bits"].to_numpy().view(U)
    return bitmap


def phrase_counts(chunks: DataFrame, least: int, buckets: int, bitmap_bits: int = BITMAP) -> DataFrame:
    """(lang, phrase, k, f): words and phrases of up to four words that occur at least ``least`` times in their language."""
    bitmap = frequent_pairs(chunks, least, buckets, bitmap_bits)

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, SLICE_BYTES):
            w = _words(b)
            at, h = w.pairs()
            bit = _bit(*_place(h, buckets), bitmap_bits)
            passes = np.zeros(len(w.chunk) + LONGEST, bool)
            passes[at] = bitmap[bit >> 6] >> (bit & 63).astype(U) & U(1) > 0
            own = np.flatnonzero(w.own)
            for k in range(1, LONGEST + 1):
                if k > 1:
                    own = own[passes[own + k - 2]]  # a place that passes has a next word in its chunk
                _, first, n = _summed(w.phrases(own, k), w.n[w.chunk[own]])
                places = own[first]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(w.chunk[places])), w.text(places, k), pa.array(np.full(len(places), k, np.int32)), pa.array(n)], ["lang", "phrase", "k", "n"])

    rows = chunks.select("lang", "core", "chunk", "n").mapInArrow(count, "lang string, phrase string, k int, n bigint")
    return rows.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _part(start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice("w", start, length), " ")


def collocations(docs: DataFrame, least: int = 30, inside_percent: int = 80, keep: int = 2000, lang_col: str = "lang", text_col: str = "text", trigger: int = TRIGGER, bitmap_bits: int = BITMAP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``keep`` best phrases of two to four words.

    a is a phrase's count, of at least ``least``; l and r are the counts of its two parts where it is cut for the lowest
    score floor(2000000 * a / (l + r)), ties to the shorter first part; n is the number of words of the language.
    Phrases inside a longer one that has ``inside_percent`` of their count are dropped, whatever comes of the longer.
    Best are the highest scores, then the highest counts, then the smallest phrases by bytes.

    A null language is ``und``; null and empty texts have no words; repeated rows count each; an empty table gives no
    row; other columns are not read.
    """
    chunks = written(chunk_table(docs, F.coalesce(F.col(lang_col), F.lit("und")), F.col(text_col), trigger), "phrases-chunks")
    totals = written(chunks.groupBy("lang").agg(F.sum(F.col("core") * F.col("n")).alias("n"), F.sum("core").alias("distinct")), "phrases-totals")
    distinct = totals.agg(F.sum("distinct")).first()[0] or 0
    counts = written(phrase_counts(chunks, least, max(1, -(-distinct // BUCKET_PAIRS)), bitmap_bits), "phrases-counts")

    long = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = long.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    exact = "cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"
    scored = scored.withColumn("score", F.expr(exact))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("b"))

    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    over = long.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    held = F.expr(f"cast(over as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {int(inside_percent)}")
    left = best.join(over, ["lang", "phrase"], "left").where(~F.coalesce(held, F.lit(False)))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = left.select("lang", "phrase", "a", "b.*").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    return top.join(totals.select("lang", "n"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
