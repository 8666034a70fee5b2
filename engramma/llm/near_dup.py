"""N-gram Jaccard join by partitioning the universe of shingles.

Sets of shingles go by bands of sizes. In the scheme of a band the universe is hashed into m segments; two sets of
Jaccard similarity t or more differ in at most H = (1-t)/(1+t) * (|R|+|S|) elements, so of more than H segments that
are not empty at least one is equal in both. A set is therefore indexed by its own segments in its own band's scheme
and in that of the band below, and sets that meet in a segment are compared exactly, on all shingles.

Costs decide what a segment is worth. m is chosen so that a set has some tenth more non-empty segments than it needs;
segments that many sets share (a passage that thousands of documents hold) are then worth nothing and are left out,
and the rest still suffice. For the same reason similar sets share not one but many of the rest, so a pair that
shares too few is dropped unseen. The few sets that have too few of them left are *heavy*: the members of large
groups of near copies, and texts that are mostly shared passages. Large groups are first linked to a few pivots. Heavy
sets then meet in one-deletion neighbourhoods (segments that differ in one element), where these are rare. What is
left in another component than the largest of its band is held against all heavy sets of the band, in blocks, by
counting equal segments, and compared exactly where the count allows the similarity.

Copies and common passages are reduced where they are read: of the equal sets in a slice of the input only the smallest
id is indexed, and a segment that many sets of a slice share is dealt to its bucket once, by the smallest id, marked as
common; what the others lose by it goes another way. So no bucket has to hold all holders of a common segment.

Segments are 32-bit hashes within a bucket, packed into binary columns, so that a shuffle moves about eight bytes a
segment; buckets are sorted and matched in numpy, a range of hashes at a time. Shingles are 64-bit hashes of words, and
sets whose 64-bit sums of mixed shingles agree count as equal in a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramma.llm.bytekit import ASCII_LOWER, NOT_SPACE, U, buffers, frugal, mix, pieces, shingles, span_hashes, spans
from engramma.llm.components import components, joined_components
from engramma.storage import written

#: Sets in a run of equal segments that are paired with each other; larger runs are paired with their smallest id.
RUN_PAIRS = 8
#: Largest band size whose segments are single shingles.
SINGLE = 48
#: Segments in a bucket, and in a range of it that is matched at a time.
BUCKET_SEGMENTS, RANGE_SEGMENTS = 4_000_000, 1_000_000
#: Sets of one slice that make a segment common.
LOCAL_RUN = 16
#: Bytes of text whose segments are dealt to buckets at a time.
SLICE_BYTES = 4_000_000
#: Heavy sets, and queries among them, in a cell that counts segments, and the bytes of their shingles.
CELL_SETS, CELL_BYTES = 2000, 8_000_000
#: Ids (8 bytes each) that may be broadcast to pick texts.
BROADCAST_IDS = 1_000_000
_G = U(0x9FB21C651E98DF25)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text; A-Z is lower-cased, words end at ASCII white space."""
    data, offs = buffers(texts)
    for a, b in pieces(offs):
        d = ASCII_LOWER[data[offs[a] : offs[b]]]
        starts, ends, first = spans(d, offs[a : b + 1] - offs[a], NOT_SPACE)
        h, at = shingles(span_hashes(d, starts, ends), first, n)
        for i in range(b - a):
            s = np.sort(h[at[i] : at[i + 1]])
            yield a + i, s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


class Scheme:
    """Bands of set sizes for one threshold, in percent, and the segments of a set in a band's scheme."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 95:
            raise ValueError("the threshold must be from 0.5 to 0.95")
        self.percent = percent
        lows = [2]
        while lows[-1] < 2**40:
            lows.append(lows[-1] * 100 // percent + 1)
        self.lows = np.array(lows, np.int64)

    def band(self, n):
        return np.searchsorted(self.lows, n, "right") - 1

    def top(self, band: int) -> int:
        return int(self.lows[band + 1]) - 1

    def schemes(self, n: int) -> list[int]:
        """Bands in whose schemes a set of ``n`` shingles is indexed: its own, and the one below if partners are there."""
        b = int(self.band(n))
        return [b, b - 1] if b > 0 and 100 * self.top(b - 1) >= self.percent * n else [b]

    def differ(self, n: int, band: int) -> int:
        """The most elements by which a set of ``n`` and any partner in this scheme may differ."""
        partner = 100 * n // self.percent if self.band(n) == band else self.top(band)
        return (100 - self.percent) * (n + partner) // (100 + self.percent)

    def segments(self, s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the non-empty segments of ``s``, their sizes; and for each element the hash of its segment without it, and that segment's index."""
        m = self.top(band) // 2 if self.percent >= 75 and self.top(band) > SINGLE else 0
        salt = U(band + 1) << U(40)
        g = mix(s * _G)
        if not m:
            return mix(g + mix(s ^ salt)), np.ones(len(s), np.int64), np.zeros(0, U), np.zeros(0, np.int64)
        seg = ((mix(s + _G) >> U(32)) * U(m) >> U(32)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        seg, g = seg[order], g[order]
        head = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        sums = np.add.reduceat(g, head)
        size = np.diff(np.concatenate([head, [len(seg)]]))
        place = mix(seg[head].astype(U) + salt)
        of = np.repeat(np.arange(len(head)), size)
        return mix(sums + place), size, mix(sums[of] - g + place[of]), of


_PACKED = "bucket int, ids binary, tags binary, sizes binary, bands binary, needs binary, counts binary, sigs binary, found binary"
#: Marks a header in ``bands``: its segments are common in a slice of the input.
COMMON = 0x8000


def _pack(buckets: int, ids: np.ndarray, tags: np.ndarray, sizes: np.ndarray, bands: np.ndarray, needs: np.ndarray, owner: np.ndarray, sigs: np.ndarray, found: np.ndarray | None = None) -> pa.RecordBatch:
    """A row a bucket: the header of each set that has segments in it, and 32 bits of each segment; what was found already is in a row of its own, in some bucket."""
    bucket = ((sigs >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable")
    bucket, owner, sigs = bucket[order], owner[order], sigs[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    rows = []
    for a, z in zip(cut, [*cut[1:], len(bucket)], strict=True):
        o = owner[a:z]
        head = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        d = o[head]
        counts = np.diff(np.concatenate([head, [z - a]]))
        rows.append((int(bucket[a]), ids[d].tobytes(), tags[d].tobytes(), sizes[d].tobytes(), bands[d].tobytes(), needs[d].tobytes(), counts.astype(np.uint32).tobytes(), sigs[a:z].astype(np.uint32).tobytes(), b""))
    if found is not None and len(found):
        rows.append((int(mix(found["b"][:1].view(U))[0] % U(buckets)), *[b""] * 7, found.tobytes()))
    cols = list(zip(*rows, strict=True)) or [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], [x.split()[0] for x in _PACKED.split(", ")])


def _unpack(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    join = lambda k, t: np.concatenate([buffers(r.column(k))[0].view(t) for r in rows])
    counts = join("counts", np.uint32)
    return join("ids", np.int64), join("tags", U), join("sizes", np.uint32), join("bands", np.uint16), join("needs", np.int32), np.repeat(np.arange(len(counts), dtype=np.int32), counts), join("sigs", np.uint32)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each bucket as slices of their batches, which come sorted by bucket."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        at = b.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(_heads(at))
        for a, z in zip(cuts, [*cuts[1:], len(at)], strict=True):
            if held and at[a] != now:
                yield held
                held = []
            now = at[a]
            held.append(b.slice(a, z - a))
    if held:
        yield held


def _heads(*keys: np.ndarray) -> np.ndarray:
    """True where any of the sorted keys begins a new group."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _distinct(*cols: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = _heads(*cols)
    return [c[new] for c in cols]


_FOUND = "kind tinyint, a bigint, b bigint, band int, n bigint, need_a int, need_b int"
_FOUND_TYPE = np.dtype([("kind", "i1"), ("a", "<i8"), ("b", "<i8"), ("band", "<i4"), ("n", "<i8"), ("need_a", "<i4"), ("need_b", "<i4")])


def _found(kind: int, a: np.ndarray, b: np.ndarray, band: np.ndarray, n: np.ndarray | None = None, need_a: np.ndarray | None = None, need_b: np.ndarray | None = None) -> pa.RecordBatch:
    n, need_a, need_b = (np.full(len(a), 1) if x is None else x for x in (n, need_a, need_b))
    cols = [np.full(len(a), kind, np.int8), a.astype(np.int64), b.astype(np.int64), band.astype(np.int32), n.astype(np.int64), need_a.astype(np.int32), need_b.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "a", "b", "band", "n", "need_a", "need_b"])


def _found_rows(kind: int, a: np.ndarray, b: np.ndarray, band: np.ndarray, n: np.ndarray, need: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), _FOUND_TYPE)
    for name, x in (("kind", kind), ("a", a), ("b", b), ("band", band), ("n", n), ("need_a", need), ("need_b", 1)):
        out[name] = x
    return out


def _as_batch(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[c])) for c in _FOUND_TYPE.names], list(_FOUND_TYPE.names))


def _fit(percent: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can have the similarity."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    return percent * np.maximum(x, y) <= 100 * np.minimum(x, y)


def common_in_slice(ids: np.ndarray, sizes: np.ndarray, bands: np.ndarray, needs: np.ndarray, owner: np.ndarray, sigs: np.ndarray, percent: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What segments that at least ``run`` sets of a slice share come to: (kept, common, found).

    Of such a run the smallest id keeps its entry, which is ``common``; for the others, found rows say how many
    segments each lost (kind 1) and with whom it shares them (kind 3).
    """
    order = np.lexsort((ids[owner], sigs))
    head = np.flatnonzero(_heads(sigs[order]))
    length = np.diff(np.concatenate([head, [len(order)]]))
    hot = np.repeat(length >= run, length)
    first = np.zeros(len(order), bool)
    first[head] = True
    kept, common = np.ones(len(order), bool), np.zeros(len(order), bool)
    kept[order[hot & ~first]] = False
    common[order[hot & first]] = True
    x, pivot = owner[order[hot & ~first]], owner[np.repeat(order[head], length)[hot & ~first]]
    if not len(x):
        return kept, common, np.zeros(0, _FOUND_TYPE)
    o, n = np.unique(x, return_counts=True)
    pairs = np.unique(np.stack([pivot, x], 1), axis=0)
    pairs = pairs[_fit(percent, sizes[pairs[:, 0]], sizes[pairs[:, 1]]) & (ids[pairs[:, 0]] != ids[pairs[:, 1]])]
    lost = _found_rows(1, ids[o], ids[o], bands[o], n, needs[o])
    return kept, common, np.concatenate([lost, _found_rows(3, ids[pairs[:, 0]], ids[pairs[:, 1]], bands[pairs[:, 0]], np.ones(len(pairs)), np.ones(len(pairs)))])


def match_bucket(rows: list[pa.RecordBatch], percent: int, run_pairs: int) -> Iterator[pa.RecordBatch]:
    """What the runs of equal segments in a bucket tell, copies of a set counting as one.

    kind 0: pairs that meet in rare runs, how often, and how often each of them must in all; kind 3: pairs of a large
    run's smallest id with the others; kind 1: how many of a set's segments large runs took.
    """
    for r in rows:
        known = buffers(r.column("found"))[0]
        if len(known):
            yield _as_batch(known.view(_FOUND_TYPE))
    ids, tags, sizes, bands, needs, owners, sigs = _unpack(rows)
    rows.clear()
    # a set with no segment to spare is heavy from the start; of equal ones the smallest
    own = bands & ~np.uint16(COMMON)
    order = np.lexsort((ids, tags, own))
    poor = order[_heads(own[order], tags[order])]
    poor = poor[needs[poor] <= 0]
    yield _found(1, ids[poor], ids[poor], own[poor], np.zeros(len(poor)), needs[poor])
    ranges = -(-len(sigs) // RANGE_SEGMENTS)
    for r in range(ranges):
        part = np.flatnonzero(sigs.astype(U) * U(ranges) >> U(32) == r) if ranges > 1 else slice(None)
        yield from _match(ids, tags, sizes, bands, needs, owners[part], sigs[part], percent, run_pairs)


def _match(ids, tags, sizes, bands, needs, owner, sig, percent: int, run_pairs: int) -> Iterator[pa.RecordBatch]:
    """``match_bucket`` for the segments ``sig`` of the sets ``owner``. A run with a common entry is large whatever its length."""
    marked, bands = bands >= COMMON, (bands & ~np.uint16(COMMON)).astype(np.int64)
    order = np.argsort(sig, kind="stable")
    sig, owner = sig[order], owner[order]
    new = _heads(sig)
    again = ~new
    again[:-1] |= again[1:].copy()
    again |= marked[owner]
    sig, owner = sig[again], owner[again]
    if not len(sig):
        return
    order = np.lexsort((ids[owner], tags[owner], sig))
    sig, owner = sig[order], owner[order]
    head = np.flatnonzero(_heads(sig))
    common = np.repeat(np.logical_or.reduceat(marked[owner], head), np.diff(np.concatenate([head, [len(sig)]])))
    first = _heads(sig, tags[owner])  # of equal sets, the smallest id
    sig, owner, common = sig[first], owner[first], common[first]
    order = np.lexsort((ids[owner], sig))
    sig, owner, common = sig[order], owner[order], common[order]
    head = np.flatnonzero(_heads(sig))
    run = np.diff(np.concatenate([head, [len(sig)]]))
    size = np.where(common, len(ids) + run_pairs + 1, np.repeat(run, run))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, run_pairs):
        i = np.flatnonzero((size[d:] <= run_pairs) & (sig[d:] == sig[:-d])) if len(sig) > d else np.zeros(0, np.int64)
        left.append(owner[i])
        right.append(owner[i + d])

    def sizes_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fit = _fit(percent, sizes[x], sizes[y]) & (ids[x] != ids[y])
        return x[fit], y[fit]

    a, b = sizes_fit(np.concatenate(left), np.concatenate(right))
    order = np.lexsort((bands[a], ids[b], ids[a]))
    a, b = a[order], b[order]
    at = np.flatnonzero(_heads(ids[a], ids[b], bands[a]))
    n = np.diff(np.concatenate([at, [len(a)]]))
    a, b = a[at], b[at]
    yield _found(0, ids[a], ids[b], bands[a], n, needs[a], needs[b])
    large = size > run_pairs
    if large.any():
        pivot = np.repeat(owner[head], run)
        x, y = sizes_fit(pivot[large], owner[large])
        order = np.lexsort((bands[x], ids[y], ids[x]))
        x, y = x[order], y[order]
        new = _heads(ids[x], ids[y], bands[x])
        yield _found(3, ids[x[new]], ids[y[new]], bands[x[new]])
        o, n = np.unique(owner[large], return_counts=True)
        yield _found(1, ids[o], ids[o], bands[o], n, needs[o])


def set_table(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, size, hi, lo): the number of distinct shingles of every row, and a 128-bit hash of the set."""

    @frugal
    def run(batches):
        for b in batches:
            size, hi, lo = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, U), np.zeros(b.num_rows, U)
            for i, s in shingle_sets(b.column(1), n):
                size[i] = len(s)
                if len(s):
                    hi[i], lo[i] = mix(s).sum(dtype=U), mix(s + _G).sum(dtype=U)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], ["id", "size", "hi", "lo"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id bigint, size bigint, hi bigint, lo bigint")


def _index(docs: DataFrame, n: int, percent: int, buckets: int, id_col: str, text_col: str, local_run: int) -> DataFrame:
    """The packed segments of all sets of two shingles or more, dealt by bucket."""

    @frugal
    def run(batches):
        scheme = Scheme(percent)
        for b in batches:
            for k, z in pieces(buffers(b.column(1))[1], SLICE_BYTES):
                part = b.slice(k, z - k)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                head, tags, sizes, bands, needs, sigs, counts = [], [], [], [], [], [], []
                sets: dict[int, tuple[int, np.ndarray]] = {}
                for i, s in shingle_sets(part.column(1), n):
                    if len(s) >= 2:
                        tag = int(mix(s).sum(dtype=U))
                        if tag not in sets or ids[i] < sets[tag][0]:  # of equal sets, the smallest id
                            sets[tag] = int(ids[i]), s
                for tag, (i, s) in sets.items():
                    for band in scheme.schemes(len(s)):
                        x = scheme.segments(s, band)[0]
                        head.append(i)
                        tags.append(tag)
                        sizes.append(len(s))
                        bands.append(band)
                        needs.append(len(x) - scheme.differ(len(s), band))
                        sigs.append(x)
                        counts.append(len(x))
                sets.clear()
                if sigs:
                    h = [np.array(head, np.int64), np.array(tags, U), np.array(sizes, np.uint32), np.array(bands, np.uint16), np.array(needs, np.int32)]
                    owner, sig = np.repeat(np.arange(len(counts)), counts), np.concatenate(sigs)
                    kept, common, found = common_in_slice(h[0], h[2], h[3], h[4], owner, sig, percent, local_run)
                    # common entries hang on headers of their own
                    owner = np.where(common, owner + len(counts), owner)[kept]
                    sig = sig[kept]
                    order = np.argsort(owner, kind="stable")
                    h = [np.concatenate([c, c]) for c in h]
                    h[3][len(counts) :] |= np.uint16(COMMON)
                    yield _pack(buckets, *h, owner[order], sig[order], found)

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return _dealt(rows.mapInArrow(run, _PACKED), buckets)


def _dealt(packed: DataFrame, buckets: int) -> DataFrame:
    return packed.repartition(max(1, min(buckets, 20_000)), "bucket").sortWithinPartitions("bucket")


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, size, shingles) of the rows whose ids are wanted."""

    @frugal
    def run(batches):
        for b in batches:
            sets = [b""] * b.num_rows
            size = np.zeros(b.num_rows, np.int64)
            for i, s in shingle_sets(b.column(1), n):
                sets[i], size[i] = s.tobytes(), len(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(sets, pa.binary())], ["id", "size", "shingles"])

    ids = wanted.select(F.col("id").alias("__w"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, F.col("id") == F.col("__w"), "left_semi")
    return rows.mapInArrow(run, "id bigint, size bigint, shingles binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have 100 * intersection >= percent * union."""

    @frugal
    def run(batches):
        for b in batches:
            x, y = b.column(2), b.column(3)
            ok = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                s, t = np.frombuffer(x[i].as_buffer(), U), np.frombuffer(y[i].as_buffer(), U)
                both = np.concatenate([s, t])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    s = sets.select("id", "shingles")
    rows = pairs.join(s.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(s.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def candidates(found: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to verify, and the heavy sets (id, band).

    A pair stays if it meets in as many rare segments as either set must share with a partner, after those that large
    runs took from it; a large run's pivot is paired with heavy sets only, if it is heavy itself. ``copies`` (id, rep)
    are the ids whose sets have a smaller id elsewhere: what slices found of them is their representative's.
    """
    of_copies = copies.select(F.col("id").alias("a"))
    lost = found.where("kind = 1").join(of_copies, "a", "left_anti").groupBy(F.col("a").alias("id"), "band").agg(F.sum("n").alias("lost"), F.max("need_a").alias("need"))
    lost = written(lost, "near-lost")
    heavy = lost.where("need <= lost").select("id", "band")
    met = found.where("kind = 0").groupBy("a", "b", "band").agg(F.sum("n").alias("met"), F.max("need_a").alias("na"), F.max("need_b").alias("nb"))
    of = lambda k: lost.select(F.col("id").alias(k), "band", F.col("lost").alias(f"lost_{k}"))
    met = met.join(of("a"), ["a", "band"], "left").join(of("b"), ["b", "band"], "left")
    enough = F.greatest(F.col("na") - F.coalesce("lost_a", F.lit(0)), F.col("nb") - F.coalesce("lost_b", F.lit(0)))
    stars = found.where("kind = 3").select("a", "b", "band").distinct()
    for k in ("a", "b"):
        stars = stars.join(copies.select(F.col("id").alias(k), "rep"), k, "left").withColumn(k, F.coalesce("rep", k)).drop("rep")
    stars = stars.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "band").distinct()
    for k in ("a", "b"):
        stars = stars.join(heavy.select(F.col("id").alias(k), "band"), [k, "band"], "left_semi")
    return met.where(F.col("met") >= enough).select("a", "b").union(stars.select("a", "b")).distinct(), heavy


def _heavy_index(heavy: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Packed segments of heavy sets and their one-deletion neighbourhoods. Tags are components; needs say 0 for a deletion, else what the segment is worth."""

    @frugal
    def run(batches):
        scheme = Scheme(percent)
        for b in batches:
            head, tags, sizes, bands, worths, sigs, counts = [], [], [], [], [], [], []
            for i, band, raw, comp in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                exact, size, less, of = scheme.segments(np.frombuffer(raw, U), band)
                less = less[size[of] >= 2] if len(of) else less
                for worth, x in ((1, exact[size < 2]), (2, exact[size >= 2]), (0, less)):
                    if len(x):
                        head.append(i)
                        tags.append(comp)
                        sizes.append(len(raw) // 8)
                        bands.append(band)
                        worths.append(worth)
                        sigs.append(x)
                        counts.append(len(x))
            if sigs:
                yield _pack(buckets, np.array(head, np.int64), mix(np.array(tags, np.int64).view(U)), np.array(sizes, np.uint32), np.array(bands, np.uint16), np.array(worths, np.int32), np.repeat(np.arange(len(counts)), counts), np.concatenate(sigs))

    return _dealt(heavy.select("id", "band", "shingles", "component").mapInArrow(run, _PACKED), buckets)


def match_heavy(rows: list[pa.RecordBatch], percent: int, most: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different components that meet in a segment or a one-deletion neighbourhood shared by at most ``most`` entries."""
    ids, comps, sizes, bands, worths, owner, sig = _unpack(rows)
    order = np.lexsort((ids[owner], sig))
    sig, owner = sig[order], owner[order]
    head = np.flatnonzero(_heads(sig))
    ends = np.concatenate([head[1:], [len(sig)]])
    c = comps[owner].view(np.int64)
    if not len(head):
        return
    rare = (ends - head <= most) & (np.minimum.reduceat(c, head) != np.maximum.reduceat(c, head))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.flatnonzero(rare):
        o = owner[head[k] : ends[k]]
        i, j = np.triu_indices(len(o), 1)
        keep = (worths[o[i]] > 0) | (worths[o[j]] > 0)
        left.append(o[i[keep]])
        right.append(o[j[keep]])
    x, y = np.concatenate(left), np.concatenate(right)
    n, m = sizes[x].astype(np.int64), sizes[y].astype(np.int64)
    fit = (comps[x] != comps[y]) & (bands[x] == bands[y]) & (percent * np.maximum(n, m) <= 100 * np.minimum(n, m))
    x, y = ids[x[fit]], ids[y[fit]]
    a, b = _distinct(np.minimum(x, y), np.maximum(x, y))
    yield _found(0, a, b, np.zeros(len(a)))


def count_cell(scheme: Scheme, band: int, ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], is_query: np.ndarray) -> list[tuple[int, int]]:
    """Links of the cell's queries to its other sets: by counting equal segments, then exactly; one for each component that a query meets."""
    parts = [scheme.segments(x, band)[0] for x in sets]
    size = np.array([len(x) for x in sets], np.int64)
    need = np.array([len(p) - scheme.differ(len(x), band) for p, x in zip(parts, sets, strict=True)], np.int64)
    data = np.flatnonzero(~is_query)
    sig = np.concatenate([parts[i] for i in data])
    owner = np.repeat(data, [len(parts[i]) for i in data])
    order = np.argsort(sig, kind="stable")
    sig, owner = sig[order], owner[order]
    out = []
    for q in np.flatnonzero(is_query):
        lo, hi = np.searchsorted(sig, parts[q], "left"), np.searchsorted(sig, parts[q], "right")
        met = [owner[a:b] for a, b in zip(lo, hi, strict=True) if b > a]
        if not met:
            continue
        count = np.bincount(np.concatenate(met), minlength=len(ids))
        fit = (count >= np.maximum(1, np.maximum(need, need[q]))) & (comps != comps[q]) & (scheme.percent * np.maximum(size, size[q]) <= 100 * np.minimum(size, size[q]))
        done = set()
        for t in np.flatnonzero(fit)[np.argsort(-count[fit], kind="stable")]:
            if int(comps[t]) not in done:
                both = np.concatenate([sets[q], sets[t]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= scheme.percent * (len(both) - common):
                    out.append((min(int(ids[q]), int(ids[t])), max(int(ids[q]), int(ids[t]))))
                    done.add(int(comps[t]))
    return out


def counted_links(heavy: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between heavy sets (id, band, shingles, component) of different components.

    Of two sets in different components one is outside the largest of its band: those are the queries, held against
    all sets of the band, a shard of sets and a block of queries to a cell. Cells are bounded in sets and in bytes.
    """
    top = heavy.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("top"))
    h = written(heavy.join(F.broadcast(top), "band").select("id", "band", "shingles", "component", (F.col("component") != F.col("top")).alias("q")), "near-rest")
    # a row a band: how many shards its sets and blocks its queries need
    size, asked = F.length("shingles"), F.col("q").cast("long")
    need = lambda sets, held: F.greatest(F.lit(1), F.ceil(sets / CELL_SETS), F.ceil(held / CELL_BYTES)).cast("long")
    bands = h.groupBy("band").agg(need(F.count("*"), F.sum(size)).alias("shards"), need(F.sum(asked), F.sum(asked * size)).alias("blocks"))
    h = h.join(F.broadcast(bands), "band")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = ["id", "band", "shingles", "component", "shard", "block", "q"]
    data = h.withColumn("shard", deal("shards")).withColumn("block", every("blocks")).withColumn("q", F.lit(False)).select(*cols)
    queries = h.where("q").withColumn("block", deal("blocks")).withColumn("shard", every("shards")).select(*cols)

    def run(t: pa.Table) -> pa.Table:
        is_query = t.column("q").to_numpy(zero_copy_only=False)
        found = []
        if is_query.any():
            found = count_cell(Scheme(percent), t.column("band")[0].as_py(), t.column("id").to_numpy(), t.column("component").to_numpy(), [np.frombuffer(x, U) for x in t.column("shingles").to_pylist()], is_query)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return data.unionByName(queries).groupBy("band", "shard", "block").applyInArrow(run, "a bigint, b bigint").distinct()


def _label(ids: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    lab = labels.select(F.col("id").alias("__i"), "component")
    return ids.join(lab, F.col(key) == F.col("__i"), "left").withColumn("component", F.coalesce("component", F.col(key))).drop("__i")


def links(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", run_pairs: int = RUN_PAIRS, bucket_segments: int = BUCKET_SEGMENTS, local_run: int = LOCAL_RUN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The set table (id, size, hi, lo, rep), verified links (a, b) that connect all that is similar, and the components that they make.

    Equal sets are represented by their smallest id. Links inside one component need not all be there; no two sets
    of the threshold's similarity are left in different components.
    """
    table = written(set_table(docs, n, id_col, text_col), "near-sets")
    total = table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    buckets = max(1, -(-int(total) // bucket_segments))
    known = table.where("size > 0 and id is not null")
    groups = known.groupBy("size", "hi", "lo").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select("size", "hi", "lo", "rep")
    table = written(table.join(groups, ["size", "hi", "lo"], "left").withColumn("rep", F.coalesce("rep", "id")), "near-reps")
    # an id that repeats with a set of its own speaks for itself
    copies = table.where("rep <> id").groupBy("id").agg(F.min("rep").alias("rep")).join(table.where("rep = id").select("id"), "id", "left_anti")
    copies = written(copies, "near-copies")

    @frugal
    def match(batches):
        for rows in _by_bucket(batches):
            yield from match_bucket(rows, percent, run_pairs)

    found = written(_index(docs, n, percent, buckets, id_col, text_col, max(local_run, run_pairs + 1)).mapInArrow(match, _FOUND), "near-found")
    pairs, heavy = candidates(found, copies)
    pairs, heavy = written(pairs, "near-pairs"), written(heavy, "near-heavy")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(heavy.select("id")).distinct()
    sets = written(_sets_of(docs, written(wanted, "near-wanted"), n, id_col, text_col), "near-wanted-sets")
    linked = written(verify(pairs, sets, percent), "near-links")
    labels = components(linked, "near")
    if not heavy.limit(1).count():
        return table, linked, labels

    full = _label(heavy.join(sets, "id"), labels)
    weight = full.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    few = max(1, -(-2 * int(weight) // bucket_segments))

    @frugal
    def match_again(batches):
        for rows in _by_bucket(batches):
            yield from match_heavy(rows, percent, 2 * run_pairs)

    again = _heavy_index(full, percent, few).mapInArrow(match_again, _FOUND).select("a", "b").distinct()
    more = written(verify(again, sets, percent), "near-heavy-links")
    labels = joined_components(labels, more, "near-again")
    rest = _label(heavy.join(sets, "id"), labels).select("id", "band", "shingles", "component")
    last = written(counted_links(rest, percent), "near-last-links")
    return table, linked.unionByName(more).unionByName(last), joined_components(labels, last, "near-last")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A row's set has its text's distinct shingles of ``n`` words, or its whole sequence if it has fewer; null and empty
    texts have none and link with nothing. component_id is the smallest id reachable by links, a row's own included.
    Rows that repeat an id share a component; a null id links with nothing and has a null component. Nothing else of
    ``docs`` is read.
    """
    rows, _, labels = links(docs, n, percent, id_col, text_col, **kw)
    # ids that repeat with different texts join their representatives' components
    return _label(rows, labels, "rep").select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def similar_pairs(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(a, b): every pair of different sets of the threshold's similarity, equal sets by their smallest id.

    ``links`` leaves no such pair in two components, so sets meet inside their component only, by the prefixes of their
    shingles in hash order; at the first that they share, what is left of both must do for the threshold.
    """
    labels = links(docs, n, percent, id_col, text_col, **kw)[2]
    sets = written(_label(_sets_of(docs, labels, n, id_col, text_col).dropDuplicates(["id", "shingles"]), labels), "near-join-sets")

    @frugal
    def heads(batches):
        for b in batches:
            parts = [np.sort(np.frombuffer(x, U)) for x in b.column(2).to_pylist()]
            k = np.array([len(x) + 1 - -(-percent * len(x) // 100) if len(x) else 0 for x in parts], np.int64)
            of = np.repeat(np.arange(len(parts)), k)
            size = np.array([len(x) for x in parts], np.int64)[of]
            pos = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
            shingle = np.concatenate([np.zeros(0, U), *(x[:m] for x, m in zip(parts, k, strict=True))]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), pa.array(shingle), pa.array(size), pa.array(size - pos)], ["id", "component", "i", "size", "rest"])

    h = sets.select("id", "component", "shingles").mapInArrow(heads, "id bigint, component bigint, i bigint, size bigint, rest bigint")
    left, right = (h.select("component", "i", F.col("id").alias(y), F.col("size").alias(f"n{y}"), F.col("rest").alias(f"r{y}")) for y in "ab")
    fit = (F.col("a") < F.col("b")) & (F.least("ra", "rb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    return verify(left.join(right, ["component", "i"]).where(fit).select("a", "b").distinct(), sets, percent)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id. Rows with a null id stay.

    Of rows that repeat this id the first stays, by text and then by the whole row as JSON.
    """
    groups = written(near_duplicates(docs, id_col=id_col, text_col=text_col, **kw), "near-groups")
    drop = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("__drop")).distinct()
    again = written(groups.where("component_id = doc_id").groupBy(F.col("doc_id").alias("__drop")).agg(F.count("*").alias("n")).where("n > 1").select("__drop"), "near-repeated")
    small = lambda d: F.broadcast(d) if d.count() <= BROADCAST_IDS else d
    if not again.limit(1).count():
        return docs.join(small(drop), F.col(id_col) == F.col("__drop"), "left_anti")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = docs.join(small(again), F.col(id_col) == F.col("__drop"), "left_semi")
    firsts = repeated.groupBy(F.col(id_col).alias("__drop")).agg(F.min_by(row, F.struct(F.col(text_col), F.to_json(row))).alias("__row"))
    return docs.join(small(drop.union(again)), F.col(id_col) == F.col("__drop"), "left_anti").unionByName(firsts.select("__row.*"))
