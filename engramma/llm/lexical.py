"""Ranked lexical search over document FP-trees.

Only terms of the queries matter to a ranking. A document is reduced to the vector of the query terms that it holds with
their counts, and its length; everything else is counted from these vectors. In a task the vectors of a bounded number
of documents are ordered by the frequency of their terms, the most frequent first, so documents that begin alike share
a path of a trie. A node stands for a run of documents; it knows the greatest count of each term in its subtree and the
smallest length norm m there. As a term's part of a score rises with its count and falls with m, these bound every
score below the node. The search goes depth first for all items together: an item leaves a subtree as soon as the bound
is below the tenth score it has, and documents at the ends are scored exactly.

A bounded sample of documents is searched first. Its tenth score is reached by ten documents of the whole, so no document
below it can be among an item's ten: every tree starts from it, and most trees then return nothing for most items.

Terms are compared by 64-bit hashes and their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramma.llm.bytekit import ASCII_LOWER, U, buffers, frugal, mix, pieces, span_hashes, spans
from engramma.storage import written

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (item, term) pairs of one pass over the documents, which go to every task.
PASS_TERMS = 1_000_000
#: Weights (terms times items) that are held against a tree at a time.
BLOCK_CELLS = 4_000_000
#: Documents, and entries of their vectors, in one tree; documents at which a subtree is no longer split.
TREE_DOCS, TREE_ENTRIES, LEAF = 16_384, 4_000_000, 32
#: Documents of the sample that sets the first bounds.
SAMPLE_DOCS = 4_096
#: Terms of an item up to which sums are exact in doubles: each part is below 2^35.
EXACT_TERMS = 200_000


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the terms of each item, once each."""
    terms = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(TERM), 0)
    return items.select(F.col(id_col).cast("long").alias("item_id"), F.explode(terms).alias("term")).distinct()


def _term_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(span_hashes(data, starts, ends) + (ends - starts).astype(U))


def term_vectors(docs: DataFrame, keys: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: how many it has, and the places in ``keys`` (sorted hashes) of those that are there, with their counts."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(1))
            for a, b in pieces(offs):
                d = ASCII_LOWER[data[offs[a] : offs[b]]]
                starts, ends, first = spans(d, offs[a : b + 1] - offs[a], _IN_TERM)
                n = np.diff(first)
                h = _term_keys(d, starts, ends)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                known = np.flatnonzero(keys[at] == h) if len(keys) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(b - a), n)[known]
                entry, tf = np.unique(row * max(len(keys), 1) + at[known], return_counts=True)
                row, term = np.divmod(entry, max(len(keys), 1))
                have = np.flatnonzero(n)
                cut = pa.array(np.append(np.searchsorted(row, have), len(row)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + have)), pa.array(n[have].astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score but for its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Node:
    """A run of documents that share a path: ``terms`` in its subtree (sorted), the greatest count of each, the smallest m."""

    __slots__ = ("lo", "hi", "children", "terms", "most", "m")

    def __init__(self, lo: int, hi: int):
        self.lo, self.hi, self.children = lo, hi, []


class Tree:
    """The trie of some documents: ``rank`` says how frequent each term is, 0 the most."""

    def __init__(self, ids: pa.Array, m: np.ndarray, first: np.ndarray, terms: np.ndarray, tfs: np.ndarray, rank: np.ndarray):
        size = np.diff(first)
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((rank[terms], owner))
        r = rank[terms[order]].astype(">u4").tobytes()
        paths = [r[4 * x : 4 * y] for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        docs = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        self.ids, self.m, self.size = ids.take(pa.array(docs)), m[docs], size[docs]
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        src = order[np.repeat(first[docs], self.size) + np.arange(self.first[-1]) - np.repeat(self.first[:-1], self.size)]
        self.terms, self.tfs = terms[src].astype(np.int64), tfs[src].astype(np.int64)
        self._path = np.append(self.terms, -1)
        self.root = Node(0, len(docs))
        nodes, todo = [], [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            nodes.append(node)
            if node.hi - node.lo > LEAF:
                parts = self._parts(node.lo, node.hi, depth)
                if len(parts) > 1:
                    kids = [(Node(x, y), d) for x, y, d in parts]
                    node.children = [k for k, _ in kids]
                    todo.extend(kids)
        for node in reversed(nodes):  # children before parents
            self._bound(node)

    def _parts(self, lo: int, hi: int, depth: int) -> list[tuple[int, int, int]]:
        """(from, to, depth) of the subtrees of a run of documents: their next terms tell them apart. What only a few documents leave is followed, and small neighbours stay together."""
        left, right = [], []
        while True:
            # documents whose path ends here stand first
            term = np.where(self.size[lo:hi] > depth, self._path[np.minimum(self.first[lo:hi] + depth, len(self.terms))], -1)
            cuts = np.concatenate([[lo], lo + 1 + np.flatnonzero(term[1:] != term[:-1]), [hi]])
            big = int(np.argmax(np.diff(cuts)))
            if term[cuts[big] - lo] < 0 or cuts[big + 1] - cuts[big] <= hi - lo - LEAF:
                break
            left, right = [*left, lo], [*right, hi]
            lo, hi, depth = int(cuts[big]), int(cuts[big + 1]), depth + 1
        cuts = np.unique(np.concatenate([left, cuts, right]).astype(np.int64)).tolist()
        parts, start = [], cuts[0]
        for k in range(1, len(cuts)):
            if k + 1 == len(cuts) or cuts[k + 1] - start > LEAF:
                parts.append((start, cuts[k], depth + 1 if start >= lo and cuts[k] <= hi and start == cuts[k - 1] else 0))
                start = cuts[k]
        return parts

    def _bound(self, node: Node) -> None:
        if node.children:
            t, most = np.concatenate([c.terms for c in node.children]), np.concatenate([c.most for c in node.children])
            node.m = min(c.m for c in node.children)
        else:
            t, most = self.terms[self.first[node.lo] : self.first[node.hi]], self.tfs[self.first[node.lo] : self.first[node.hi]]
            node.m = int(self.m[node.lo : node.hi].min()) if node.hi > node.lo else 0
        order = np.argsort(t, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], t[order][1:] != t[order][:-1]])) if len(t) else np.zeros(0, np.int64)
        node.terms = t[order][head]
        node.most = np.maximum.reduceat(most[order], head) if len(t) else most

    def search(self, weights: np.ndarray, at: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each item's (scores, documents) that may be among its ``k`` best. ``weights`` has a row a term of the block, ``at`` its row for each term (-1: none)."""
        least = floors.astype(weights.dtype)
        best = [(np.zeros(0, weights.dtype), np.zeros(0, np.int64)) for _ in least]
        stack = [(self.root, np.arange(len(least)))]
        while stack:
            node, items = stack.pop()
            own = np.flatnonzero(at[node.terms] >= 0)
            if not len(own):
                continue
            w = weights[at[node.terms[own]]][:, items]
            bound = part(node.most[own], np.int64(node.m)).astype(weights.dtype) @ w
            stay = np.flatnonzero((bound >= least[items]) & (bound > 0))
            if not len(stay):
                continue
            if node.children:
                stack.extend((c, items[stay]) for c in reversed(node.children))
            else:
                for lo in range(node.lo, node.hi, 8 * LEAF):
                    self._score(lo, min(node.hi, lo + 8 * LEAF), node.terms[own], w[:, stay], items[stay], least, best, k)
        return best

    def _score(self, lo: int, hi: int, terms: np.ndarray, w: np.ndarray, items: np.ndarray, least: np.ndarray, best: list, k: int) -> None:
        x, y = self.first[lo], self.first[hi]
        owner = np.repeat(np.arange(hi - lo), self.size[lo:hi])
        place = np.minimum(np.searchsorted(terms, self.terms[x:y]), len(terms) - 1)
        known = terms[place] == self.terms[x:y]
        f = np.zeros((hi - lo, len(terms)), w.dtype)
        f[owner[known], place[known]] = part(self.tfs[x:y][known], self.m[lo:hi][owner[known]])
        scores = f @ w
        for j in np.flatnonzero(scores.max(0) >= least[items]):
            i = items[j]
            good = np.flatnonzero((scores[:, j] >= least[i]) & (scores[:, j] > 0))
            s, docs = np.concatenate([best[i][0], scores[good, j]]), np.concatenate([best[i][1], lo + good])
            if len(s) > 4 * k:
                s, docs = self._first(s, docs, k)
            if len(s) >= k:
                least[i] = max(least[i], np.partition(s, len(s) - k)[len(s) - k])
            best[i] = (s, docs)

    def _first(self, s: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` highest; equal scores by ascending id, null ids last."""
        ids = self.ids.take(pa.array(docs)).to_pylist()
        order = sorted(range(len(s)), key=lambda x: (-s[x], ids[x] is None, ids[x] or 0))[:k]
        return s[order], docs[order]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, entries = [], 0, 0
    for b in batches:
        held.append(b)
        docs += len(b)
        entries += len(b.column(2).flatten())
        if docs >= TREE_DOCS or entries >= TREE_ENTRIES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, docs, entries = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held).combine_chunks()


def _search(vectors: DataFrame, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], item_ids: pa.Array, rank: np.ndarray, n_docs: int, n_terms: int, k: int, floors: np.ndarray) -> DataFrame:
    """(item_id, doc_id, score): of every tree, what may be among each item's ``k`` best. A block is (items, item of each pair, term of each pair, weight of each pair)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shards(batches):
            terms, tfs = (t[c].combine_chunks() for c in ("terms", "tfs"))
            if isinstance(terms, pa.ChunkedArray):
                terms, tfs = (pa.concat_arrays(x.chunks) for x in (terms, tfs))
            offs = terms.offsets.to_numpy().astype(np.int64)
            m = 10 + (90 * t["n"].to_numpy() * n_docs) // n_terms
            ids = t["doc_id"].combine_chunks()
            tree = Tree(ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks), m, offs - offs[0], terms.flatten().to_numpy(), tfs.flatten().to_numpy(), rank)
            for items, of, term, w in blocks:
                rows = np.unique(term)
                at = np.full(len(rank), -1, np.int64)
                at[rows] = np.arange(len(rows))
                weights = np.zeros((len(rows), len(items)), np.float64 if len(rows) <= EXACT_TERMS else np.int64)
                weights[at[term], of] = w
                found = tree.search(weights, at, floors[items], k)
                found = [tree._first(s, d, k) for s, d in found]
                which = np.repeat(items, [len(s) for s, _ in found])
                yield pa.RecordBatch.from_arrays([item_ids.take(pa.array(which)), tree.ids.take(pa.array(np.concatenate([d for _, d in found]))), pa.array(np.concatenate([s for s, _ in found]).astype(np.int64))], ["item_id", "doc_id", "score"])

    return vectors.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(of: np.ndarray, term: np.ndarray, w: np.ndarray, n_items: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Items in blocks whose weights (distinct terms times items) stay within bounds; pairs are sorted by item."""
    first = np.searchsorted(of, np.arange(n_items + 1))
    out, lo = [], 0
    while lo < n_items:
        hi = lo + 1
        while hi < n_items and (first[hi + 1] - first[lo]) * (hi + 1 - lo) <= BLOCK_CELLS:
            hi += 1
        x, y = first[lo], first[hi]
        if y > x:
            out.append((np.arange(lo, hi), of[x:y] - lo, term[x:y], w[x:y]))
        lo = hi
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", pass_terms: int = PASS_TERMS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents with a score above 0, ties by ascending doc_id.

    Null texts and texts without a term are no documents and do not count; a null text of an item has no terms, and an
    item without terms has no rows. Items that repeat an id are one item with the terms of all of them. Rows that repeat
    a doc_id are documents of their own and rank each; null doc_ids come last among ties. Empty tables give no rows;
    other columns are not read. Items whose terms are more than ``pass_terms`` go in several passes over the documents.
    """
    spark = docs.sparkSession
    terms = written(item_terms(items, item_col, item_text), "lexical-terms")
    passes = max(1, -(-terms.count() // pass_terms))
    out = None
    for p in range(passes):
        mine = terms if passes == 1 else terms.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        found = _ranked(_one_pass(docs, mine, k, id_col, text_col, sample_docs), k)
        out = found if out is None else out.unionByName(found)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score") if out is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


def _one_pass(docs: DataFrame, terms: DataFrame, k: int, id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    # at most some ``pass_terms`` rows
    pairs = terms.toArrow()
    data, offs = buffers(pairs["term"])
    hashed = _term_keys(data, offs[:-1], offs[1:])
    keys, term = np.unique(hashed, return_inverse=True)
    ids = pairs["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
    of, item_ids = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), ids.dictionary
    vectors = written(term_vectors(docs, keys, id_col, text_col), "lexical-vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    n_docs, n_terms = int(n_docs), int(n_terms or 1)
    counted = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)))
    counted = counted.select("term", "df", weight.cast("long").alias("w")).toArrow()  # a row a term of the items
    df, w = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    df[counted["term"].to_numpy()], w[counted["term"].to_numpy()] = counted["df"].to_numpy(), counted["w"].to_numpy()
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, -df))] = np.arange(len(keys))
    order = np.lexsort((term, of))
    order = order[(df[term[order]] > 0) & (w[term[order]] > 0)]
    blocks = _blocks(of[order], term[order], w[term[order]], len(item_ids))
    floors = np.zeros(len(item_ids), np.int64)
    if sample_docs and n_docs > sample_docs:
        sample = vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
        low = _ranked(_search(sample, blocks, item_ids, rank, n_docs, n_terms, k, floors), k).where(F.col("rank") == k).select("item_id", "score").toArrow()
        place = {x: i for i, x in enumerate(item_ids.to_pylist())}
        for x, s in zip(low["item_id"].to_pylist(), low["score"].to_pylist(), strict=True):
            floors[place[x]] = s
    return _search(vectors, blocks, item_ids, rank, n_docs, n_terms, k, floors)
