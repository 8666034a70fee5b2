"""Late interaction with an index: documents and queries are bags of token vectors, the score is MaxSim.

MaxSim adds up, over the query's tokens, the best product with a token of the document. Token vectors are grouped under
centroids; the postings say which documents have tokens under a centroid, and how far from it the farthest is. With a
token d under centroid c, q.d is at most q.c + |q| * |d - c|, so probed postings bound what a document can still reach.

A search has two rounds. The first probes each query token's nearest centroids and scores the most promising documents
exactly; the k-th of these scores is a floor for the answer. The second drops every document whose bound is below the
floor and scores the rest. For the exact answer it also widens the probes: a document that reaches the floor must, for
some query token, come within that token's share of it, so the centroids that cannot are left out, and documents that
are met nowhere can't be among the best.

In the first round all meetings are joins by centroid or document. In the second, blocks of queries meet blocks of
documents: where bounds are loose nearly every pair is scored, and a pair costs a part of a matrix product, not a row;
of a meeting, only each query's best leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramma.storage import written

#: Token vectors from which centroids are made, at most; rounds of moving them.
SAMPLE_TOKENS, ROUNDS = 20_000, 6
#: Centroids at most: they and their radii go to every task.
CENTROIDS = 4_096
#: Of a residual, what a search that is not exact takes a product with it to reach at most: so many standard deviations of
#: the product with a random direction.
DEVIATIONS = 3.0
#: Numbers in a matrix that a task makes at a time, at most (a row of it at least).
CELLS = 1 << 20
#: Token vectors in a block of queries and of documents (a bag of more is a block of its own).
QUERY_BLOCK, DOC_BLOCK = 1_024, 4_096
#: Meetings of a query token with a document in a partition, on average.
MET_ROWS = 1 << 18
#: What rounding may take from a bound or a floor, relative to the norms.
SLACK = 1e-9


@dataclass
class TokenIndex:
    """``docs`` (doc, tokens, centroids, radii): each document's vectors, and the centroid of each and how far it is; ``postings`` (centroid, doc, radius); ``centroids`` and the largest radius under each."""

    docs: DataFrame
    postings: DataFrame
    centroids: np.ndarray
    radii: np.ndarray


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _fit(sample: np.ndarray, n: int) -> np.ndarray:
    """Centroids of a sample: evenly spaced rows of it, moved to the means of what is nearest."""
    c = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy() if len(sample) else np.zeros((0, sample.shape[1]))
    for _ in range(ROUNDS if n > 1 else 0):
        near = _nearest(sample, c)
        size = np.bincount(near, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half, step = (c * c).sum(1) / 2, max(1, CELLS // len(c))
    return np.concatenate([np.argmax(x[k : k + step] @ c.T - half, 1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def _tokens(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of rows with a key and a whole finite vector."""
    v = F.col(vector).cast("array<double>")
    whole = F.col(vector).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(whole & F.col(key).isNotNull()).select(F.col(key).alias(key), v.alias("v"))


def build(rows: DataFrame, doc: str = "doc", vector: str = "vector", centroids: int | None = None) -> TokenIndex:
    """The index of token rows (doc, vector). Rows with a null doc, and vectors that are null, empty or not finite, take no part; all others must have one length.

    Centroids are fitted on a bounded sample; every token is indexed. By default there are as many as the square root
    of the number of tokens, twice, within bounds.
    """
    t = written(_tokens(rows, doc, vector).withColumnRenamed(doc, "doc"), "maxsim-tokens")
    n, dim, least = t.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
    if n and dim != least:
        raise ValueError(f"token vectors have lengths from {least} to {dim}")
    dim = int(dim or 1)
    sample = _matrix(t.orderBy(F.xxhash64("doc", "v")).limit(SAMPLE_TOKENS).select("v").toArrow()["v"], dim)
    k = max(1, min(centroids or int(2 * n**0.5), CENTROIDS, len(sample))) if n else 1
    c = _fit(sample, k) if n else np.zeros((1, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            near = _nearest(x, c)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(np.sqrt(((x - c[near]) ** 2).sum(1)))], ["doc", "v", "centroid", "radius"])

    kind = t.schema["doc"].dataType.simpleString()
    found = written(t.mapInArrow(assign, f"doc {kind}, v array<double>, centroid int, radius double"), "maxsim-assigned")
    postings = written(found.groupBy("centroid", "doc").agg(F.max("radius").alias("radius")), "maxsim-postings")
    radii = np.full(k, -np.inf)
    for r in postings.groupBy("centroid").agg(F.max("radius").alias("r")).collect():  # a row a centroid
        radii[r["centroid"]] = r["r"]
    bags = found.groupBy("doc").agg(F.collect_list(F.struct("v", "centroid", "radius")).alias("t"))
    docs = written(bags.select("doc", F.col("t.v").alias("tokens"), F.col("t.centroid").alias("centroids"), F.col("t.radius").alias("radii")), "maxsim-docs")
    return TokenIndex(docs, postings, c, radii)


def _bounds(x: np.ndarray, norm: np.ndarray, c: np.ndarray, radii: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Products of vectors with all centroids, and the most that a product with what stands under each can reach."""
    guess = x @ c.T
    return guess, np.where(radii >= 0, guess + norm[:, None] * np.maximum(radii, 0) * reach + SLACK * (1 + norm[:, None]), -np.inf)


def _probes(index: TokenIndex, q: DataFrame, kind: str, n_probe: int, reach: float) -> DataFrame:
    """(query_id, token, centroid, guess, norm, rest, top): the ``n_probe`` nearest centroids of each query token, their products and bounds, and the bound of all others."""
    c, radii = index.centroids, index.radii

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(c))
        for whole in batches:
            for b in (whole.slice(k, step) for k in range(0, len(whole), step)):
                x = _matrix(b.column(2), c.shape[1])
                norm = np.sqrt((x * x).sum(1))
                guess, bound = _bounds(x, norm, c, radii, reach)
                near = np.argsort(-guess, 1, kind="stable")[:, :n_probe]
                probed = np.zeros(guess.shape, bool)
                np.put_along_axis(probed, near, True, 1)
                rest = np.where(probed, -np.inf, bound).max(1)
                row, at = np.nonzero(probed)
                cols = [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(guess[row, at]), pa.array(norm[row]), pa.array(rest[row]), pa.array(bound.max(1)[row])]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "token", "centroid", "guess", "norm", "rest", "top"])

    return q.select("query_id", "token", "v").mapInArrow(run, f"query_id {kind}, token bigint, centroid int, guess double, norm double, rest double, top double")


def _partitions(index: TokenIndex, probes: DataFrame) -> int:
    """Partitions for what the probes meet, more the more they meet, so that a task's part stays as it is."""
    asked, held = (t.groupBy("centroid").agg(F.count("*").alias(n)) for t, n in ((probes, "asked"), (index.postings, "held")))
    rows = asked.join(held, "centroid").agg(F.sum(F.col("asked") * F.col("held"))).first()[0] or 0
    return max(probes.sparkSession.sparkContext.defaultParallelism, rows // MET_ROWS + 1)


def _met(index: TokenIndex, probes: DataFrame, reach: float, parts: int) -> DataFrame:
    """(query_id, doc, guess, bound): the documents that the probes meet, what they seem to and what they can at most reach."""
    # dealt out before sums are made: a meeting seldom has another to be summed with where it is found
    j = probes.join(index.postings.repartition(parts, "centroid", "doc"), "centroid").repartition(parts, "query_id", "doc")
    bound = F.col("guess") + F.col("norm") * F.col("radius") * reach + SLACK * (1 + F.col("norm"))
    # where all centroids are probed every document is met, and there is no rest
    rest = F.when(F.col("rest") > float("-inf"), F.col("rest")).otherwise(0.0)
    one = j.groupBy("query_id", "doc", "token").agg(F.max("guess").alias("g"), F.max(bound).alias("u"), F.first("rest").alias("rest"))
    by_doc = one.groupBy("query_id", "doc").agg(F.sum("g").alias("g"), F.sum(F.greatest("u", "rest") - rest).alias("more"), F.count("*").alias("n"))
    per = probes.groupBy("query_id", "token").agg(F.first("rest").alias("rest"), F.min("guess").alias("low")).groupBy("query_id")
    # a token that no probe of which meets the document can reach the bound of the unprobed; it seems to reach the last probed
    per = per.agg(F.sum(rest).alias("all_rest"), F.sum("low").alias("all_low"), F.count("*").alias("n_tokens"))
    out = by_doc.join(per, "query_id")
    guess = F.col("g") + F.col("all_low") * (F.col("n_tokens") - F.col("n")) / F.col("n_tokens")
    return out.select("query_id", "doc", guess.alias("guess"), (F.col("all_rest") + F.col("more")).alias("bound"))


def _scored(index: TokenIndex, pairs: DataFrame, queries: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """(query_id, doc, score): MaxSim of pairs (query_id, doc)."""
    dim = index.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nq, nd = (np.concatenate([[0], np.cumsum(b.column(k).value_lengths().to_numpy(zero_copy_only=False))]).astype(int) for k in (2, 3))
            qs, ds = (_matrix(b.column(k).flatten(), dim) for k in (2, 3))
            s = [float((qs[nq[i] : nq[i + 1]] @ ds[nd[i] : nd[i + 1]].T).max(1).sum()) for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], ["query_id", "doc", "score"])

    j = pairs.join(index.docs, "doc").join(queries.select("query_id", F.col("tokens").alias("asked")), "query_id")
    return j.select("query_id", "doc", "asked", "tokens").mapInArrow(run, f"query_id {kinds[0]}, doc {kinds[1]}, score double")


def _blocks(bags: DataFrame, kind: str, values: list[str], size: int) -> DataFrame:
    """(ids, counts, tokens, *values): bags (id, tokens, *values, values being a number a token) in rows of about ``size`` tokens; vectors are packed as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            block = (np.cumsum(counts) - 1) // size
            cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(b))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(lo, hi - lo)
                vectors = part.column(1).flatten().flatten().to_numpy(zero_copy_only=False)
                numbers = [pa.array([part.column(2 + n).flatten().to_numpy(zero_copy_only=False).astype(float).tobytes()]) for n in range(len(values))]
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(b.column(0).type)), pa.array([counts[lo:hi].tolist()], pa.list_(pa.int64())), pa.array([vectors.tobytes()]), *numbers], ["ids", "counts", "tokens", *values])

    return bags.mapInArrow(run, f"ids array<{kind}>, counts array<bigint>, tokens binary{''.join(f', {v} binary' for v in values)}")


def _cells(index: TokenIndex, bags: DataFrame, kinds: tuple[str, str], k: int) -> DataFrame:
    """(query_id, doc, score, n_met, n_scored): every query's best ``k`` documents of every block, and in rows without a document how many of the block were met and scored.

    ``bags`` is (query_id, tokens, share, floor), a number a token: the least product that lets a document be met by the
    token, and the least score of its query. What a matrix product finds best is scored again pair by pair, so that equal
    documents have equal scores wherever they stand.
    """
    c, radii, dim = index.centroids, index.radii, index.centroids.shape[1]
    spark = bags.sparkSession
    queries = written(_blocks(bags, kinds[0], ["share", "floor"], QUERY_BLOCK), "maxsim-query-blocks")
    docs = written(_blocks(index.docs.select("doc", "tokens", "centroids", "radii"), kinds[1], ["centroids", "radii"], DOC_BLOCK), "maxsim-doc-blocks")
    # a task for some of the documents' blocks, whatever files they stand in
    docs = docs.repartition(4 * spark.sparkContext.defaultParallelism).toDF("docs", "sizes", "vectors", "centroids", "radii")
    from pyspark.sql.pandas.types import to_arrow_type

    q_type, d_type = to_arrow_type(bags.schema["query_id"].dataType), to_arrow_type(index.docs.schema["doc"].dataType)

    def asked(b: pa.RecordBatch, i: int) -> tuple:
        """A block of queries: ids, first token of each and their number, vectors, norms, shares, floors, products with the centroids, and which centroids each query reaches."""
        ends = np.cumsum(b.column(1)[i].values.to_numpy(zero_copy_only=False)).astype(int)
        first = np.append(0, ends)
        x, share, floor = (np.frombuffer(b.column(n)[i].as_buffer(), float) for n in (2, 3, 4))
        x = x.reshape(-1, dim)
        norm = np.sqrt((x * x).sum(1))
        guess, reached = np.empty((len(x), len(c))), np.empty((len(x), len(c)), bool)
        for at in range(0, len(x), step := max(1, CELLS // len(c))):
            part = slice(at, at + step)
            guess[part], bound = _bounds(x[part], norm[part], c, radii, 1.0)
            reached[part] = bound >= share[part, None]
        return b.column(0)[i].as_py(), first, x, norm, floor[first[:-1]], guess, np.logical_or.reduceat(reached, first[:-1], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for b in batches:
            for i in range(len(b)):
                if (name := b.column(2)[i].as_py()) != last:
                    last, block = name, asked(b, i)
                ids, first, x, norms, floors, guess, reached = block
                names, sizes = b.column(5)[i].values, b.column(6)[i].values.to_numpy(zero_copy_only=False)
                d, under, far = (np.frombuffer(b.column(n)[i].as_buffer(), float) for n in (7, 8, 9))
                d, under = d.reshape(-1, dim), under.astype(int)
                start, longest = np.cumsum(sizes) - sizes, np.sqrt((d * d).sum(1)).max()
                out: tuple[list, list, list, list, list] = ([], [], [], [], [])
                for n, query in enumerate(ids):
                    part = slice(first[n], first[n + 1])
                    one, norm, floor = x[part], norms[part], floors[n]
                    slack = SLACK * (1 + norm * (1 + longest)).sum()
                    at = np.flatnonzero(np.logical_or.reduceat(reached[n][under], start))  # the documents met
                    n_met = len(at)
                    tokens, begin = _of(at, start, sizes)
                    if n_met and floor > -np.inf:
                        most = np.maximum.reduceat(guess[part][:, under[tokens]] + norm[:, None] * far[tokens], begin, 1).sum(0)
                        at = at[most >= floor - slack]
                        tokens, begin = _of(at, start, sizes)
                    n_scored = len(at)
                    if n_met:
                        for column, value in zip(out, (query, None, None, n_met, n_scored), strict=True):
                            column.append(value)
                    if not n_scored:
                        continue
                    score = np.maximum.reduceat(one @ d[tokens].T, begin, 1).sum(0)
                    least = max(floor, np.partition(score, n_scored - k)[n_scored - k] if n_scored > k else -np.inf)
                    near = at[score >= least - slack]
                    score = np.array([(one @ d[start[j] : start[j] + sizes[j]].T).max(1).sum() for j in near])
                    found = pa.table({"doc": names.take(pa.array(near)), "score": pa.array(score, pa.float64())})
                    found = found.take(pc.sort_indices(found, [("score", "descending"), ("doc", "ascending")])[:k]) if len(near) > k else found
                    for column, value in zip(out, ([query] * len(found), found["doc"].to_pylist(), found["score"].to_pylist(), [0] * len(found), [0] * len(found)), strict=True):
                        column.extend(value)
                types = (q_type, d_type, pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["query_id", "doc", "score", "n_met", "n_scored"])

    # every block of queries meets every block of documents, those of one block of queries after each other
    return queries.hint("shuffle_replicate_nl").crossJoin(docs).mapInArrow(run, f"query_id {kinds[0]}, doc {kinds[1]}, score double, n_met bigint, n_scored bigint")


def _of(at: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray | slice, np.ndarray]:
    """The token places of the bags ``at``, and where each bag begins among them."""
    if len(at) == len(start):
        return slice(None), start
    size = sizes[at]
    begin = np.cumsum(size) - size
    return np.repeat(start[at] - begin, size) + np.arange(size.sum()), begin


def search(index: TokenIndex, queries: DataFrame, k: int, query: str = "query_id", vector: str = "vector", n_probe: int = 8, exact: bool = True) -> DataFrame:
    """query_id, rank, doc, score, n_met, n_scored: each query's ``k`` best documents by MaxSim, ties to the smaller doc.

    ``queries`` has a row a token (query_id, vector). n_met documents were met by probes, n_scored were scored; the exact
    search counts those of its second round. With
    ``exact`` the answer is that of scoring every document; without it, documents that no first probe meets are not
    found, and bounds are those of random residuals, which few exceed. Null ids, vectors that are null or not finite and
    query vectors of another length than the index's take no part; a query without tokens has no rows; fewer than
    ``k`` documents give all of them (without ``exact``, all that were met). Repeated token rows count each.
    """
    q = _tokens(queries, query, vector).withColumnRenamed(query, "query_id")
    dim = index.centroids.shape[1]
    reach = 1.0 if exact else min(1.0, DEVIATIONS / dim**0.5)
    q = written(q.where(F.size("v") == dim).withColumn("token", F.monotonically_increasing_id()), "maxsim-queries")
    kinds = (q.schema["query_id"].dataType.simpleString(), index.postings.schema["doc"].dataType.simpleString())
    bags = q.groupBy("query_id").agg(F.collect_list("v").alias("tokens"))
    near = written(_probes(index, q, kinds[0], n_probe, reach), "maxsim-probes")
    parts = _partitions(index, near)
    met = written(_met(index, near, reach, parts), "maxsim-met")
    by_guess = Window.partitionBy("query_id").orderBy(F.desc("guess"), "doc")
    first = met.select("query_id", "doc", "guess").repartition(parts, "query_id").withColumn("n", F.row_number().over(by_guess)).where(F.col("n") <= 4 * k).select("query_id", "doc")
    scored = written(_scored(index, first, bags, kinds), "maxsim-first")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    floors = scored.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k).select("query_id", (F.col("score") - SLACK * (1 + F.abs("score"))).alias("floor"))
    if exact:
        # of the sum that the tokens' bounds leave above the floor, each token may miss an equal share of its own bound
        tops = near.groupBy("query_id", "token").agg(F.first("top").alias("top"))
        total = tops.groupBy("query_id").agg(F.sum("top").alias("all"), F.count("*").alias("n")).join(floors, "query_id", "left")
        none = F.lit(float("-inf"))
        share = tops.join(total, "query_id").select("token", F.coalesce(F.col("top") - (F.col("all") - F.col("floor")) / F.col("n"), none).alias("share"), F.coalesce("floor", none).alias("floor"))
        bags = q.join(share, "token").groupBy("query_id").agg(F.collect_list(F.struct("v", "share", "floor")).alias("t"))
        every = written(_cells(index, bags.select("query_id", F.col("t.v").alias("tokens"), F.col("t.share").alias("share"), F.col("t.floor").alias("floor")), kinds, k), "maxsim-scored")
        counts = every.groupBy("query_id").agg(F.sum("n_met").alias("n_met"), F.sum("n_scored").alias("n_scored"))
        best = every.where("doc is not null").withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        return best.select("query_id", "rank", "doc", "score").join(counts, "query_id").select("query_id", "rank", "doc", "score", "n_met", "n_scored")
    left = met.repartition(parts, "query_id").join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
    more = left.select("query_id", "doc").join(scored.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    every = written(scored.unionByName(_scored(index, more, bags, kinds)), "maxsim-scored")
    counts = met.groupBy("query_id").agg(F.count("*").alias("n_met")).join(every.groupBy("query_id").agg(F.count("*").alias("n_scored")), "query_id")
    best = every.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return best.join(counts, "query_id").select("query_id", "rank", "doc", "score", "n_met", "n_scored")
