"""Approximate nearest neighbours by collision counting.

Every vector gets m single Gaussian projections. A cell of the search holds a shard of the vectors, with one sorted
array a projection, and a block of the queries. Round by round the distance level grows by a factor; at each level a
window of that half-width is centred on the query's projection in every sorted array (virtual rehashing: the windows
only grow, the arrays stay), and a vector that falls inside windows of more projections than a threshold is verified
with its exact cosine. A query stops when its k best verified vectors lie within the level.

Where to begin and end is fitted on a bounded sample of the vectors: the distance of a query's k-th nearest in the
sample, its reach, bounds that of its k-th nearest of all, so no shard has to grow windows beyond the reach, however
few neighbours lie there, and windows begin at half of it. Queries that this leaves with fewer than k rows although
there are more candidates are searched again without a reach.

The threshold is set so that a vector at exactly the level's distance passes with probability of about 0.9; nearer
ones pass more surely. All rows are indexed; there is no cap on candidates. Every query meets every shard, so the work
grows with queries times rows, by a share that the reach makes smaller the more rows there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramma.storage import written

PROJECTIONS = 64
GROWTH = 1.3
#: Standard deviations that the threshold lies below the mean count of a vector at the level's distance.
SLACK = 1.3
#: Rows and bytes of vectors in a shard, queries in a block.
SHARD_ROWS, SHARD_BYTES = 8192, 32_000_000
BLOCK_QUERIES = 4096
#: Vectors that reaches are measured on, at most, and the share of all.
SAMPLE_ROWS, SAMPLE_SHARE = 2048, 1 / 16
#: Part of the reach at which windows begin.
BEGIN = 0.5
#: Levels reach past 2, the largest distance between unit vectors.
LEVELS = np.array([0.02 * GROWTH**i for i in range(math.ceil(math.log(2.2 / 0.02) / math.log(GROWTH)) + 1)])


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part: not null, of one component or more, all finite, not all zero."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _projections(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed + dim).standard_normal((dim, m))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would overflow or vanish, scaled by a power of two; cosines stay as they are."""
    top = np.abs(x).max(1)
    odd = (top > 1e100) | (top < 1e-100)
    if odd.any():
        x = x.copy()
        x[odd] = np.ldexp(x[odd], -np.frexp(top[odd])[1][:, None])
    return x


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _count(order: list[np.ndarray], old: tuple, new: tuple, counts: np.ndarray) -> None:
    """Adds the collisions of the parts by which the windows have grown."""
    (olo, ohi), (nlo, nhi) = old, new
    parts = [o[a:b] for o, a, b in zip(order, nlo, olo, strict=True) if b > a] + [o[a:b] for o, a, b in zip(order, ohi, nhi, strict=True) if b > a]
    if parts:
        counts += np.bincount(np.concatenate(parts), minlength=len(counts)).astype(counts.dtype)


def search_cell(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int, m: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, vector id, cosine) of the k nearest found in this shard for each query."""
    order_by = np.argsort(ids, kind="stable")
    ids, x, q = ids[order_by], _scaled(x[order_by]), _scaled(q)
    norm, qnorm = _norms(x), _norms(q)
    a = _projections(x.shape[1], m, seed)
    px, pq = (x / norm[:, None]) @ a, (q / qnorm[:, None]) @ a
    order = [np.argsort(px[:, j], kind="stable").astype(np.int32) for j in range(m)]
    arrays = [px[o, j] for j, o in enumerate(order)]
    lo = np.empty((len(LEVELS), len(q), m), np.int32)
    hi = np.empty_like(lo)
    for j in range(m):
        lo[:, :, j] = np.searchsorted(arrays[j], pq[None, :, j] - LEVELS[:, None], "left")
        hi[:, :, j] = np.searchsorted(arrays[j], pq[None, :, j] + LEVELS[:, None], "right")
    # a window of half-width r is one standard deviation of the projected distance r, so the chance is the same at every level
    p = math.erf(1 / math.sqrt(2))
    threshold = m * p - SLACK * math.sqrt(m * p * (1 - p))
    end = len(LEVELS) - 1
    out_q, out_v, out_s = [], [], []
    for t in range(len(q)):
        counts, seen = np.zeros(len(x), np.int32), np.zeros(len(x), bool)
        found, score = np.zeros(0, np.int64), np.zeros(0)
        total = (hi[:, t] - lo[:, t]).sum(1)
        last = min(int(np.searchsorted(LEVELS, reach[t])), end)
        level = int(np.searchsorted(total, threshold * k))  # before that no k vectors can pass
        if last < end:
            level = max(level, int(np.searchsorted(LEVELS, BEGIN * reach[t])))
        level = min(level, last)
        old = (lo[level, t], lo[level, t])
        need = min(k, len(x) - int((ids == qids[t]).sum()))
        while True:
            new = (lo[level, t], hi[level, t])
            _count(order, old, new, counts)
            old = new
            fresh = np.flatnonzero((counts >= threshold) & ~seen) if level < end else np.flatnonzero(~seen)
            seen[fresh] = True
            fresh = fresh[ids[fresh] != qids[t]]
            if len(fresh):
                s = (x[fresh] * q[t]).sum(1) / (norm[fresh] * qnorm[t])
                found, score = np.concatenate([found, fresh]), np.concatenate([score, s])
                best = np.lexsort((found, -score))[: 4 * k]
                found, score = found[best], score[best]
            if level >= last or (len(found) >= need and (need == 0 or math.sqrt(max(0.0, 2 - 2 * score[need - 1])) <= LEVELS[level])):
                break
            level += 1
        n = min(k, len(found))
        out_q.append(np.full(n, t))
        out_v.append(ids[found[:n]])
        out_s.append(score[:n])
    empty = [np.zeros(0)]
    return np.concatenate(out_q or empty).astype(np.int64), np.concatenate(out_v or empty).astype(np.int64), np.concatenate(out_s or empty).astype(float)


def with_reach(queries: DataFrame, vectors: DataFrame, total: int, k: int) -> DataFrame:
    """Adds ``reach`` to queries (id, v): the distance of the k-th nearest in a sample of the vectors, a little more for rounding.

    The sample, by a hash of id and vector, has at most ``SAMPLE_ROWS`` rows and goes to every task with its function;
    where it has fewer than k other vectors of the query's length the reach is infinite.
    """
    rows = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(min(SAMPLE_ROWS, int(total * SAMPLE_SHARE))).collect()
    sample = {}
    for dim in {len(r["v"]) for r in rows}:
        some = [r for r in rows if len(r["v"]) == dim]
        x = _scaled(np.array([r["v"] for r in some]))
        sample[dim] = (np.array([r["id"] for r in some]), x / _norms(x)[:, None])

    def run(batches):
        for b in batches:
            reach = []
            for qid, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                q = v.values.to_numpy()
                ids, x = sample.get(len(q), (np.zeros(0, np.int64), np.zeros((0, len(q)))))
                cos = (x @ (_scaled(q[None])[0] / _norms(_scaled(q[None]))[0]))[ids != qid]
                reach.append(math.sqrt(max(0.0, 2 - 2 * np.partition(cos, len(cos) - k)[len(cos) - k])) + 1e-6 if len(cos) >= k else math.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reach, pa.float64())], ["id", "v", "copies", "reach"])

    return queries.mapInArrow(run, "id bigint, v array<double>, copies bigint, reach double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = PROJECTIONS, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows of ``vectors`` by cosine, rows of its own id left out.

    Rows whose vector is null, zero, or has a null or non-finite component take no part, nor do null ids; vectors of
    another length than the query's are not compared with it; components of any finite size are. Ties go to the smaller
    id; rows that repeat an id are candidates one by one. Every query row is a query: one that repeats an id has its
    own ``k`` rows, ranked by themselves. Fewer candidates than ``k`` give fewer rows, empty tables none. Other columns
    are not read, whatever their names.
    """
    v = valid_vectors(vectors, id_col, vector_col)
    facts = v.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first()
    q = valid_vectors(queries, id_col, vector_col).groupBy("id", "v").agg(F.count("*").alias("copies"))
    q = written(with_reach(q, v, facts["n"], k).withColumn("key", F.xxhash64("v")), "nearest-queries")
    size = max(64, min(shard_rows, SHARD_BYTES // (8 * facts["dim"])))
    shards = max(1, -(-facts["n"] // size))
    found = written(_cells(q, v, shards, max(1, -(-q.count() // block_queries)), k, projections, seed), "nearest-found")
    had = found.groupBy("query_id", "key").agg(F.count("*").alias("had"))
    # few queries, if any: all others have k rows
    short = q.join(had, (q.id == had.query_id) & (q.key == had.key), "left").where((F.coalesce("had", F.lit(0)) < k) & (q.reach != math.inf)).select(q.id, "v", "copies", F.lit(math.inf).alias("reach"), q.key)
    short = written(short, "nearest-short")
    again = short.count()
    if again:
        found = found.join(short.select(F.col("id").alias("query_id"), "key"), ["query_id", "key"], "left_anti").unionByName(_cells(short, v, shards, max(1, -(-again // block_queries)), k, projections, seed))
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("query_id", "rank", "vec_id", "score")


def _cells(q: DataFrame, v: DataFrame, shards: int, blocks: int, k: int, projections: int, seed: int) -> DataFrame:
    """query_id, key, copies, vec_id, score: what each shard finds for each query."""
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    v = v.withColumn("shard", deal(shards)).withColumn("block", every(blocks)).withColumn("key", F.lit(0).cast("long")).withColumn("copies", F.lit(0).cast("long")).withColumn("reach", F.lit(0.0)).withColumn("is_query", F.lit(False))
    q = q.withColumn("block", deal(blocks)).withColumn("shard", every(shards)).withColumn("is_query", F.lit(True))
    cols = ["shard", "block", F.size("v").alias("dim"), "id", "v", "key", "copies", "reach", "is_query"]
    cells = v.select(*cols).unionByName(q.select(*cols)).groupBy("shard", "block", "dim")

    def run(t: pa.Table) -> pa.Table:
        number = lambda c: t.column(c).to_numpy()
        ids, is_q = number("id"), t.column("is_query").to_numpy(zero_copy_only=False)
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), t.column("dim")[0].as_py())
        place, vec, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if is_q.any() and not is_q.all():
            place, vec, score = search_cell(ids[~is_q], x[~is_q], ids[is_q], x[is_q], number("reach")[is_q], k, projections, seed)
        return pa.table({"query_id": ids[is_q][place], "key": number("key")[is_q][place], "copies": number("copies")[is_q][place], "vec_id": vec, "score": score})

    return cells.applyInArrow(run, "query_id bigint, key bigint, copies bigint, vec_id bigint, score double")
