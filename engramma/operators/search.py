"""Ranking: BM25, exact vector search, fusion of ranked lists, caps, boosts and decay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.functions.text import tokens
from engramma.storage import written

K1, B = 1.2, 0.75
#: Terms of all queries that may be broadcast: 50 MB at most.
BROADCAST_TERMS = 500_000


#: Scores that a task has at a time: documents of a part by queries. Fewer than this apart, scores may be equal when rounded.
SCORES, ALIKE = 1 << 20, 2e-6


def bm25(docs: DataFrame, queries: DataFrame, key: str, fields: dict[str, float], query_id: str = "query_id", query: str = "query", k1: float = K1, b: float = B, k: int | None = None, windowed: bool = False) -> DataFrame:
    """(query_id, key, score): BM25 of every query over every document that shares a term; fields' scores add by weight.

    With ``k`` only what can be among a query's ``k`` best, scores rounded to six places or more. ``windowed`` queries
    (platform, since, until) only see rows (platform, at) of their platform and window, null bounds being none. Queries
    of few enough terms then meet the documents in the tasks that hold these, and no row is made for a document and a
    query but where it may be kept; otherwise a row for each is made, joined by term.
    """
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query)))).alias("term")).distinct()
    if k is not None:
        terms = written(terms, "bm25-asked")
        found = _bm25_best(docs, queries, terms, key, fields, query_id, k1, b, k, windowed) if terms.count() <= BROADCAST_TERMS else None
        if found is not None:
            return found
    out = _bm25_joined(docs, terms, key, fields, k1, b)
    return seen(out, docs, queries.withColumnRenamed(query_id, "query_id"), key) if windowed else out


def seen(scored: DataFrame, docs: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Rows (query_id, key, score) whose document is of the query's platform and in its window; unknown times are in none."""
    have = docs.select(key, F.col("platform").alias("__platform"), F.col("at").alias("__at"))
    j = scored.join(queries.select("query_id", F.col("platform").alias("__want"), "since", "until"), "query_id").join(have, key)
    ok = (F.col("__want").isNull() | (F.col("__want") == F.col("__platform"))) & (F.col("since").isNull() | (F.col("__at") >= F.col("since"))) & (F.col("until").isNull() | (F.col("__at") < F.col("until")))
    return j.where(ok).select(*scored.columns)


def _bm25_best(docs: DataFrame, queries: DataFrame, terms: DataFrame, key: str, fields: dict[str, float], query_id: str, k1: float, b: float, k: int, windowed: bool) -> DataFrame | None:
    """What may be among the ``k`` best by BM25, without a row for each document and query; None if keys are null or not distinct.

    Each field is cut into words once, and of every document its length and the numbers of the asked terms that it holds
    are written, with how often. A task scores its documents for all queries and keeps each query's best.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type

    asked = terms.orderBy("query_id", "term").collect()  # BROADCAST_TERMS at most
    ids = sorted({r["query_id"] for r in asked if r["query_id"] is not None})
    words = sorted({r["term"] for r in asked})
    number, place = {w: n for n, w in enumerate(words)}, {i: n for n, i in enumerate(ids)}
    pairs = np.array(sorted((number[r["term"]], place[r["query_id"]]) for r in asked if r["query_id"] is not None), np.int64).reshape(-1, 2)
    ends, of_query = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1].copy()
    known = pa.array(words, pa.string())
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    limits = {}
    if windowed:
        for r in queries.select(query_id, F.col("platform").cast("string"), micros("since"), micros("until")).join(terms.select(F.col("query_id").alias(query_id)).distinct(), query_id).collect():
            limits[place[r[0]]] = tuple(r)[1:]
    rest = [F.col("platform").cast("string").alias("platform"), micros("at").alias("at")] if windowed else []
    names = [f"{c}{n}" for n in range(len(fields)) for c in ("len", "terms", "tfs")]
    id_type, n_rest = queries.schema[query_id].dataType, len(rest)

    def held(batches):
        for batch in batches:
            cols = list(batch.columns[: 1 + n_rest])
            for col in batch.columns[1 + n_rest :]:
                sizes = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                at = pc.index_in(col.flatten(), value_set=known)
                row = np.repeat(np.arange(len(batch)), sizes)[pc.is_valid(at).to_numpy(zero_copy_only=False)]
                code, tf = np.unique(row * max(1, len(words)) + at.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
                row, term = code // max(1, len(words)), code % max(1, len(words))
                begin = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(begin, pa.array(x.astype(np.int32))) for x in (term, tf)]
                cols += [pa.array(sizes), *lists]
            yield pa.RecordBatch.from_arrays(cols, [key, *(["platform", "at"] if windowed else []), *names])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}{', platform string, at bigint' if windowed else ''}" + "".join(f", len{n} bigint, terms{n} array<int>, tfs{n} array<int>" for n in range(len(fields)))
    texts = docs.select(key, *rest, *(tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"w{n}") for n, f in enumerate(fields)))
    t = written(texts.mapInArrow(held, schema), "bm25-held")
    stats = t.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), *(F.avg(f"len{n}").alias(f"avg{n}") for n in range(len(fields)))).first()
    if stats["n"] != stats["keys"]:
        return None
    idf = []
    for n in range(len(fields)):
        df = np.zeros(len(words))
        for r in t.select(F.explode(f"terms{n}").alias("term")).groupBy("term").count().collect():  # a row a term
            df[r["term"]] = r["count"]
        idf.append(np.log(1 + (stats["n"] - df + 0.5) / (df + 0.5)))
    averages, weights = [stats[f"avg{n}"] for n in range(len(fields))], [float(w) for w in fields.values()]
    step = max(1, SCORES // max(1, len(ids)))
    b_type = to_arrow_type(id_type)

    def added(score, batch, n: int) -> None:
        """Adds the scores of a field to those of documents by queries."""
        length, term, tf = (batch.column(1 + n_rest + 3 * n + j) for j in range(3))
        row = np.repeat(np.arange(len(batch)), term.value_lengths().to_numpy(zero_copy_only=False))
        length = length.to_numpy(zero_copy_only=False)[row]
        term, tf = term.flatten().to_numpy(zero_copy_only=False), tf.flatten().to_numpy(zero_copy_only=False)
        part = weights[n] * idf[n][term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / averages[n])) if len(term) else np.zeros(0)
        size = ends[term + 1] - ends[term]
        cuts = np.append(np.flatnonzero(np.diff((np.cumsum(size) - size) // SCORES, prepend=-1)), len(size))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s = size[lo:hi]
            to = of_query[np.repeat(ends[term[lo:hi]] - (np.cumsum(s) - s), s) + np.arange(s.sum())]
            score += np.bincount(np.repeat(row[lo:hi], s) * len(ids) + to, np.repeat(part[lo:hi], s), score.size).reshape(score.shape)

    def best(batches):
        for whole in batches:
            for batch in (whole.slice(at, step) for at in range(0, len(whole), step)):
                score = np.zeros((len(batch), len(ids)))
                for n in range(len(weights)):
                    added(score, batch, n)
                if windowed:
                    platform = np.array(batch.column(1).to_pylist(), object)
                    when = batch.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False)  # unknown times are NaN
                    for q, limit in limits.items():
                        if limit != (None, None, None):
                            score[~_inside(platform, when, *limit), q] = 0
                least = np.partition(score, len(batch) - k, 0)[len(batch) - k] - ALIKE if len(batch) > k else np.full(len(ids), -np.inf)
                row, q = np.nonzero((score > 0) & (score >= least))
                yield pa.RecordBatch.from_arrays([pa.array(ids, b_type).take(pa.array(q)), batch.column(0).take(pa.array(row)), pa.array(score[row, q])], ["query_id", key, "score"])

    return t.mapInArrow(best, f"query_id {id_type.simpleString()}, `{key}` {kind}, score double")


def _bm25_joined(docs: DataFrame, terms: DataFrame, key: str, fields: dict[str, float], k1: float, b: float) -> DataFrame:
    """BM25 of every pair that shares a term; each field is cut into words once.

    What is written is a row for each document with its length, and one for each of the queries' terms that it holds;
    everything else is counted from that.
    """
    wanted = written(terms.select("term").distinct().withColumn("asked", F.lit(True)), "bm25-terms")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted
    out = None
    for field, weight in fields.items():
        words = docs.select(F.col(key), tokens(F.coalesce(F.col(field), F.lit(""))).alias("ws")).select(key, F.size("ws").alias("len"), F.explode_outer("ws").alias("term"))
        # the first row of each document, whatever its term, tells of its length
        held = words.join(wanted, "term", "left").groupBy(key, "len", F.when(F.col("asked"), F.col("term")).alias("term")).agg(F.count("*").alias("tf"))
        held = written(held, "bm25-held")
        lengths = held.groupBy(key).agg(F.max("len").alias("len"))
        stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
        post = held.where("term is not null")
        df = post.groupBy("term").agg(F.count("*").alias("df"))
        s = post.join(df, "term").crossJoin(F.broadcast(stats)).join(terms, "term")
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
        s = s.select("query_id", key, (part * F.lit(float(weight))).alias("p"))
        out = s if out is None else out.unionByName(s)
    return out.groupBy("query_id", key).agg(F.sum("p").alias("score"))


def top_k(scored: DataFrame, k: int, score: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """The k best rows, of each group if ``by`` is given, with their rank from 1."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie)) if by else Window.orderBy(F.desc(score), F.asc(tie))
    pre = scored if by else scored.orderBy(F.desc(score), F.asc(tie)).limit(k)  # a global rank only over k rows
    return pre.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Queries that go to every task at a time, and their bytes at most.
QUERY_BLOCK, QUERY_BYTES = 4096, 64_000_000
#: Vectors in a block of ``cosine_counts``.
VECTOR_BLOCK = 1024


def cosine_pairs(vectors: DataFrame, queries: DataFrame, key: str, vector: str = "embedding", k: int | None = None, floor: float | None = None, windowed: bool = False) -> DataFrame:
    """(query_id, key, similarity) of queries (query_id, qv) with all rows: pairs of at least ``floor``, and of them what can be among a query's ``k`` best.

    Queries are taken in blocks of bounded size, a pass over the vectors each; a batch of vectors meets a block in
    numpy and keeps its own best. A zero vector's cosine is 0; null vectors and other lengths than the query's take no
    part. ``windowed`` queries (platform, since, until) only see rows (platform, at) of their platform and window, null
    bounds being none; rows outside are left out before the best are kept.
    """
    import numpy as np
    import pyarrow as pa

    kind = {n: vectors.schema[key].dataType.simpleString() if n == key else queries.schema[n].dataType.simpleString() for n in ("query_id", key)}
    schema = f"query_id {kind['query_id']}, {key} {kind[key]}, similarity double"
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    v = vectors.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"), *([F.col("platform").cast("string"), micros("at").alias("at")] if windowed else []))
    q = queries.where("qv is not null").select("query_id", F.col("qv").cast("array<double>").alias("qv"), *([F.col("platform").cast("string"), micros("since").alias("since"), micros("until").alias("until")] if windowed else []))
    dim = q.agg(F.coalesce(F.max(F.size("qv")), F.lit(1)).alias("d")).first()["d"]
    block = max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * max(1, dim))))

    def pass_over(ids: list, qs: list[list[float]], bounds: list[tuple]) -> DataFrame:
        by_len: dict[int, tuple[list, np.ndarray, np.ndarray, list[tuple]]] = {}
        for n in {len(x) for x in qs}:
            rows = [i for i, x in enumerate(qs) if len(x) == n]
            m = np.array([qs[i] for i in rows], float).reshape(len(rows), n)
            by_len[n] = ([ids[i] for i in rows], m, np.sqrt((m * m).sum(1)), [bounds[i] for i in rows])

        def run(batches):
            for b in batches:
                sizes = np.array([len(x) for x in b.column(1)])
                for n, (names, m, norms, limits) in by_len.items():
                    at = np.flatnonzero(sizes == n)
                    if not len(at) or not n:
                        continue
                    keys = b.column(0).take(pa.array(at))
                    x = b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
                    norm = np.sqrt((x * x).sum(1))
                    platform = np.array(b.column(2).take(pa.array(at)).to_pylist(), object) if windowed else None
                    when = b.column(3).take(pa.array(at)).cast(pa.float64()).to_numpy(zero_copy_only=False) if windowed else None  # unknown times are NaN
                    for name, one, length, limit in zip(names, m, norms, limits, strict=True):
                        both = norm * length
                        s = np.divide((x * one).sum(1), both, out=np.zeros(len(at)), where=both != 0)
                        seen = np.ones(len(at), bool) if floor is None else s >= floor
                        if windowed:
                            seen &= _inside(platform, when, *limit)
                        keep = np.flatnonzero(seen)
                        if k is not None and len(keep) > k:  # ties of the k-th stay, the caller decides
                            keep = keep[s[keep] >= np.partition(s[keep], len(keep) - k)[len(keep) - k]]
                        if len(keep):
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keep), b_type), keys.take(pa.array(keep)), pa.array(s[keep])], ["query_id", key, "similarity"])

        return v.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    b_type = to_arrow_type(queries.schema["query_id"].dataType)
    out, ids, qs, bounds = None, [], [], []
    for r in q.toLocalIterator():
        ids.append(r["query_id"])
        qs.append(list(r["qv"]))
        bounds.append((r["platform"], r["since"], r["until"]) if windowed else ())
        if len(ids) == block:
            out, ids, qs, bounds = (pass_over(ids, qs, bounds) if out is None else out.unionByName(pass_over(ids, qs, bounds))), [], [], []
    if ids or out is None:
        out = pass_over(ids, qs, bounds) if out is None else out.unionByName(pass_over(ids, qs, bounds))
    return out


def cosine_counts(vectors: DataFrame, queries: DataFrame, edges: Sequence[float], vector: str = "embedding") -> DataFrame:
    """(query_id, bin, n): of every query (query_id, qv), how many rows have a cosine between the edges, a bin being the number of edges that it reaches.

    Blocks of queries meet blocks of rows, and a meeting leaves a row for each query and bin. A zero vector's cosine is
    0; null vectors and other lengths than the query's take no part.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    q_type, limits = to_arrow_type(queries.schema["query_id"].dataType), np.sort(np.array(edges, float))
    kind = queries.schema["query_id"].dataType.simpleString()

    def blocks(batches):
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == n)
                for part in (at[i : i + VECTOR_BLOCK] for i in range(0, len(at), VECTOR_BLOCK)):
                    x = b.column(1).take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), n)
                    norm = np.sqrt((x * x).sum(1))[:, None]
                    x = np.divide(x, norm, out=np.zeros_like(x), where=norm != 0)
                    ids = pa.array([b.column(0).take(pa.array(part)).to_pylist()], pa.list_(b.column(0).type))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([int(n)], pa.int32()), pa.array([x.tobytes()])], ["ids", "dim", "packed"])

    def counted(batches):
        for b in batches:
            for i in range(len(b)):
                ids, n = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if n != b.column(3)[i].as_py():
                    continue
                q, x = (np.frombuffer(b.column(c)[i].as_buffer(), float).reshape(-1, n) for c in (2, 4))
                s = q @ x.T
                reached = np.stack([np.full(len(q), len(x)), *((~(s < e)).sum(1) for e in limits), np.zeros(len(q), int)], 1)
                row, at = np.nonzero(each := reached[:, :-1] - reached[:, 1:])
                yield pa.RecordBatch.from_arrays([pa.array(ids, q_type).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(each[row, at])], ["query_id", "bin", "n"])

    doubles = lambda c: F.col(c).cast("array<double>").alias("v")
    q = queries.where("qv is not null").select("query_id", doubles("qv")).mapInArrow(blocks, f"ids array<{kind}>, dim int, packed binary")
    v = vectors.where(F.col(vector).isNotNull()).select(F.lit(0).alias("i"), doubles(vector)).mapInArrow(blocks, "ids array<int>, dim int, packed binary")
    v = v.select(F.col("dim").alias("dim2"), "packed").toDF("dim2", "packed2").repartition(4 * vectors.sparkSession.sparkContext.defaultParallelism)
    met = written(q, "cosine-queries").hint("shuffle_replicate_nl").crossJoin(v).mapInArrow(counted, f"query_id {kind}, bin int, n bigint")
    return met.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))


def _inside(platform, when, want: str | None, since: int | None, until: int | None):
    """Which rows of a batch are of a platform and in a window."""
    import numpy as np

    ok = np.ones(len(platform), bool)
    if want is not None:
        ok &= platform == want
    if since is not None:
        ok &= when >= since
    if until is not None:
        ok &= when < until
    return ok


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", floor: float | None = None) -> DataFrame:
    """(query_id, key, similarity, rank): exact nearest rows by cosine for a table of queries (query_id, qv).

    ``floor`` is the least certainty, (1 + cosine) / 2.
    """
    s = cosine_pairs(vectors, queries, key, vector, k, None if floor is None else 2 * floor - 1)
    return top_k(s, k, "similarity", key, ["query_id"])


def rrf(lists: DataFrame, key: str, k: int = 60, rank_base: int = 1, query: str = "query_id") -> DataFrame:
    """Reciprocal rank fusion of rows (query_id, lane, key, rank from 1, weight); a key repeated in a lane counts each time."""
    part = F.col("weight") / (F.lit(k) + F.col("rank") - 1 + rank_base)
    return lists.groupBy(query, key).agg(F.sum(part).alias("score"), F.min("rank").alias("best_rank"), F.count("*").alias("n_lists"))


def relative_fusion(vec: DataFrame, lex: DataFrame, key: str, alpha: float | DataFrame, query: str = "query_id") -> DataFrame:
    """alpha * vector + (1 - alpha) * BM25 of two scored lists, each stretched to 0..1 a query; a missing side is 0.

    ``alpha`` is one number, or a table (query, alpha).
    """

    def stretched(d: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(query)
        lo, hi = F.min("score").over(w), F.max("score").over(w)
        return d.select(query, key, F.when(hi == lo, F.lit(1.0)).otherwise((F.col("score") - lo) / (hi - lo)).alias(name))

    j = stretched(vec, "v").join(stretched(lex, "l"), [query, key], "full")
    share = F.lit(alpha) if not isinstance(alpha, DataFrame) else F.col("alpha")
    j = j if not isinstance(alpha, DataFrame) else j.join(alpha.select(query, "alpha"), query)
    return j.select(query, key, (share * F.coalesce("v", F.lit(0.0)) + (1 - share) * F.coalesce("l", F.lit(0.0))).alias("score"))


#: Vector share by kind of query.
ALPHA = {"exact": 0.3, "temporal": 0.3, "conceptual": 0.65, "relational": 0.5, "motif": 0.6, "default": 0.65}
# The stop words of exact queries.
STOP_WORDS = "the a an is are was were be in on at to for of with by from as into about equals equal divided between and or not but".split()


def exact_alpha(query: Column) -> Column:
    """The vector share of an exact query grows with its share of stop words: min(0.3 + 0.7 * share, 0.65)."""
    words = F.regexp_extract_all(F.lower(query), F.lit("([a-z]+)"), F.lit(1))
    share = F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))) / F.size(words)
    return F.when(F.size(words) == 0, F.lit(0.3)).otherwise(F.least(F.lit(0.65), 0.3 + 0.7 * share))


def keep_first(ranked: DataFrame, content_hash: str, key: str, rank: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """The first row of each content hash by rank, then key; a blank hash stands for the row itself.

    Copies are reduced before they are shuffled, so a hash that many rows share is no hot task.
    """
    group = F.coalesce(F.nullif(F.col(content_hash), F.lit("")), F.concat(F.lit("id:"), F.col(key).cast("string")))
    row = F.struct(*(F.col(f"`{c}`") for c in ranked.columns))
    firsts = ranked.groupBy(*(F.col(c).alias(f"__{c}") for c in by), group.alias("__g")).agg(F.min_by(row, F.struct(rank, key)).alias("__r"))
    return firsts.select("__r.*")


def pool_cap(pool: DataFrame, fetch_k: int, top: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Cuts a pool (lane_order, rank, is_extra) to ``fetch_k``: base rows give way to extra ones, down to ``top``."""
    g = Window.partitionBy(*by)
    extra = F.sum(F.col("is_extra").cast("int")).over(g)
    keep = F.when(F.count("*").over(g) > fetch_k, F.greatest(F.lit(fetch_k) - extra, F.lit(top))).otherwise(F.lit(2**31 - 1))
    p = pool.withColumn("__keep", keep).withColumn("__base", F.sum((~F.col("is_extra")).cast("int")).over(g.orderBy("lane_order", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    p = p.where(F.col("is_extra") | (F.col("__base") <= F.col("__keep")))
    return p.withColumn("__rn", F.row_number().over(g.orderBy("lane_order", "rank"))).where(F.col("__rn") <= fetch_k).drop("__keep", "__base", "__rn")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def blended(score: Column, fresh: Column, weight: float) -> Column:
    return (1 - weight) * score + weight * fresh


def formula_rank_score(score: Column, rosetta_cos: Column, query_motifs: Column, tile_motifs: Column, rosetta_weight: float = 0.3, motif_weight: float = 0.2) -> Column:
    overlap = F.when(F.size(query_motifs) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query_motifs, tile_motifs)) / F.size(query_motifs))
    return score * (1 - rosetta_weight - motif_weight) + rosetta_weight * rosetta_cos + motif_weight * overlap


_EQUAL = ("platform", "source_type", "scale", "session_id", "document_id", "content_hash", "model", "layer", "has_artifacts", "has_thinking", "hmm_enriched", "hmm_consensus", "lang", "source")
_LEAST = {"min_priority": "priority", "min_phi": "hmm_phi", "min_trust": "hmm_trust"}


def where_filter(**conditions) -> Column:
    """All given conditions at once: equalities by column name, least values, motifs (any of), after (inclusive) and before.

    An unknown name is an error; None leaves a condition out.
    """
    cond = F.lit(True)
    for name, value in conditions.items():
        if value is None:
            continue
        if name in _EQUAL:
            cond &= F.col(name) == F.lit(value)
        elif name in _LEAST:
            cond &= F.col(_LEAST[name]) >= F.lit(value)
        elif name == "motifs":
            cond &= F.arrays_overlap(F.col("dominant_motifs"), F.array(*map(F.lit, value)))
        elif name == "after":
            cond &= F.col("timestamp") >= F.lit(value)
        elif name == "before":
            cond &= F.col("timestamp") < F.lit(value)
        else:
            raise ValueError(f"unknown filter {name!r}")
    return cond


def motif_edges(assignments: DataFrame, motif_id: str, key: str, least: float = 0.5, limit: int = 20) -> DataFrame:
    """The strongest ``limit`` rows of one motif with at least an amplitude, strongest first."""
    return assignments.where((F.col("motif_id") == motif_id) & (F.col("amp") >= least)).orderBy(F.desc("amp"), key).limit(limit)


def motifs_together(assignments: DataFrame, motifs: Sequence[str], key: str, least: float = 0.3) -> DataFrame:
    """(key, total): rows that have every one of the motifs with at least an amplitude, and the sum of those."""
    a = assignments.where(F.col("motif_id").isin(list(motifs)) & (F.col("amp") >= least))
    return a.groupBy(key).agg(F.count_distinct("motif_id").alias("n"), F.sum("amp").alias("total")).where(F.col("n") == len(set(motifs))).select(key, "total")


def oldest_first(ranked: DataFrame, at: str, key: str, limit: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """How something evolved: of twice ``limit`` best results the oldest ``limit``, with their place; unknown times come first, as time 0."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_first(at), key)
    best = ranked.where(F.col("rank") <= 2 * limit)
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def tile_resonance(tokens_a: Column, full: int = 4096) -> Column:
    """How near a passage's size is to a full one, times 0.809."""
    return F.least(tokens_a, F.lit(full)) / F.greatest(tokens_a, F.lit(full)) * 0.809


def theme_of(queries: DataFrame, themes: DataFrame, least: float = 0.6) -> DataFrame:
    """(query_id, theme_id, motifs): each query's nearest theme (theme_id, tv, motifs) if its certainty, (1 + cosine) / 2, is high enough."""
    s = cosine_pairs(queries.withColumnRenamed("query_id", "q"), themes.select(F.col("theme_id").alias("query_id"), F.col("tv").alias("qv")), "q", "qv", floor=2 * least - 1)
    best = s.groupBy("q").agg(F.min_by("query_id", F.struct(-F.col("similarity"), "query_id")).alias("theme_id"))
    return best.join(themes.select("theme_id", "motifs"), "theme_id").select(F.col("q").alias("query_id"), "theme_id", "motifs")


def theme_index(vectors: DataFrame, themes: DataFrame, key: str, content_hash: str, vector: str = "embedding", least: float = 0.55) -> DataFrame:
    """(theme_id, content_hash, score): every content near enough to one of a theme's vectors (theme_id, tv), at its best certainty."""
    s = cosine_pairs(vectors, themes.select(F.col("theme_id").alias("query_id"), F.col("tv").alias("qv")), key, vector, floor=2 * least - 1)
    return s.join(vectors.select(key, content_hash), key).groupBy(F.col("query_id").alias("theme_id"), content_hash).agg(F.max((1 + F.col("similarity")) / 2).alias("score"))
