"""Exact top-k by inner product with block-at-a-time pruning.

Candidates are put in ranges of an order that keeps like vectors together: each belongs to the
cluster of its nearest pivot, and a cluster is dealt to shards of bounded size. In a shard blocks
hold a range of such an order again, with the extremes of each term (vector component) and a
forward index of their vectors. For a query, a block's bound is the sum over terms of the most
that the block's extremes allow; blocks are scored in order of bound until it falls below the
k-th score found. Clusters are pruned likewise: a query first searches the shards of its own
cluster, and then goes only to clusters whose bound reaches the k-th score found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.work import saved

#: Candidates of a shard and queries of a chunk, about; a task holds one of each.
SHARD_VECTORS = 8_192
CHUNK_QUERIES = 16_384
#: Queries that are worked through side by side in a task.
LOT_QUERIES = 1_024
#: Most clusters; pivots are the vectors of smallest hash. The bounds of all clusters are of a fixed size.
PIVOTS = 256
BLOCK_VECTORS = 32


def valid(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def largest_component(width: int) -> int:
    """Up to this size of all components every score fits into 64 bits."""
    return min((1 << 31) - 1, int(((1 << 62) // max(width, 1)) ** 0.5))


def quantise(vector: Column, scale: float, most: int) -> Column:
    """floor(scale * x) of each component x, as a double; beyond ``most`` it is ``most``."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.lit(scale) * x.cast("double")))).cast("int"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    lengths = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    out = np.zeros((len(column), width), np.int64)
    flat = np.asarray(column.flatten())
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _order(x: np.ndarray) -> np.ndarray:
    """An order that puts vectors near the same pivots side by side."""
    n = len(x)
    pivots = x[:: max(1, n // max(1, int(n**0.5)))].astype(np.float32)
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-6)
    return np.argsort(np.argmax(x.astype(np.float32) @ pivots.T, axis=1), kind="stable")


def search_shard(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, block: int = BLOCK_VECTORS, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, row of the shard, score) of each query's k best of a shard, and how many (query, block) pairs were scored.

    Ties go to the smaller id; a query's own id is no candidate. Scores below ``least`` are not sought.
    """
    most = max((np.abs(x).max(initial=0) * np.abs(q).max(initial=0)), 1) * max(x.shape[1], 1)
    kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
    n, width = x.shape
    order = _order(x)
    ids, x = ids[order], x[order].astype(np.int64)
    blocks_n = -(-n // block)
    pad = blocks_n * block - n
    forward = np.concatenate([x, np.zeros((pad, width), x.dtype)]).astype(kind).reshape(blocks_n, block, width)
    held = np.concatenate([np.ones(n, bool), np.zeros(pad, bool)]).reshape(blocks_n, block)
    names = np.concatenate([ids, np.zeros(pad, ids.dtype)]).reshape(blocks_n, block)
    high = np.where(held[:, :, None], forward, np.iinfo(np.int32).min if kind != np.int64 else np.iinfo(np.int64).min).max(axis=1).astype(kind)
    low = np.where(held[:, :, None], forward, np.iinfo(np.int32).max if kind != np.int64 else np.iinfo(np.int64).max).min(axis=1).astype(kind)
    # Blocks hold like vectors; a rank among all ids breaks ties.
    rank = np.empty(n + pad, np.int64)
    rank[np.argsort(np.concatenate([ids, np.full(pad, np.iinfo(np.int64).max)]), kind="stable")] = np.arange(n + pad)
    rank = rank.reshape(blocks_n, block)
    qk = q.astype(kind)
    bounds = np.maximum(qk, 0) @ high.T + np.minimum(qk, 0) @ low.T
    visit = np.argsort(-bounds, axis=1, kind="stable")
    m = len(q)
    none = np.iinfo(np.int64).min
    best = np.full((m, k), none)
    best_rank = np.full((m, k), np.iinfo(np.int64).max)
    by_rank = np.concatenate([order, np.zeros(pad, order.dtype)])[np.argsort(rank.ravel(), kind="stable")]
    active, scored = np.arange(m), 0
    least = np.full(m, none) if least is None else least
    for step in range(blocks_n):
        at = visit[active, step]
        go = bounds[active, at] >= np.maximum(best[active, k - 1], least[active])
        active, at = active[go], at[go]
        if not len(active):
            break
        scored += len(active)
        scores = np.matmul(forward[at], qk[active][:, :, None])[:, :, 0].astype(np.int64)
        ok = held[at] & (names[at] != qids[active][:, None])
        scores = np.where(ok, scores, none)
        better = scores.max(axis=1) >= np.maximum(best[active, k - 1], least[active])
        some, scores, ok, at = active[better], scores[better], ok[better], at[better]
        s = np.concatenate([best[some], scores], axis=1)
        r = np.concatenate([best_rank[some], np.where(ok, rank[at], np.iinfo(np.int64).max)], axis=1)
        take = np.lexsort((r, -np.maximum(s, none + 1)), axis=1)[:, :k]
        best[some] = np.take_along_axis(s, take, 1)
        best_rank[some] = np.take_along_axis(r, take, 1)
    found = best > none
    return np.repeat(np.arange(m), found.sum(axis=1)), by_rank[best_rank[found]], best[found], scored


def _clusters(pivots: np.ndarray, width: int):
    """Adds the cluster of each row: that of the pivot with the largest product per length."""
    scaled = pivots.astype(np.float32)
    scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x @ scaled.T).argmax(axis=1).astype(np.int32))], [*batch.schema.names, "cluster"])

    return run


def _extremes(width: int):
    """Rows of (cluster, count, high, low): one a cluster and task. Takes vectors or rows of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            cluster = np.asarray(batch.column(0))
            count, high, low = np.asarray(batch.column(1)), _matrix(batch.column(2), width), _matrix(batch.column(3), width)
            for c in np.unique(cluster):
                of = cluster == c
                n, hi, lo = int(count[of].sum()), high[of].max(axis=0), low[of].min(axis=0)
                was = held.get(int(c))
                held[int(c)] = [n, hi, lo] if was is None else [was[0] + n, np.maximum(was[1], hi), np.minimum(was[2], lo)]
        if held:
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), *[pa.array([v[k].astype(np.int32) for v in held.values()], kind) for k in (1, 2)]], ["cluster", "count", "high", "low"])

    return run


def _reached(high: np.ndarray, low: np.ndarray, width: int):
    """(query_id, qkey, v, kth, cluster) for every other cluster whose bound reaches the query's k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(2), width).astype(np.float64)
            # Sums of whole numbers; where they may be rounded, a bound is a little higher.
            bounds = (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)
            slack = (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T) * 1e-12
            kth = batch.column(3).fill_null(np.iinfo(np.int64).min)
            go = bounds + slack >= np.asarray(kth)[:, None].astype(np.float64)
            go[np.arange(len(q)), np.asarray(batch.column(4))] = False
            row, cluster = np.nonzero(go)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(4)), pa.array(cluster.astype(np.int32))], ["query_id", "qkey", "v", "kth", "cluster"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products over all vectors but its own.

    Components are floor(scale * x); a missing one counts as 0, and beyond what keeps every score
    in 64 bits (2^28 with 64 components) it is that bound. Vectors that are null or hold a null or
    non-finite component, and null ids, take no part. Rows of the query's id are its own. Candidate
    rows that repeat count each; a query that repeats is asked once, and one id with several vectors
    asks each. Ties go to the smaller id. Fewer than k candidates give as many rows.
    """
    clean = lambda d, most: d.where(valid(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), quantise(F.col(vector), scale, most).alias("v"))
    width = max(vectors.agg(F.max(F.size(vector))).first()[0] or 0, queries.agg(F.max(F.size(vector))).first()[0] or 0, 1)
    most = largest_component(width)
    rows = saved(clean(vectors, most).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n")), "vectors")
    size = rows.count()
    pivots = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(max(1, min(PIVOTS, -(-size // SHARD_VECTORS)))).collect()
    centres = np.zeros((max(len(pivots), 1), width))
    for i, r in enumerate(pivots):
        centres[i, : len(r["v"])] = r["v"]
    placed = saved(rows.select("id", "v", "n").mapInArrow(_clusters(centres, width), "id long, v array<int>, n long, cluster int"), "placed")
    extremes = "cluster int, count long, high array<int>, low array<int>"
    parts = placed.select("cluster", F.lit(1).cast("long").alias("count"), F.col("v").alias("high"), F.col("v").alias("low")).mapInArrow(_extremes(width), extremes)
    stats = parts.repartition("cluster").mapInArrow(_extremes(width), extremes).collect()
    n_shards, high, low = [0] * len(centres), np.full(centres.shape, -(1 << 32)), np.full(centres.shape, 1 << 32)
    for r in stats:
        n_shards[r["cluster"]], high[r["cluster"]], low[r["cluster"]] = -(-r["count"] // SHARD_VECTORS), r["high"], r["low"]
    bases = np.concatenate([[0], np.cumsum(n_shards)])
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cluster") + 1)
    docs = placed.select((of(bases[:-1]) + F.pmod(F.xxhash64("id", "v"), F.greatest(of(n_shards), F.lit(1)))).cast("int").alias("shard"), "id", "v", "n")

    asked = clean(queries, most).distinct()
    homes = asked.select("id", "v").mapInArrow(_clusters(centres, width), "id long, v array<int>, cluster int").select(F.col("id").alias("query_id"), F.xxhash64("v").alias("qkey"), "v", "cluster")
    homes = saved(homes, "asked")
    chunks = max(1, -(-homes.count() // CHUNK_QUERIES))

    def run(d: pa.Table, q: pa.Table) -> pa.Table:
        names, x = np.asarray(d.column("id")), _matrix(d.column("v").combine_chunks(), width) if d.num_rows else None
        out = []
        for lot in range(0, q.num_rows if d.num_rows else 0, LOT_QUERIES):
            part = q.slice(lot, LOT_QUERIES).combine_chunks()
            kth = np.asarray(part.column("kth").fill_null(np.iinfo(np.int64).min))
            at, row, score, _ = search_shard(names, x, np.asarray(part.column("query_id")), _matrix(part.column("v").combine_chunks(), width), k, least=kth)
            took, found = part.take(pa.array(at)), d.take(pa.array(row))
            out.append(pa.table({"query_id": took.column("query_id"), "qkey": took.column("qkey"), "vec_id": found.column("id"), "score": pa.array(score, pa.int64()), "n": found.column("n")}))
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "qkey", "vec_id", "score", "n")})
        return pa.concat_tables(out) if out else empty

    def searched(sought: DataFrame) -> DataFrame:
        """Results of queries in the shards of the cluster beside them."""
        last = of(bases[:-1]) + of(n_shards) - 1
        sent = sought.where(of(n_shards) > 0).select(F.explode(F.sequence(of(bases[:-1]), last)).alias("shard"), F.pmod("qkey", F.lit(chunks)).cast("int").alias("chunk"), "query_id", "qkey", "v", "kth")
        wanted = sent.select("shard", F.col("chunk").alias("part")).distinct()
        found = docs.join(wanted, "shard").groupBy("shard", "part").cogroup(sent.groupBy("shard", "chunk")).applyInArrow(run, "query_id long, qkey long, vec_id long, score long, n long")
        best = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")

    results = saved(searched(homes.withColumn("kth", F.lit(None).cast("long"))), "home")
    if len(centres) > 1:
        kth = results.groupBy("query_id", "qkey").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("held")).where(F.col("held") >= k).select("query_id", "qkey", F.col("least").alias("kth"))
        known = homes.join(kth, ["query_id", "qkey"], "left").select("query_id", "qkey", "v", "kth", "cluster")
        away = known.mapInArrow(_reached(high.astype(np.float64), low.astype(np.float64), width), "query_id long, qkey long, v array<int>, kth long, cluster int")
        results = results.unionByName(searched(saved(away, "away")))
    each = results.select("query_id", "qkey", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))))
    best = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
