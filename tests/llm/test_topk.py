import math
import random

import numpy as np

from quire.llm import topk


def brute(rows, queries, k):
    most = topk.largest_component(max(len(v or []) for _, v in rows))
    ok = [(i, tuple(max(-most, min(most, math.floor(64 * x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({r for r in ok if r[0] in queries}):
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def run(df, queries, k):
    return sorted(tuple(r) for r in topk.top_k(df, df.where(df.vec_id.isin(queries)), k).collect())


def test_ties_nulls_repeats_and_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_VECTORS", 60)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 5)
    monkeypatch.setattr(topk, "LOT_QUERIES", 3)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(200)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan"), 0.0, 0.0, 0.0]), (303, [float("inf"), 0.0, 0.0, 0.0]), (304, [1.0]), (305, []), (None, [1.0, 1.0, 1.0, 1.0]), rows[7], rows[20]]
    rows += [(310, [1.0, 1.0, 1.0, 1.0])] * 30 + [(40, [0.5, 0.5, 0.5, 0.5])]  # rows that repeat count each; one id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = [0, 7, 20, 40, 60, 300, 302, 304, 305]
    assert run(df, queries, 20) == brute(rows, queries, 20)


def test_clusters_are_pruned_without_changing_results(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_VECTORS", 50)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8)) * 3
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.05).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    away, real = [], topk.saved
    monkeypatch.setattr(topk, "saved", lambda df, name: away.append(real(df, name)) or away[-1] if name == "away" else real(df, name))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = list(range(0, 900, 20))
    assert run(df, queries, 5) == brute(rows, queries, 5)
    assert away[0].count() < 0.7 * len(queries) * (-(-900 // 50) - 1)  # (query, cluster) pairs that are searched


def test_huge_components_saturate(spark):
    rows = [(1, [1e30, -1e30, 2.0]), (2, [1e12, 0.0, 1.0]), (3, [3e38, 1e30, -1.0]), (4, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert run(df, [1, 2, 3, 4], 3) == brute(rows, [1, 2, 3, 4], 3)


def test_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, -1.0]), (3, [0.1, 0.2])], "vec_id long, embedding array<float>")
    assert len(run(df, [1], 20)) == 2
    assert topk.top_k(df.limit(0), df, 5).count() == 0
    assert topk.top_k(df, df.limit(0), 5).count() == 0


def test_blocks_are_pruned_without_changing_results():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 60
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 2).astype(np.int64)
    ids, q = np.arange(4000) * 3, x[:50]
    at, found, score, scored = topk.search_shard(ids, x, ids[:50], q, 10)
    exact = q @ x.T
    for i in range(50):
        best = sorted((-int(s), int(j)) for j, s in zip(ids, exact[i]) if j != ids[i])[:10]
        assert [(-int(s), int(ids[j])) for s, j in zip(score[at == i], found[at == i])] == best
    assert scored < 0.5 * 50 * (4000 / topk.BLOCK_VECTORS)


def test_large_components_stay_exact():
    x = np.array([[2**26, 3], [2**26 + 1, -5], [-(2**27), 1]], np.int64)
    at, found, score, _ = topk.search_shard(np.array([1, 2, 3]), x, np.array([9]), np.array([[2**25 + 1, 7]], np.int64), 3)
    assert [(f + 1, s) for f, s in zip(found, score)] == [(2, 2251799914938333 - 2251799914938333 + int(x[1] @ np.array([2**25 + 1, 7]))), (1, int(x[0] @ np.array([2**25 + 1, 7]))), (3, int(x[2] @ np.array([2**25 + 1, 7])))]
