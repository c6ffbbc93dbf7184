import math
import random

import pytest

from quire.llm import sharding as S
from quire.llm.work import new_folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip_versions_and_sizes(spark, odd_docs):
    store = new_folder(spark, "store")
    wide = odd_docs.withColumn("shard", odd_docs.text)
    assert S.append(wide, store, shard_rows=3) == 1
    assert S.append(wide.limit(4), store, shard_rows=2) == 2
    both = rows(wide.union(wide.limit(4)).drop("shard"))
    live = S.manifest(spark, store)
    assert live.agg({"n_rows": "sum"}).first()[0] == len(both) and live.where("n_rows > 3").count() == 0
    before = live.count()
    assert S.compact(spark, store, wide.schema, target_bytes=1 << 20, fanout=4) == 3
    assert S.manifest(spark, store).count() < before
    assert rows(S.read(spark, store, wide.schema).select(odd_docs.columns)) == both
    assert S.manifest(spark, store, 2).count() == before and rows(S.read(spark, store, wide.schema, 2).select(odd_docs.columns)) == both
    got = S.read(spark, store, wide.schema)
    per = {r.shard: (r["count"], r.n) for r in got.groupBy("shard").agg({"*": "count", "shard_rows": "max"}).withColumnRenamed("count(1)", "count").withColumnRenamed("max(shard_rows)", "n").collect()}
    assert all(a == b for a, b in per.values())
    S.vacuum(spark, store)
    assert S.versions(spark, store) == [3] and rows(S.read(spark, store, wide.schema).select(odd_docs.columns)) == both


def test_a_version_is_committed_once(spark, odd_docs):
    store = new_folder(spark, "store")
    S.append(odd_docs, store)
    table = S.manifest(spark, store)
    with pytest.raises(S.Conflict):
        S.commit(table, store, 1)
    assert S.versions(spark, store) == [1] and S.manifest(spark, store).count() == table.count()


def test_merges_join_shards_of_one_tier(spark):
    small, large = [(f"s{i}", 10, 100_000, 1) for i in range(10)], [(f"l{i}", 10, 20_000_000, 1) for i in range(5)]
    shards = spark.createDataFrame([*small, *large, ("full", 1, 64 << 20, 1), ("lone", 1, 2_000_000, 1)], "path string, n_rows long, n_bytes long, since int")
    plan = S.plan_merges(shards, 64 << 20).collect()
    runs = {}
    for r in plan:
        runs.setdefault(r.run, []).append(r.path)
    assert all(len({p[0] for p in v}) == 1 for v in runs.values()) and all(len(v) > 1 for v in runs.values())
    assert not {"full", "lone"} & {r.path for r in plan}


def planned(shards, target, fanout):
    """Runs as sets of paths, shard by shard: small ones by tier, in order of size, a new run at each multiple of the target."""
    runs, before = {}, {}
    for path, size in sorted(shards.items(), key=lambda s: (s[1], s[0])):
        if 2 * size < target:
            tier = 0
            while max(size, S.LEAST_BYTES) >= S.LEAST_BYTES * fanout ** (tier + 1):
                tier += 1
            runs.setdefault((tier, before.get(tier, 0) // target), set()).add(path)
            before[tier] = before.get(tier, 0) + size
    return sorted(sorted(r) for r in runs.values() if len(r) > 1)


def test_runs_are_those_of_a_plain_planner(spark):
    rng = random.Random(6)
    for target, fanout in ((1 << 20, 2), (8 << 20, 4), (64 << 20, 4)):
        sizes = {f"p{i:04d}": int(2 ** rng.uniform(8, 27)) for i in range(400)}
        df = spark.createDataFrame([(p, 1, n, 1) for p, n in sizes.items()], "path string, n_rows long, n_bytes long, since int")
        runs, total = {}, {}
        for r in S.plan_merges(df, target, fanout).collect():
            runs.setdefault(r.run, set()).add(r.path)
            total[r.run] = r.run_bytes
        assert sorted(sorted(v) for v in runs.values()) == planned(sizes, target, fanout)
        assert all(total[k] == sum(sizes[p] for p in v) <= 1.5 * target for k, v in runs.items())


def test_runs_are_numbered_without_a_gap(spark):
    runs = spark.range(500).selectExpr("concat('r', id) as run", "id as run_bytes")
    assert sorted(r.number for r in S._numbered(runs).collect()) == list(range(500))


@pytest.mark.parametrize("most", [S.MOST_TASKS, 3])
def test_compaction_makes_one_file_a_run_and_leaves_full_ones_alone(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST_TASKS", most)
    store = new_folder(spark, "store")
    rng = random.Random(2)
    df = spark.createDataFrame([(i, "".join(chr(rng.randrange(33, 900)) for _ in range(800))) for i in range(1000)], "doc_id long, text string").repartition(8)
    S.append(df, store, shard_rows=25)
    plan = S.plan_merges(S.manifest(spark, store), 1 << 18).collect()
    sizes = {r.path: r.n_bytes for r in S.manifest(spark, store).collect()}
    S.compact(spark, store, df.schema, target_bytes=1 << 18)
    live = S.manifest(spark, store).collect()
    assert len(live) == len({r.run for r in plan}) + len(sizes) - len(plan) and sum(r.n_rows for r in live) == 1000
    assert max(r.n_bytes for r in live) < 2 << 18 and math.isclose(sum(r.n_bytes for r in live), sum(sizes.values()), rel_tol=0.2)
    again = S.compact(spark, store, df.schema, target_bytes=1 << 18)
    assert {r.path for r in S.manifest(spark, store, again).collect()} >= {r.path for r in live if 2 * r.n_bytes >= 1 << 18}
    assert len(S._folders(S.manifest(spark, store))) <= 2 * len(S.versions(spark, store))
    S.vacuum(spark, store)
    data = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.parquet").load(f"{store}/data").select("path").collect()
    assert len(data) == len(S.manifest(spark, store).collect())
    assert rows(S.read(spark, store, df.schema).select("doc_id", "text")) == rows(df)


def test_of_two_compactions_at_once_one_commits(spark, monkeypatch):
    store = new_folder(spark, "store")
    df = spark.range(300).selectExpr("id as doc_id", "repeat('x', 50) as text")
    S.append(df, store, shard_rows=20)
    commit, lost = S.commit, []

    def late(table, at, version):
        if not lost:
            lost.append(version)
            S.compact(spark, store, df.schema)  # another one comes first
        commit(table, at, version)

    monkeypatch.setattr(S, "commit", late)
    with pytest.raises(S.Conflict):
        S.compact(spark, store, df.schema)
    assert S.versions(spark, store) == [1, 2] and rows(S.read(spark, store, df.schema).select("doc_id", "text")) == rows(df)
    S.vacuum(spark, store)
    assert rows(S.read(spark, store, df.schema).select("doc_id", "text")) == rows(df)


def test_null_and_very_long_texts(spark):
    store = new_folder(spark, "store")
    df = spark.createDataFrame([(1, None), (None, "x" * 2_000_000), (None, None), (2, ""), (2, "")], "doc_id long, text string")
    assert rows(S.shard_corpus(df, store, shard_rows=1, target_bytes=1 << 20).select("doc_id", "text")) == rows(df)


def test_empty(spark, no_docs):
    store = new_folder(spark, "store")
    out = S.shard_corpus(no_docs, store)
    assert out.count() == 0 and {"shard", "shard_rows", "shard_bytes", "shard_since"} <= set(out.columns)
    assert S.append(no_docs, store) == S.versions(spark, store)[-1]


@pytest.mark.parametrize("target", [1 << 20, 40_000])
def test_live_folders_hold_live_files_only(spark, tmp_path, target):
    """After compactions a read opens the live files and no dead one, and every row is there once."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    store = f"file://{tmp_path}/live"
    for seed in range(3):
        S.append(docs.where(f"doc_id % 3 = {seed}").repartition(5), store, 37)
        S.compact(spark, store, docs.schema, target)
        live = S.manifest(spark, store)
        listed = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.parquet").load(S._folders(live)).agg({"length": "sum"}).first()[0]
        assert listed == live.agg({"n_bytes": "sum"}).first()[0]
    back = S.read(spark, store, docs.schema)
    assert back.count() == docs.count() == back.select("doc_id").distinct().count()
