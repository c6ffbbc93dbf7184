import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import mixing


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def docs(spark, counts):
    rows = [(i, s, f"t{i}", "clash") for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, rate string")


def poisson_inverse(rate, u):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p = p * rate / k
        c = c + p
    return k


def test_counts_are_the_inverse_of_the_distribution(spark):
    df = docs(spark, {"a": 300, "b": 60, None: 40})
    rates = {r._q_source: r.rate for r in mixing.rates(df, {"a": 1.0, "b": 3.0}).collect()}
    assert rates[None] == 0 and abs(rates["a"] * 300 + rates["b"] * 60 - 400) < 1e-6
    got = Counter(r.doc_id for r in mixing.mix_sources(df, {"a": 1.0, "b": 3.0}, seed=9).collect())
    for r in df.collect():
        draw = md5(f"{r.doc_id}:{md5(r.text)}::1")
        u = int(md5(f"9:{draw}:1")[:13], 16) / 2**52
        assert got[r.doc_id] == (poisson_inverse(rates[r.source], u) if rates[r.source] else 0)


def test_large_rates_are_drawn_in_parts(spark):
    df = docs(spark, {"tiny": 40, "big": 10})
    out = mixing.mix_sources(df, {"tiny": 1.0, "big": 0.0}, total=40 * 100)
    n = out.count()
    assert abs(n - 4000) < 6 * math.sqrt(4000)
    assert {r.source for r in out.select("source").distinct().collect()} == {"tiny"}
    assert out.select("doc_id", "replica").distinct().count() == n


def test_same_seed_same_mixture_in_any_partitioning(spark):
    df = docs(spark, {"a": 200, "b": 100})
    one = sorted((r.order_key, r.doc_id, r.replica) for r in mixing.mix_sources(df).collect())
    two = sorted((r.order_key, r.doc_id, r.replica) for r in mixing.mix_sources(df.repartition(7)).collect())
    assert one == two
    assert [d for _, d, _ in one] != sorted(d for _, d, _ in one)


def test_salted_join_gives_the_same(spark, monkeypatch):
    df = docs(spark, {"a": 100, None: 50})
    want = sorted((r.doc_id, r.replica) for r in mixing.mix_sources(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id, r.replica) for r in mixing.mix_sources(df).collect()) == want


def within(n, mean):
    return abs(n - mean) < 6 * math.sqrt(mean)


@pytest.mark.parametrize("keys", [mixing.BROADCAST_KEYS, 0])
def test_rows_of_null_and_repeated_ids_are_drawn_each(spark, monkeypatch, keys):
    monkeypatch.setattr(mixing, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(mixing, "COPIES", 100)
    rows = [(None, "a", f"text {i}", 1) for i in range(1000)]  # null ids
    rows += [(1, "b", f"text {i}", 1) for i in range(1000)]  # one id, many texts
    rows += [(2, "c", "same", i) for i in range(1000)]  # one id and text, other columns differ
    rows += [(3, "d", "same", 7)] * 1000  # whole rows repeat
    rows += [(None, "e", None, None)] * 1000
    rows += [(4, "f", None, None), (4, "f", "", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, other int")
    out = mixing.mix_sources(df, {s: 1.0 for s in "abcde"}, total=5000).cache()
    got = Counter(r.source for r in out.collect())
    assert all(within(got[s], 1000) for s in "abcde") and not got["f"]
    assert out.select("order_key").distinct().count() == out.count()  # no two replicas share a place
    per = Counter(r.text for r in out.where("source = 'a'").collect())
    assert 300 < 1000 - len(per) < 440  # e**-1 of the rows go
    assert Counter(r.other for r in out.where("source = 'c'").collect()) != Counter(range(1000))
    again = mixing.mix_sources(df.repartition(5), {s: 1.0 for s in "abcde"}, total=5000)
    assert sorted(r.order_key for r in again.collect()) == sorted(r.order_key for r in out.collect())
    out.unpersist()


def test_repeated_rows_with_maps_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "t")] * 50, "doc_id long, source string, text string").withColumns({"m": F.create_map(F.lit("k"), F.lit(1)), "replica": F.lit("clash"), "a b": F.lit(1)})
    out = mixing.mix_sources(df)
    assert within(out.count(), 50) and out.columns == ["doc_id", "source", "text", "m", "a b", "rate", "n_replicas", "replica", "order_key"]


def test_odd_and_empty(odd_docs, no_docs):
    out = mixing.mix_sources(odd_docs, {"s0": 1.0, "s1": 1.0})
    assert {"replica", "n_replicas", "rate", "order_key"} <= set(out.columns)
    assert {r.source for r in out.collect()} <= {"s0", "s1"}
    assert mixing.mix_sources(no_docs).count() == 0
