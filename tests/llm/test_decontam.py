import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import decontam

from .conftest import sentence

CJK = re.compile(r"[぀-鿿]|[^\W_぀-鿿]+")


def tokens(text):
    return CJK.findall((text or "").lower())


def brute(docs, items, least_item=decontam.LEAST_ITEM):
    """{(doc, item): (matches, start, end)} over every diagonal and window of every pair."""
    found = {}
    for d, text in docs:
        a = tokens(text)
        for i, item in items:
            b = tokens(item)
            if len(b) < least_item:
                continue
            for diagonal in range(-len(b) + 1, len(a)):
                same = {p for p in range(max(0, diagonal), min(len(a), len(b) + diagonal)) if a[p] == b[p - diagonal]}
                for start in {p + k for p in same for k in range(-15, 1)}:
                    hit = [p for p in range(start, start + 16) if p in same]
                    if 10 * len(hit) >= 8 * min(16, len(b)):
                        found.setdefault((d, i), []).append((-len(hit), hit[0], hit[-1] + 1))
    return {k: (-min(v)[0], *min(v)[1:]) for k, v in found.items()}


def got(d, b, **options):
    rows = decontam.overlaps(d, b, **options).collect()
    return {(r.doc_id, r.item_id): (r.n_matched, r.start_token, r.end_token) for r in rows}


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    items = [(i, sentence(rng, 20 + i)) for i in range(8)] + [(8, "a tiny item of tokens"), (9, None), (10, ""), (11, "two words"), (8, "another text of item eight here")]
    docs = [(i, sentence(rng, 80)) for i in range(30)]
    for k in range(6):
        words = items[k][1].split()
        if k % 2:
            words[7], words[15] = "other", "changed"  # substitutions are tolerated
        docs[k] = (k, f"{docs[k][1]} {'. '.join(words).upper()} {sentence(rng, 10)}")
    docs[10] = (10, "before A tiny item, of tokens after")
    docs[11] = (11, "before A tiny item, in tokens after, and another text of item eight here")
    docs[12] = (12, "has two words in it")
    docs += [(40, None), (41, ""), (42, "short"), docs[0]]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 0], ids=["broadcast", "joined"])
def test_finds_what_brute_force_finds(planted, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    docs, items, d, b = planted
    assert got(d, b) == brute(docs, items)
    assert set(got(d, b)) == {*((k, k) for k in range(6)), (10, 8), (11, 8)}
    assert sum(r.doc_id == 0 for r in decontam.overlaps(d, b).collect()) == 2  # rows that repeat give theirs each
    assert got(d, b, least_item=1) == brute(docs, items, 1) and (12, 11) in got(d, b, least_item=1)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 0], ids=["broadcast", "joined"])
def test_decontaminate_keeps_the_others_as_they_were(planted, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    docs, _, d, b = planted
    wide = d.selectExpr("text", "doc_id", "'x' as item_id", "1 as row", "2 as k1")
    kept = decontam.decontaminate(wide, b)
    assert kept.columns == wide.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in {0, 1, 2, 3, 4, 5, 10, 11})


def search(rows, items, **options):
    s = decontam.seeds(list(range(len(items))), items, **options)
    return {(int(r), int(i)) for r, i, *_ in decontam._search(pa.array(rows, pa.large_string()), s)}


@pytest.mark.parametrize("n", range(1, 17))
def test_every_allowed_choice_of_substitutions_is_found(n):
    words = [f"t{k}" for k in range(n)]
    k = n - decontam.needed(n)
    rows = []
    for gone in itertools.combinations(range(n), k):
        rows.append("a b " + " ".join("other" if i in gone else w for i, w in enumerate(words)) + " c")
    assert search(rows, [" ".join(words)], least_item=1) == {(r, 0) for r in range(len(rows))}
    worse = [" ".join("other" if i in gone else w for i, w in enumerate(words)) for gone in itertools.combinations(range(n), k + 1)]
    assert search(worse, [" ".join(words)], least_item=1) == set()


def test_items_of_all_lengths_with_random_substitutions():
    rng = random.Random(8)
    items, rows = [], []
    for n in range(1, 41):
        for _ in range(12):
            item = sentence(rng, n, 30).split()
            row = [w if rng.random() < 0.8 else "other" for w in item]
            items.append(" ".join(item))
            rows.append(" ".join([*sentence(rng, rng.randrange(5), 30).split(), *row[rng.randrange(3) :]]))
    wanted = brute(list(enumerate(rows)), list(enumerate(items)), 1)
    assert search(rows, items, least_item=1) == set(wanted) and len(wanted) > 200


def test_hits_in_many_lots_and_common_passages(monkeypatch):
    rng = random.Random(3)
    common = sentence(rng, 14)
    items = [f"{common} {sentence(rng, 8)}" for _ in range(40)]
    rows = [f"{sentence(rng, 5)} {common} {sentence(rng, 5)}" for _ in range(10)] + ["clean words only"]
    want = search(rows, items)
    monkeypatch.setattr(decontam, "LOT", 7)
    assert search(rows, items) == want == {(r, i) for r in range(10) for i in range(40)}
    s = decontam.seeds(list(range(40)), items)
    assert set(decontam._search(pa.array(rows, pa.large_string()), s, any_item=True)[:, 0]) == set(range(10))


def test_scripts_without_spaces_are_split_by_character():
    text = "机器学习模型需要大量训练数据才能工作。"
    assert search([f"前言{text}后记", "完全不同的句子没有重复内容在这里面吗"], [text]) == {(0, 0)}
    w = decontam._tokens(next(decontam.blocks(pa.array(["ab机器 Ünï、c"], pa.large_string()))))
    assert np.diff(np.stack([w.starts, w.ends]), axis=0).ravel().tolist() == [2, 3, 3, 5, 1]


def test_odd_and_empty(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "null id text here now")], "item_id long, text string")
    odd_docs = odd_docs.replace("null id text here", "so null id text here now", subset="text")
    assert decontam.overlaps(odd_docs, none).count() == 0
    assert decontam.overlaps(no_docs, some).count() == 0
    assert [r.doc_id for r in decontam.overlaps(odd_docs, some).collect()] == [None]
    assert decontam.decontaminate(odd_docs, some).count() == odd_docs.count() - 1


def test_odd_and_empty_joined(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 0)
    test_odd_and_empty(spark, odd_docs, no_docs)
