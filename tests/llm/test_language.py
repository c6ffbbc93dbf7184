import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import language as L

SYLLABLES = {"aa": ["ka", "to", "mi"], "bb": ["schl", "ung", "ber"], "cc": ["é", "oux", "tré"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    rows = [(i, text(rng, lang, rng.randint(1, 60)), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(400))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def field(labelled):
    return L.fit(L.sample(labelled))


def test_held_out_accuracy(labelled, field):
    rows = L.identify(labelled, field).where(~L.may_learn(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert len(rows) > 50 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_are_not_learnt_from(labelled, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_ROWS", 10**6)
    texts = {r.text for r in labelled.where(~L.may_learn(labelled.doc_id)).collect()}
    learnt = {t for _, t in L.sample(labelled)}
    assert not (texts - {r.text for r in labelled.where(L.may_learn(labelled.doc_id)).collect()}) & learnt


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 3, 5):
        scores, moves, first = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        weight = {p: np.exp(first[p[0]] + sum(scores[i, p[i]] for i in range(n)) + sum(moves[p[i], p[i + 1]] for i in range(n - 1))) for p in itertools.product(range(3), repeat=n)}
        exact = np.array([[sum(w for p, w in weight.items() if p[i] == k) for k in range(3)] for i in range(n)]) / sum(weight.values())
        two = L.posteriors(np.concatenate([scores, scores]), np.arange(2 * n) % n == 0, first, moves)
        assert np.allclose(two[:n], exact) and np.allclose(two[n:], exact)


def test_gradient_matches_finite_differences(monkeypatch):
    rng = np.random.default_rng(4)
    n, k = 23, 3
    scores, moves, first, gold = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k), rng.integers(0, k, n)
    begins = np.isin(np.arange(n), (0, 5, 6, 15))
    for segment in (128, 4):
        monkeypatch.setattr(L, "SEGMENT", segment)
        exact = L.gradient(scores, begins, first, moves, gold)
        for at, found in zip((scores, first, moves), exact, strict=True):
            for i in np.ndindex(at.shape):
                was, sides = at[i], []
                for step in (1e-5, -1e-5):
                    at[i] = was + step
                    sides.append(L.log_likelihood(scores, begins, first, moves, gold))
                at[i] = was
                assert abs((sides[0] - sides[1]) / 2e-5 - found[i]) < 1e-6


def test_pair_marginals_match_enumeration():
    rng = np.random.default_rng(5)
    n, k = 4, 3
    scores, moves, first = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    weight = {p: np.exp(first[p[0]] + sum(scores[i, p[i]] for i in range(n)) + sum(moves[p[i], p[i + 1]] for i in range(n - 1))) for p in itertools.product(range(k), repeat=n)}
    exact, found = np.zeros((k, k)), np.zeros((k, k))
    for p, w in weight.items():
        np.add.at(exact, (p[:-1], p[1:]), w / sum(weight.values()))
    L.posteriors(scores, np.arange(n) == 0, first, moves, found)
    assert np.allclose(found, exact)


def test_transitions_and_start_are_learnt(field, spark):
    assert (np.diag(field.moves)[:, None] >= field.moves).all() and np.diag(field.moves).min() > field.moves[~np.eye(3, dtype=bool)].max()
    assert np.abs(field.first).max() > 0 and np.isfinite(field.first).all()
    skewed = L.fit([("aa", "ka to mi ka to")] * 9 + [("bb", "ber ung")])
    assert skewed.first[0] > skewed.first[1]


def test_segments_do_not_matter(monkeypatch):
    rng = np.random.default_rng(3)
    scores, moves, first = rng.normal(size=(1000, 4)), rng.normal(size=(4, 4)), np.zeros(4)
    begins = rng.random(1000) < 0.01
    one = L.posteriors(scores, begins, first, moves)
    monkeypatch.setattr(L, "SEGMENT", 1000)
    assert np.allclose(one, L.posteriors(scores, begins, first, moves))


def test_code_switching(spark, field):
    rng = random.Random(9)
    df = spark.createDataFrame([(1, text(rng, "aa", 20) + " " + text(rng, "bb", 30)), (2, None), (3, "")], "doc_id int, text string")
    spans = {r.doc_id: r.spans for r in L.label_words(df, field).collect()}
    assert [s.lang for s in spans[1]] == ["aa", "bb"] and abs(spans[1][0].to - 20) <= 2
    assert spans[2] == spans[3] == []
    assert L.identify(df, field).where("doc_id = 1").first().lang_pred == "bb"


def test_odd_empty_and_unlabelled(spark, field, odd_docs, no_docs, odd_texts):
    got = L.identify(odd_docs, field)
    assert got.columns[-2:] == ["lang_pred", "score"] and got.count() == odd_docs.count()
    for r in got.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert (r.score == 0) == (not letters)
    assert L.fit(L.sample(no_docs)) is None
    assert {(r.lang_pred, r.score) for r in L.identify(odd_docs, None).collect()} == {("und", 0.0)}
    assert L.identify(no_docs, field).count() == 0
