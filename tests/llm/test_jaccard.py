import random
import re

import numpy as np
import pytest

from quire.llm import components, jaccard

from .conftest import sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(rng, n):
    rows = []
    for base in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 120))]
        for _ in range(rng.choice([1, 1, 2, 6, 12])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_groups_match_brute_force(spark, size, percent):
    rng = random.Random(percent)
    rows = near_copies(rng, 45)
    rows += [(900, "Two words"), (901, "two WORDS"), (902, "two words more"), (903, None), (904, ""), (905, " \n"), (906, "É a b c d"), (907, "é a b c d"), rows[3], (3, "another text under id three with several words in it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, size, percent).collect()), key=str)
    assert got == brute(rows, size, percent)


def test_chains_hot_groups_and_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = [(2000 - k, " ".join([*base[k:], *(f"n{i}" for i in range(k))])) for k in range(0, 60, 4)]  # each near the next only
    rows += [(3000 + i, " ".join(w if rng.random() > 0.02 else f"y{rng.randrange(10**6)}" for w in base)) for i in range(60)]
    rows += [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85)
    kept = jaccard.one_of_each(odd_docs, 5, 80)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, c in brute([(r.doc_id, r.text) for r in odd_docs.collect()], 5, 80) if d is None or d == c}
    assert jaccard.similar_groups(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, rng.randrange(200, 260)) for _ in range(60)] + [(300, 300), (None, 5), (5, None)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141))
    assert all(v == 7 for k, v in got.items() if 200 <= k < 260) and got[7] == 7 and got[300] == 300 and 5 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_ids_link_as_any_other(spark):
    base = [f"b{i}" for i in range(120)]
    chain = lambda k: " ".join([*base[k:], *(f"n{i}" for i in range(k))])
    rows = [(50, chain(0)), (None, chain(8)), (40, chain(16))]  # 40 and 50 meet over the null id only
    rows += [(None, "all of this group has no id"), (None, "all of this group has no id"), (None, None), (None, " ")]
    rows += [(7, "a text on a null id and on another one"), (None, "a text on a null id and on another one"), (7, chain(24))]
    assert 100 * len(shingles(rows[0][1], 4) & shingles(rows[2][1], 4)) < 80 * len(shingles(rows[0][1], 4) | shingles(rows[2][1], 4))
    want = brute(rows, 4, 80)
    assert (50, 117, 7) in want and (None, 117, 7) in want
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, 4, 80).collect()), key=str) == want


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(12)
    base = [f"b{i}" for i in range(100)]
    near = lambda: " ".join([*base[:-1], f"x{rng.randrange(10**6)}"])
    twice = [(1, "a text that is there twice", "s"), (2, "another one that is there twice", None), (3, None, "s"), (4, "", "s")]
    rows = twice + twice + [(None, near(), "s") for _ in range(3)] + [(20, near(), "s"), (None, near(), "s")]
    rows += [(10, "the text of a smaller id", "s"), (11, "the text of a smaller id", "s"), (11, "words that stand nowhere but here", "s")]
    rows += [(None, "only null ids have this", "s"), (None, "only null ids HAVE this", "s"), (None, "only null ids have this", "s")]
    rows += [(None, None, "s"), (None, " ", "s"), (None, None, "s"), (2, "another one that is there twice", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = jaccard.one_of_each(df, 4, 80)
    assert got.columns == df.columns
    kept = sorted([(r.doc_id, (r.text or "").lower(), r.source) for r in got.collect()], key=str)
    second = next(s for d, _, s in kept if d == 2)
    want = [(1, twice[0][1], "s"), (2, twice[1][1], second), (3, "", "s"), (4, "", "s"), (20, rows[11][1], "s"), (10, "the text of a smaller id", "s")]
    want += [(11, "words that stand nowhere but here", "s"), (None, "only null ids have this", "s"), (None, "", "s"), (None, " ", "s"), (None, "", "s")]
    assert kept == sorted(want, key=str)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 20, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, n + 1)], rng.integers(0, 1 << 63, n // 3, np.uint64)]))
        differ = len(np.setxor1d(a, b))
        assert sum(bin(int(x) & (1 << 64) - 1).count("1") for x in jaccard.parities(a) ^ jaccard.parities(b)) <= differ


def test_a_common_template_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(12)
    phrases = [sentence(rng, 14, 10**6) for _ in range(40)]
    template = sentence(rng, 60, 10**6)
    rows = [(i, f"{' '.join(rng.sample(phrases, 3))} {template}") for i in range(240)] + [(1000 + i, " ".join(rng.sample(phrases, 6))) for i in range(600)]
    made, real = {}, jaccard.saved
    monkeypatch.setattr(jaccard, "saved", lambda df, name: made.setdefault(name, []).append(real(df, name)) or made[name][-1])
    monkeypatch.setattr(jaccard, "discard", lambda *tables: None)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(df, 4, 85).collect()}
    assert got == {d: c for d, _, c in brute(rows, 4, 85)}
    assert made["rest"][0].count() < 2 * len(rows)
