import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import spelling as S

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups_of(rows):
    n = words_of(rows)
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x.encode()), default=None) for w, xs in near.items()}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or -1) for r in S.spelling_groups(df).collect())


def test_groups_match_brute_force(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(400):
            w = rng.choice(stems[: rng.randrange(1, 61)])
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcÀÿ") + w[at:], w[:at] + rng.choice("abcZ") + w[at + 1 :]])
            text.append(w)
        rows.append((i, rng.choice([" ", ". ", "-", "1", "中"]).join(text)))
    want = groups_of(rows)
    assert len(want) > 100 and sum(bool(w[1]) for w in want) > 30 and any(w[4] > 3 for w in want)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want


def test_odd_texts(spark, odd_docs, no_docs):
    assert got(odd_docs) == groups_of([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert got(no_docs) == []
    assert got(odd_docs.where("text is null or trim(text) = ''")) == []


def test_runs_of_all_letters(spark):
    rows = [(1, "Äpfel äpfel ÀÿÞßaa ×÷×÷× abcdeĀfghij ＡＢＣＤＥ Ǽabcde ﬁabcde 😀abcdé́fghij" * 3), (None, "abcde" * 9 + " ABCDE.abcde_abcde"), (3, "é" * 5 + "x" * 100_000 + " ééééé éééééé")]
    counted = {r.word: r.n for r in S.occurrences(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("word").agg(F.sum("n").alias("n")).collect()}
    want = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            want[run] += len(run) >= 5
    assert counted == {w: n for w, n in want.items() if n}


def test_masks_flip_two_bits_at_most(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(200):
        w = "".join(rng.choice("abcxyzéÿÀß") for _ in range(rng.randrange(1, 12)))
        at = rng.randrange(len(w))
        rows.append((w, w[:at] + rng.choice("aqé") + w[at + rng.randrange(2) :]))
    masked = spark.createDataFrame(rows, "a string, b string").select(S.parity_mask(F.col("a")).alias("a"), S.parity_mask(F.col("b")).alias("b"))
    flips = [(r.a ^ r.b, bin(r.a ^ r.b).count("1")) for r in masked.collect()]
    assert max(n for _, n in flips) == 2 and all(any(not x & band for band in S.BANDS) for x, _ in flips)


def test_each_pair_once(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(5, 8))) for _ in range(150)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long").withColumn("mask", S.parity_mask(F.col("word")))
    pairs = [tuple(sorted((r.a, r.b))) for r in S.near_pairs(df).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if a < b and is_near(a, b))


@pytest.mark.parametrize("steps", [1, 2, 7, 20])
def test_roots_of_chains(spark, steps):
    chain = [f"w{i}" for i in range(steps + 1)]
    df = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "word string, form string")
    assert {r.word: r.root for r in S.roots(df).collect()} == {w: chain[-1] for w in chain[:-1]}


def test_the_keys_of_words_are_not_broadcast(spark):
    words = spark.createDataFrame([("stone", 3), ("store", 9)], "word string, n long").withColumn("mask", S.parity_mask(F.col("word")))
    pairs = S.near_pairs(words)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in pairs.collect()] == [("stone", 3, "store", 9)]
