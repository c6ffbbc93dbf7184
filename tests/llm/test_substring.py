import re
import random
from collections import Counter

from quire.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    split = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def run(df, window):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.remove_repeats(df, window).collect()), key=str)


def test_small_windows_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (1, 3, 5):
        assert run(df, window) == brute(rows, window)


def test_passages_periods_and_odd_rows(spark, odd_docs):
    rng = random.Random(6)
    plain = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = plain(50)
    rows = [(1, f"{plain(30)} {passage}\n{plain(20)}"), (2, passage), (3, f"{plain(10)}\t{passage} {plain(3)}"), (4, plain(80)), (5, "a b c " * 40), (6, plain(34)), (7, " ".join(["line of five words here"] * 9)), (8, plain(35)), (9, passage[: passage.rfind(" ")])]
    rows += [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()] + [(4, plain(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, 35) == brute(rows, 35)
    spans = {r.doc_id: r.removed for r in substring.remove_repeats(df, 35).where("doc_id in (1, 2)").collect() if r.n_words in (50, 100)}
    assert [(s["from"], s["to"]) for s in spans[2]] == [(0, 50)] or spans[2] == []


def test_empty(no_docs):
    assert substring.remove_repeats(no_docs).count() == 0
