import random

from pyspark.sql import functions as F

from quire.llm import preference as P

TURNS = "array<struct<role: string, text: string>>"


def render(turns):
    return "".join(f"<|turn|>{r or ''}\n{t or ''}<|end|>\n" for r, t in turns)


def mask(turns):
    return [x for r, t in turns for x in [(len(f"<|turn|>{r or ''}\n"), False), (len(f"{t or ''}<|end|>\n"), r == "assistant")]]


def test_prefix_prompt_completions_and_masks(spark):
    rng = random.Random(3)
    rows = [(0, None, None), (1, [], [("user", "x")]), (2, [("user", None)], [("user", None), ("assistant", "é😀")]), (3, [(None, "a")], [(None, "a")])]
    for i in range(4, 120):
        a = [(rng.choice(["user", "assistant"]), rng.choice(["p", "q", None])) for _ in range(rng.randint(0, 5))]
        b = a[: rng.randint(0, len(a))] + [("assistant", rng.choice(["p", "z"])) for _ in range(rng.randint(0, 2))]
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, f"pair int, chosen {TURNS}, rejected {TURNS}").withColumn("prompt", F.lit("old"))
    got = {r.pair: r for r in P.format_preferences(df).collect()}
    for i, a, b in rows:
        a, b = a or [], b or []
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        r = got[i]
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.rejected) == (n, render(a[:n]), render(a[n:]), render(b[n:]))
        for side, turns in ((r.chosen_mask, a[n:]), (r.rejected_mask, b[n:])):
            assert [(m.length, m.train) for m in side] == mask(turns)
        assert sum(m.length for m in r.chosen_mask) == len(r.chosen)


def test_pairs_of_conversations(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "dangling"), (1, 0, "user", "r"), (1, 1, "assistant", "b"), (2, 0, "user", "only"), (4, 0, "assistant", "alone"), (None, 0, "assistant", "no id")]
    pairs = {r.conv_id: r for r in P.pairs_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(pairs) == [0, 1, 4]
    assert [t.text for t in pairs[0].chosen] == ["q", "a"] and [t.text for t in pairs[0].rejected] == ["q", "b"]
    assert [t.text for t in pairs[4].rejected] == []
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert P.format_preferences(P.pairs_of(empty)).count() == 0


def test_very_long_texts_null_and_repeated_turns(spark):
    long = "x" * 2_000_000
    rows = [(0, None, "user", long), (0, 1, "assistant", "a"), (0, 1, "assistant", "a"), (1, 0, "user", long), (1, 1, "assistant", None), (1, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash"))
    got = {r.conv_id: r for r in P.format_preferences(P.pairs_of(df)).collect()}
    # A null turn comes first; turns that repeat are both kept.
    assert got[0].prompt == render([("user", long), ("assistant", "a")]) and got[0].chosen == render([("assistant", "a")]) and got[0].rejected == render([("assistant", None)])
    assert got[1].prompt == render([(None, None), ("user", long)]) and got[1].rejected == render([("assistant", "a")])
