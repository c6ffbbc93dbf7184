import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quire.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, key string, above int, n double"


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    digest = lambda x: hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()
    own = {c: [x[1:] for x in sorted(ts, key=lambda x: (x[0], digest(x)))] for c, ts in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return own, {c: own.get(c - c % 20, [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}


def nodes_of(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = []
    leaves, saves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saves[node] = (len(members[node]) - 1) * words + sum(saves[x] for x in children[node])
        ends = ",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), up, len(members[node]), len(children[node]), leaves[node], saves[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=str)


def conversations(rng, n, share=0.7, long=()):
    rows = []
    stock = [[(rng.choice(["user", "assistant", None]), rng.choice([None, "", " a  b\t", f"text {rng.randrange(4)} x"])) for _ in range(9)] for _ in range(3)]
    for c in range(n):
        base = rng.choice(stock)
        keep = rng.randrange(10) if rng.random() < share else 0
        turns = base[:keep] + [("user", f"w{rng.randrange(3)}") for _ in range(rng.randrange(4))]
        turns = turns or [("user", "one")]
        if c in long:
            turns = [("user", f"same {i}") for i in range(300)] + [("user", f"{c}")]
        rows += [(c * rng.choice([1, 3]) if c else 0, rng.choice([i, i]), r, t, "k", 1, 0.5) for i, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("subtrie_turns", [1, 7, 40, 4096])
def test_matches_brute_force(spark, subtrie_turns):
    rows = conversations(random.Random(subtrie_turns), 120, long=(30, 31, 33, 90))
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    own, convs = rebuilt(rows)
    turns = T.turn_rows(df)
    assert got(T.prefix_trie(T.with_openings(turns), subtrie_turns)) == nodes_of(convs)
    if subtrie_turns == 7:
        assert got(T.prefix_trie(T.sequences(turns), subtrie_turns)) == nodes_of(own)


def test_nulls_ties_and_turnless(spark):
    rows = [(5, None, "user", "first"), (5, 0, None, None), (5, 0, "", ""), (None, 1, "user", "nobody"), (7, 3, "user", "x " * 50_000), (7, 3, "user", "x " * 50_000), (2, 1, "a", "b"), (3, 1, "a", "b"), (0, 1, "s", "t"), (41, 1, "user", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own, convs = rebuilt(rows)
    assert [] in convs.values()
    assert got(T.prefix_trie(T.with_openings(T.turn_rows(df)), 2)) == nodes_of(convs)
    assert got(T.prefix_trie(T.sequences(T.turn_rows(df)))) == nodes_of(own)
    assert got(T.prefix_trie(T.with_openings(T.turn_rows(df.limit(0))))) == []


def test_one_conversation_and_copies_only(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(3000, 3040) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    own, _ = rebuilt(rows)
    assert got(T.prefix_trie(T.sequences(T.turn_rows(df)), 3)) == nodes_of(own)
    assert got(T.prefix_trie(T.sequences(T.turn_rows(df.where("conv_id = 3001"))), 3)) == nodes_of({3001: own[3001]})


def test_ids_of_a_run_over_many_batches():
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["key", "conv_id"])
    parts = [batch([("a", 1), ("a", 2)]), batch([("a", 3)]), batch([("a", 10), ("b", 4)]), batch([]), batch([("b", 5), ("c", 6)])]
    found = [r for b in T._digest_ids(iter(parts)) for r in b.to_pylist()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [(r["key"], r["n"], r["least"], r["ends"]) for r in found] == [("a", 4, 1, sha("1,2,3,10")), ("b", 2, 4, sha("4,5")), ("c", 1, 6, sha("6"))]
    assert list(T._digest_ids(iter([]))) == []
