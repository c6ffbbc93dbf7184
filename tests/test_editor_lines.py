"""Editor lines against a plain walk over them, one after the other."""

import random

from quire.operators import sets


def walk(lines, items):
    """[(line, action, item)] of one document: lines are (origins, locked item, kind, level, look)."""
    out, claim, locked, carried = [], None, None, None
    for at, (origins, lock, *own) in enumerate(lines):
        own = tuple(own)
        if lock is not None:
            carried = None
            if lock != locked:
                out.append((at, "keep", lock))
            locked = lock
            continue
        locked = None
        in_list = own[0] == "list"
        known = [i for i in origins if i in items]
        alike = next((i for i in known if items[i] == own), None)
        after = lines[at + 1] if at + 1 < len(lines) else None
        if claim is not None:
            out.append((at, "keep", claim))
            carried = claim if in_list else None
            claim = None
        elif alike is not None:
            out.append((at, "keep", alike))
            carried = alike if in_list else None
        elif known and after and not after[0] and after[1] is None and items[known[-1]] == tuple(after[2:]):
            out.append((at, "para", None))
            claim = known[-1]
        else:
            base = known[-1] if known else carried if in_list else None
            out.append((at, "para", base))
            carried = base if in_list else None
    return out


def test_lines_are_saved_as_a_walk_saves_them(spark):
    rng = random.Random(11)
    rows, held, want = [], [], {}
    for doc in range(150):
        items = {i: (rng.choice(["list", "normal"]), 0, rng.choice("ab")) for i in range(5)}
        held += [(doc, i, *v) for i, v in items.items()]
        lines = []
        for _ in range(rng.randint(1, 9)):
            origins = rng.choice([[], [], [rng.randrange(5)], [rng.randrange(5), rng.randrange(7)]])
            lines.append((origins, rng.choice([None, None, None, 7, 8]), rng.choice(["list", "normal"]), 0, rng.choice("ab")))
        rows += [(doc, at, *v) for at, v in enumerate(lines)]
        want[doc] = walk(lines, items)
    df = spark.createDataFrame(rows, "doc int, line int, origins array<int>, locked_item int, kind string, level int, look string")
    known = spark.createDataFrame(held, "doc int, item int, kind string, level int, look string")
    got = {}
    for r in sets.editor_lines(df, known, ["doc"]).orderBy("doc", "line").collect():
        got.setdefault(r.doc, []).append((r.line, r.action, r.item))
    assert got == want
