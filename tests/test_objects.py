"""Objects of paged files: ways, inheritance, closure and merge on small trees with loops and gaps."""

from quire.operators import objects as O

SCHEMA = "job int, file_no int, node long, kind string, parent long, place long, title string, target long, rotate int"


def obj(file_no, node, kind, parent=None, place=0, title=None, target=None, rotate=None):
    return (1, file_no, node, kind, parent, place, title, target, rotate)


def test_ways_of_deep_trees_loops_and_missing_parents(spark):
    rows = [("a", n, n - 1 if n else None, n % 3) for n in range(70)] + [("b", 1, 2, 7), ("b", 2, 1, 8), ("b", 3, 1, 9), ("b", 4, 99, 5), ("b", 5, 5, 0), ("b", 6, 4, 6)]
    found = {(r.doc, r.node): r.path for r in O.paths(spark.createDataFrame(rows, "doc string, node long, parent long, place int"), ["doc"], 64).collect()}
    assert {k: v for k, v in found.items() if k[0] == "b"} == {("b", 4): [5], ("b", 6): [5, 6]}
    assert all(found["a", n] == [m % 3 for m in range(n + 1)] for n in range(64))


def test_files_merged(spark):
    files = spark.createDataFrame([(1, 0, "first", False), (1, 1, "second", False), (1, 2, "none", False), (2, 0, "shut", True), (2, 1, "open", False)], "job int, file_no int, title string, encrypted boolean")
    rows = [
        obj(0, 0, "tree", rotate=90), obj(0, 1, "tree", 0, 1, rotate=180), obj(0, 2, "page", 1, 0), obj(0, 3, "page", 0, 0), obj(0, 4, "page", 0, 2, rotate=0),
        obj(0, 5, "font", title="led"), obj(0, 6, "font", title="led in a circle"), obj(0, 7, "font", title="lost"), obj(0, 8, "outline", None, 0, "top", 2), obj(0, 9, "outline", 8, 0, "under", 77), obj(0, 10, "outline", 10, 0, "own parent", 2),
        obj(1, 0, "page", None, 0, rotate=None), obj(1, 5, "page", 6, 0), obj(1, 6, "tree", 5, 0),
        (2, 1, 0, "page", None, 0, None, None, None),
    ]
    refs = spark.createDataFrame([(1, 0, 2, 5), (1, 0, 5, 6), (1, 0, 6, 5), (1, 0, 7, 6), (1, 0, 6, 3), (2, 1, 0, 0)], "job int, file_no int, node long, to long")
    got = O.merged(files, spark.createDataFrame(rows, SCHEMA), refs, ["rotate"]).collect()
    assert {r.job for r in got} == {1}
    at = {r.new_id: r for r in got}
    assert len(at) == len(got)
    # The first file has ids from 1 and an entry behind them, the second one from 13, the third, without objects, an entry only.
    assert [(i, at[i].place, at[i].rotate, at[i].parent) for i in (4, 3, 5, 13)] == [(4, 0, 90, 0), (3, 1, 180, 0), (5, 2, 0, 0), (13, 3, None, 0)]
    assert {i: at[i].title for i in at if at[i].kind == "font"} == {6: "led", 7: "led in a circle"}
    assert {i: (r.title, r.parent, r.target, r.folded) for i, r in at.items() if r.kind == "outline"} == {9: ("top", 12, 3, False), 10: ("under", 9, None, False), 12: ("first", None, None, True), 20: ("second", None, None, True), 21: ("none", None, None, True)}
    assert at[0].kind == "tree" and set(at) == {0, 3, 4, 5, 6, 7, 9, 10, 12, 13, 20, 21}


def test_nothing_to_merge(spark):
    files = spark.createDataFrame([], "job int, file_no int, title string, encrypted boolean")
    assert O.merged(files, spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "job int, file_no int, node long, to long"), ["rotate"]).count() == 0


def test_written_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    from quire.sources import tables

    a, b = (tables.saved(spark.range(1000).selectExpr("id", f"id % 7 as {c}")) for c in "xy")
    joined = a.join(b.selectExpr("id", "explode(array(y, y + 1)) as y"), "id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 2000
    tables.release(a)
    tables.release(b)


def test_loops_end_with_the_first_round_in_which_no_way_does(spark, monkeypatch):
    written = []
    saved = O.tables.saved
    monkeypatch.setattr(O.tables, "saved", lambda df, name="table": written.append(name) or saved(df, name))
    rows = [("a", 1, 2, 0), ("a", 2, 3, 0), ("a", 3, 1, 0), ("a", 4, 4, 0), ("b", 1, None, 5), ("b", 2, 1, 6), ("b", 3, 2, 7), ("b", 4, 9, 8)]
    found = O.paths(spark.createDataFrame(rows, "doc string, node long, parent long, place int"), ["doc"], 64).collect()
    # The nodes, ways of two, ways of four, and ways of eight, of which there are none.
    assert {(r.doc, r.node): r.path for r in found} == {("b", 1): [5], ("b", 2): [5, 6], ("b", 3): [5, 6, 7], ("b", 4): [8]} and len(written) == 4
