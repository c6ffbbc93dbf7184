from pyspark.sql import functions as F

from quire.operators import lines, lookup, ordered, requests, search, sets, texts


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_page_offsets_and_page_at(spark):
    pages = spark.createDataFrame([("a", i, h) for i, h in enumerate([792.0, 792.0, 792.0])], "doc string, page int, height double")
    tops = ordered.page_offsets(pages, ["doc"], "page", "height", 1.0)
    assert [r.top for r in tops.orderBy("page").collect()] == [24.0, 834.0, 1644.0]
    looks = spark.createDataFrame([("a", k, y) for k, y in enumerate([-5.0, 24.0, 820.0, 834.0, 9e9])], "doc string, k int, y double")
    assert rows(ordered.page_at(tops, looks, ["doc"], "page", "y"), "k", "page") == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2)]


def test_labels(spark):
    levels = spark.createDataFrame([(15, 0, "decimal", "%1.", 1), (15, 1, "lowerLetter", "%1.%2)", 1), (2, 0, "bullet", "", 1), (9, 1, "decimal", "%1.%2", 1)], "num int, level int, format string, template string, start int")
    items = spark.createDataFrame([("d", k, n, lv) for k, (n, lv) in enumerate([(15, 0), (15, 1), (15, 1), (0, 0), (15, 0), (2, 0), (9, 1), (15, 1), (None, 0)])], "doc string, pos int, num int, level int")
    got = [r.label for r in ordered.list_labels(items, levels, ["doc"], "pos").orderBy("pos").collect()]
    assert got == ["1.", "1.a)", "1.b)", None, "2.", "•", "0.1", "2.a)", None]


def test_style_cascade_depth_cycles_and_missing(spark):
    chain = [(f"s{i}", f"s{i + 1}", None if i < 18 else "deep") for i in range(19)]
    styles = spark.createDataFrame([*chain, ("self", "self", "own"), ("x", "y", None), ("y", "x", "loop"), ("lost", "nowhere", None)], "style_id string, based_on string, font string")
    got = dict(rows(lookup.cascade(styles, ["font"], {"font": "default"})))
    assert (got["s1"], got["s2"]) == ("default", "deep") and got["self"] == "own" and got["x"] == "loop" and got["lost"] == "default"


def test_find_next_wraps_with_the_start_last(spark):
    pages = spark.createDataFrame([("a", 0, "x"), ("a", 1, "Hit"), ("a", 2, "y"), ("b", 0, "none")], "doc string, page int, text string")
    starts = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0)], "doc string, start int")
    for forward in (True, False):
        assert rows(search.find_next(pages, ["doc"], "page", "text", starts, "h it", forward)) == [("a", 0, 1), ("a", 1, 1), ("a", 2, 1)]
    assert search.search(pages, "text", "  ").count() == 0


def test_containment_in_several_passes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "One two three"), (2, "deﬁned here"), (3, None), (3, "")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "TWO"), (2, "defined"), (3, " "), (4, None), (5, "e")], "item_id int, q string")
    want = [(1, 1), (1, 5), (2, 2), (2, 5)]
    assert rows(search.containment(docs, queries, "doc_id", "text", "item_id", "q")) == want
    monkeypatch.setattr(search, "SET_BYTES", 2)
    assert rows(search.containment(docs, queries, "doc_id", "text", "item_id", "q")) == want
    assert rows(search.containment(docs, queries.limit(0), "doc_id", "text", "item_id", "q")) == []


def test_texts(spark):
    text = "Salt\n\tand pepper\n\nthyme\r\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\n\n")], "doc_id int, text string")
    paragraphs = texts.paragraphs(df, "doc_id", "text")
    assert rows(paragraphs) == [(1, 0, "Salt"), (1, 1, "\tand pepper"), (1, 2, ""), (1, 3, "thyme"), (2, 0, ""), (4, 0, ""), (4, 1, "")]
    assert dict(rows(texts.text_of(paragraphs, ["doc_id"])))[1] == text.replace("\r", "")
    labelled = spark.createDataFrame([(1, 0, "a", "1.", 0), (1, 1, "b", "i)", 1), (1, 2, "c", None, None)], "d int, pos int, text string, label string, level int")
    assert texts.text_of(labelled, ["d"], "label", "level").first().text == "1. a\n    i) b\nc\n"
    runs = spark.createDataFrame([(1, "x", None, None, True, False), (2, "cap", None, None, False, True), (3, "?", "7", None, False, False)], "pos int, text string, field_value string, math string, hidden boolean, caps boolean")
    assert [r.text for r in texts.shown_runs(runs).orderBy("pos").collect()] == ["CAP", "7"]


def test_page_edits(spark):
    edits = spark.createDataFrame([(1, 1, "move", 0, 2), (1, 2, "rotate", 0, 450), (1, 3, "delete", 5, 0), (2, 1, "delete", 0, 0), (2, 2, "delete", 0, 0), (2, 3, "delete", 0, 0)], "book int, seq int, op string, page int, arg int")
    got = {r.book: [(p.page, p.turn) for p in r.pages] for r in sets.fold_page_edits(edits, ["book"], "seq", F.lit(3)).collect()}
    assert got == {1: [(1, 90), (2, 0), (0, 0)], 2: [(2, 0)]}


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    assert rows(sets.first_wins(a, b, "id")) == [(1, "x"), (2, "y"), (3, "w")]
    assert rows(sets.combine([a, b], ["id"]), "file_no", "id") == [(0, 1), (0, 2), (1, 2), (1, 3)]
    assert rows(sets.rebase_ids(sets.combine([a, b], ["id"]), "file_no", "id"), "new_id") == [(1,), (2,), (5,), (6,)]
    formats = spark.createDataFrame([("docx",), ("pdf",)], "f string")
    assert sets.combined_format(formats, "f").first().format == "pdf" and sets.combined_format(formats.where("f <> 'pdf'"), "f").first().format == "docx"
    files = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b"a"), (4, None)], "id int, c binary")
    assert rows(sets.fingerprints(files, "id", F.col("c")), "id", "read_at") == [(1, 1), (2, 2), (3, 1), (4, 4)]
    annots = spark.createDataFrame([(1, None), (2, None), (3, 1)], "annot_id int, parent_id int")
    gone = spark.createDataFrame([(1,)], "annot_id int")
    assert rows(sets.remove_annotations(annots, gone), "annot_id") == [(2,)]


def test_lookups(spark):
    refs = spark.createDataFrame([("d", 1), ("d", 2), ("d", 9)], "doc string, note_id int")
    notes = spark.createDataFrame([("d", 1, None, "first"), ("d", 2, "separator", "--")], "doc string, note_id int, type string, text string")
    assert rows(lookup.notes_of(refs, notes, ["doc"]), "note_id", "body") == [(1, "first"), (2, ""), (9, "")]
    parts = spark.createDataFrame([("a.xml",), ("b.PNG",), ("c",)], "name string")
    over, default = spark.createDataFrame([("a.xml", "main")], "name string, type string"), spark.createDataFrame([("xml", "text/xml"), ("png", "image/png")], "ext string, type string")
    assert rows(lookup.content_type(parts, over, default)) == [("a.xml", "main"), ("b.PNG", "image/png"), ("c", None)]
    spans = spark.createDataFrame([("d", 0, 5, "a"), ("d", 7, 9, "b")], "doc string, start int, end int, value string")
    at = spark.createDataFrame([("d", i) for i in (0, 4, 5, 7, 9, -1)], "doc string, off int")
    assert rows(lookup.interval_lookup(spans, at, ["doc"], "off"), "off", "value") == sorted([(0, "a"), (4, "a"), (5, None), (7, "b"), (9, None), (-1, None)], key=str)
    whole = spark.createDataFrame([("d", 0, 10)], "doc string, start int, end int")
    locked = spark.createDataFrame([("d", 2, 4), ("d", 8, 12)], "doc string, start int, end int")
    assert rows(lookup.subtract_spans(whole, locked, ["doc"]), "start", "end") == [(0, 2), (4, 8)]
    levels = spark.createDataFrame([(3, 0, "bullet"), (2, 0, "decimal"), (5, 0, "bullet")], "num int, level int, format string")
    assert lookup.default_bullet_list(levels).first().num == 3
    assert spark.createDataFrame([(None, 2, 3)], "a int, b int, c int").select(*lookup.overlay({"x": F.col("a"), "y": F.col("c")}, {"x": F.col("b")})).first() == (2, 3)


def test_lines_carets_and_nearest(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame([([(0.0, 0.0, 5.0, 10.0), (5.0, 0.0, 10.0, 10.0), (0.0, 20.0, 5.0, 30.0)],)], f"boxes array<{box}>").withColumn("lines", lines.lines(F.col("boxes")))
    got = df.select("lines", lines.nearest_line(F.col("lines"), F.lit(3.0), F.lit(14.0)).alias("near"), lines.caret_at(F.slice("boxes", 1, 2), F.lit(6.0)).alias("caret"), lines.caret_at(F.slice("boxes", 1, 2), F.lit(60.0)).alias("end")).first()
    assert [(x.first, x.end) for x in got.lines] == [(0, 2), (2, 3)] and (got.near, got.caret, got.end) == (0, 1, 2)
    assert spark.range(1).select(lines.text_width(F.lit("ab"), {"a": 500}, 10.0).alias("w")).first().w == 10.56


def test_requests(spark):
    log = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("a", 3, 12), ("b", 1, 13)], "k string, seq int, item int")
    assert rows(requests.latest(log, ["k"], ["seq"], ["item"])) == [("a", 12), ("b", 13)]
    assert rows(requests.newest_first(log, ["k"], ["seq"], 2), "k", "item", "place") == [("a", 11, 2), ("a", 12, 1), ("b", 13, 1)]
    tiles = spark.createDataFrame([(1, "0", 1, "old"), (1, "0", 3, "new"), (1, "1", 1, "retired"), (1, None, 2, "page")], "page int, tile string, gen int, px string")
    assert rows(requests.accept_tiles(tiles, ["page", "tile"], "gen"), "px") == [("new",), ("page",)]


def test_undo_and_outline(spark):
    ops = spark.createDataFrame([("d", i, at, c) for i, (at, c) in enumerate([(0, "a"), (1, "b"), (2, " "), (3, "c"), (9, "d"), (10, None), (11, "e")])], "doc string, seq int, at int, typed string")
    assert [r.step for r in ordered.undo_groups(ops, ["doc"], "seq", "at", "typed").orderBy("seq").collect()] == [1, 1, 2, 2, 3, 4, 5]
    outline = spark.createDataFrame([("d", 0, 1, None), ("d", 1, 2, 4), ("d", 2, 1, None)], "doc string, pos int, level int, page int")
    assert rows(ordered.outline_pages(outline, ["doc"], "pos", "level", "page"), "pos", "page") == [(0, 4), (1, 4)]


def test_a_chain_is_a_row_of_its_own_style_only(spark):
    styles = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (2, "a", "b"), (2, "b", None)], "sheet int, style_id string, based_on string")
    chain = lookup.style_chain(styles, ["sheet"])
    assert "map_from_entries" not in chain._jdf.queryExecution().toString()
    got = sorted(tuple(r) for r in chain.where("sheet = 1 and style_id = 'b'").select("depth", "ancestor").collect())
    assert got == [(k, "bca"[k % 3]) for k in range(lookup.CHAIN)]
    assert rows(chain.where("sheet = 2"), "style_id", "ancestor", "depth") == [("a", "a", 0), ("a", "b", 1), ("b", "b", 0)]
