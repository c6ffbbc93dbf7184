from pyspark.sql import functions as F

from quire.functions import geometry, xml
from quire.operators import editing as E
from quire.operators import lines as L


def test_replay_and_back(spark):
    texts = spark.createDataFrame([("a", "héllo world"), ("b", "same")], "doc string, text string")
    log = spark.createDataFrame([("a", 1, "delete", 5, " world"), ("a", 2, "insert", 0, ">> "), ("a", 3, "insert", 8, "!")], "doc string, seq int, op string, at int, content string")
    after = E.replay(texts, log, ["doc"], "text", "seq")
    assert dict(map(tuple, after.select("doc", "text").collect())) == {"a": ">> héllo!", "b": "same"}
    assert dict(map(tuple, E.replay(after, log, ["doc"], "text", "seq", backwards=True).select("doc", "text").collect())) == {"a": "héllo world", "b": "same"}


def test_props_and_toggles(spark):
    flags = "bold boolean, italic boolean, underline boolean, highlight boolean"
    old = spark.createDataFrame([("d", 0, False, False, False, False, "first"), ("d", 1, True, False, False, False, "b1"), ("d", 2, True, False, False, False, "b2")], f"doc string, pos int, {flags}, props string")
    new = spark.createDataFrame([("d", 0, True, False, False, False, ""), ("d", 1, True, True, False, False, ""), ("e", 0, True, True, False, False, "own")], f"doc string, pos int, {flags}, props string")
    assert sorted((r.doc, r.pos, r.props) for r in E.inherit_props(new, old, ["doc"]).collect()) == [("d", 0, "b1"), ("d", 1, "first"), ("e", 0, "own")]
    chars = spark.createDataFrame([("d", i, on) for i, on in enumerate([True, False, None, True, False])], "doc string, pos int, bold boolean")
    assert sorted((r.start, r.end) for r in E.toggled_ranges(chars, ["doc"], "pos", "bold", True).collect()) == [(1, 3), (4, 5)]
    assert sorted((r.start, r.end) for r in E.toggled_ranges(chars, ["doc"], "pos", "bold", False).collect()) == [(0, 1), (3, 4)]


def test_predicates(spark):
    b = F.lit(True)
    row = spark.range(1).select(
        E.all_covered(F.array(b, b)).alias("a"), E.all_covered(F.array(b, ~b)).alias("b"), E.all_covered(F.array().cast("array<boolean>")).alias("c"),
        E.page_header(b, F.lit("own"), F.lit("first"), F.lit(None)).alias("d"), E.page_header(b, F.lit("own"), F.lit("first"), F.lit("f")).alias("e"),
        E.floats(~b, b, F.lit("paragraph")).alias("f"), E.floats(~b, b, F.lit("margin")).alias("g"),
        E.has_borders(F.expr("map('top', cast(null as int), 'left', 1)")).alias("h"), E.has_borders(F.expr("map('top', cast(null as int))")).alias("i"),
        xml.without_elements(F.lit('<w:p><w:numPr w:x="a>b"><w:numPr>in</w:numPr>s</w:numPr>t<w:numPr/></w:p>'), "numPr").alias("j"),
        E.over_text(F.expr("array(named_struct('x0', 0d, 'y0', 0d, 'x1', 1d, 'y1', 1d))"), F.lit(1.0), F.lit(0.5)).alias("k"), E.reading_fraction(F.lit(5.0), F.lit(10.0), F.lit(20.0)).alias("l"),
    ).first()
    assert tuple(row) == (True, False, False, "own", "first", False, True, True, False, "<w:p>t</w:p>", True, 0.0)


def test_selection_and_topmost(spark):
    pages = spark.createDataFrame([(p, n) for p, n in enumerate([10, 0, 8, 5])], "page int, n int")
    assert [(r.page, r["from"], r.to) for r in E.selection(pages, "page", "n", (2, 4), (0, 7)).orderBy("page").collect()] == [(0, 7, 10), (2, 0, 4)]
    annots = spark.createDataFrame([("d", 0, 0.0, 0.0, 5.0, 5.0), ("d", 1, 2.0, 2.0, 9.0, 9.0), ("d", 2, 8.0, 8.0, 9.0, 9.0)], "doc string, pos int, x0 double, y0 double, x1 double, y1 double")
    assert E.topmost(annots, ["doc"], "pos", 5.0, 5.0).first().pos == 1


def test_words_lines_and_pieces(spark):
    text = "Hello world"
    glyphs = [(c, 72.0 + 6 * i, 0.0, 78.0 + 6 * i, 12.0) for i, c in enumerate(text)] + [(c, 72.0 + 6 * i, 20.0, 78.0 + 6 * i, 32.0) for i, c in enumerate("Second")] + [(c, 114.0 + 6 * i, 20.0, 120.0 + 6 * i, 32.0) for i, c in enumerate("li ")]
    df = spark.createDataFrame([(glyphs,)], "chars array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>").withColumn("lines", L.lines(F.col("chars")))
    at = lambda k: L.word_at(F.col("chars"), F.col("lines"), F.lit(k))
    row = df.select(at(8).alias("a"), at(13).alias("b"), at(5).alias("c"), at(0).alias("d"), at(99).alias("e"), L.line_around(F.col("lines"), F.lit(12)).alias("f"), L.line_around(F.col("lines"), F.lit(99)).alias("g"), L.pieces(F.col("chars"), F.col("lines"), F.lit(5), F.lit(99)).alias("h")).first()
    assert [tuple(x) for x in (row.a, row.b, row.c, row.d, row.e, row.f, row.g)] == [(6, 11), (11, 17), (5, 6), (0, 5), (99, 99), (11, 20), (11, 20)]
    assert [tuple(p) for p in row.h] == [(6, 11), (11, 19)]
    grid = geometry.grid(F.lit(612.0), F.lit(792.0), F.lit(16.0))
    wanted = lambda on: L.tiles_wanted(F.col("g"), F.lit(on), F.lit(0.0), F.lit(0.1), F.lit(0.0), F.lit(0.1))
    tiles = spark.range(1).select(grid.alias("g")).select(wanted(True).alias("on"), wanted(False).alias("off")).first()
    assert len(tiles.on) == 2 and tiles.off == []
