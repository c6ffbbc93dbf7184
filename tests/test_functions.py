import random

import pytest
from pyspark.sql import functions as F

from quire.functions import formats, geometry, numbers
from quire.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("14.4Self-OrganizingMaps529 Noticethatdistanceisdeﬁnedinthespace", "14.4self-organizingmaps529noticethatdistanceisdefinedinthespace"),
        ("Abu‑Mostafa’s “hints”", "abu-mostafa's\"hints\""),
        ("so­ft  x\x85y", "softxy"),
        ("ﬃ ﬄ ﬀ ﬅ ﬆ ΟΣ ς", "ffifflffststοσς"),
        ("", ""),
    ],
)
def test_normalize(spark, text, expected):
    assert one(spark, T.normalize(F.lit(text))) == expected
    assert T.normalize_literal(text) == expected


@pytest.mark.parametrize(("query", "ranges"), [("o", [(4, 5), (7, 8), (15, 16)]), ("SECOND LINE", [(12, 23)]), ("world second", [(6, 18)]), ("absent", []), ("  ", [])])
def test_matches(spark, query, ranges):
    page = "Hello world\nSecond line"
    assert [tuple(r) for r in one(spark, T.match_ranges(F.lit(page), query))] == ranges
    assert one(spark, T.count_matches(F.lit(page), F.lit(query))) == len(ranges)


def test_a_hit_in_a_ligature_is_all_of_it(spark):
    assert [tuple(r) for r in one(spark, T.match_ranges(F.lit("deﬁned ﬁ"), "fin"))] == [(2, 4)]
    assert [tuple(r) for r in one(spark, T.match_ranges(F.lit("aaaa"), "aa"))] == [(0, 2), (2, 4)]
    assert [tuple(r) for r in one(spark, T.match_ranges(F.lit("a.b|c.b"), ".b"))] == [(1, 3), (5, 7)]


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        (b"\xef\xbb\xbfplain", "plain"), ("naïve".encode(), "naïve"), (b"\xff\xfe" + "aé".encode("utf-16le"), "aé"), (b"\xfe\xff" + "aé".encode("utf-16be"), "aé"),
        (b"caf\xe9 \x93q\x94 \x80 \x81", "café “q” € \x81"), (b"", ""), (b"\xff\xfea\x00b", "a"),
    ],
)
def test_decode(spark, content, expected):
    assert one(spark, T.decode_text(F.lit(content))) == expected


@pytest.mark.parametrize(
    ("n", "fmt", "expected"),
    [(4, "lowerRoman", "iv"), (28, "lowerLetter", "bb"), (27, "lowerLetter", "aa"), (3, "ordinal", "3rd"), (12, "ordinal", "12th"), (101, "ordinal", "101st"), (7, "decimalZero", "07"), (0, "upperLetter", ""), (4009, "upperRoman", "MMMMIX"), (5, "bullet", ""), (5, "other", "5")],
)
def test_number(spark, n, fmt, expected):
    assert one(spark, numbers.number(F.lit(n), F.lit(fmt))) == expected


def test_labels_and_bullets(spark):
    counts, kinds = F.array(*map(F.lit, range(1, 10))), F.array(*[F.lit("decimal")] * 9)
    assert one(spark, numbers.label(F.lit("%1.%2) 100% %x"), F.lit("decimal"), counts, kinds)) == "1.2) 100% %x"
    assert one(spark, numbers.label(F.lit("%1"), F.lit("none"), counts, kinds)) == ""
    assert one(spark, numbers.label(F.lit("o"), F.lit("bullet"), counts, kinds)) == "•◦•"


@pytest.mark.parametrize(("name", "expected"), [("a/b.TXT", "text"), ("report", "docx"), ("x.pdf", "pdf"), ("x.dot", "doc"), (".log", "docx"), ("a.md/", "text"), ("x.", "docx"), ("x.tar.gz", "docx")])
def test_format_of(spark, name, expected):
    assert one(spark, formats.format_of(F.lit(name))) == expected


@pytest.mark.parametrize(
    ("content", "expected"),
    [(b"%PDF-1.7 ...", "pdf"), (b"x" * 1000 + b"%PDF-", "pdf"), (b"x" * 1024 + b"%PDF-", "text"), (b"PK\x03\x04", "docx"), ("plain é".encode(), "text"), (bytes([0, 1, 2, 3, 0, 0]), None), (b"\xff\xfea\x00", "text"), (bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 99, "doc"), (b"", "text")],
)
def test_sniff(spark, content, expected):
    assert one(spark, formats.sniff(F.lit(content))) == expected


def test_small_formats(spark):
    checks = [
        (formats.title(F.lit(" Untitled ")), None), (formats.title(F.lit("Microsoft Word - x.doc")), None), (formats.title(F.lit(" A book ")), "A book"),
        (formats.picture_type(F.lit(b"\x89PNG\r\n")), "png"), (formats.picture_type(F.lit(b"\xff\xd8\xff\xe0")), "jpeg"), (formats.picture_type(F.lit(b"abcd")), None),
        (formats.font_family(F.lit("Courier New")), "Courier New,monospace"), (formats.font_family(F.lit("Book Sans")), "Book Sans,sans-serif"), (formats.font_family(F.lit("Georgia")), "Georgia,serif"),
        (formats.paper(F.lit("en_US.UTF-8")), "letter"), (formats.paper(F.lit("de_DE@euro")), "a4"), (formats.paper(F.lit("C")), "letter"),
        (formats.resolve_path(F.lit("word/"), F.lit("../media/./a.png")), "media/a.png"), (formats.resolve_path(F.lit("word"), F.lit("/abs/x")), "abs/x"), (formats.resolve_path(F.lit(""), F.lit("../../x")), "x"),
        (formats.rels_path(F.lit("word/document.xml")), "word/_rels/document.xml.rels"),
        (formats.colour(F.lit("00FF10")), 0xFF10), (formats.colour(F.lit("auto")), None), (formats.highlight(F.lit("darkBlue")), "000080"), (formats.indexed_colour(F.lit(2)), "0000FF"), (formats.indexed_colour(F.lit(0)), None),
        (formats.nearest_indexed(F.lit(250), F.lit(3), F.lit(4)), 6), (formats.css_length_emu(F.lit("1.5in")), 1371600), (formats.css_length_emu(F.lit("2")), 25400), (formats.css_length_emu(F.lit("2em")), None), (formats.css_length_emu(F.lit("x")), None),
        (formats.twips(F.lit("240")), 12.0), (formats.toggle(F.lit("0")), False), (formats.toggle(F.lit(None).cast("string")), True), (formats.toggle(F.lit("off")), True),
        (formats.field_kind(F.lit(" page \\* x")), "page"), (formats.field_kind(F.lit("NUMPAGES")), "pages"), (formats.field_kind(F.lit("DATE")), None),
        (formats.style_id(F.lit("heading"), F.lit(9)), "Heading6"), (formats.style_id(F.lit("normal"), F.lit(0)), None), (formats.list_level(F.lit(0), F.lit(2)), None), (formats.list_level(F.lit(3), F.lit(None).cast("int")), 0),
        (formats.shown_kind(F.lit("Ink")), "Drawing"), (formats.is_tiff(F.lit(b"MM\x00*....")), True), (formats.is_tiff_name(F.lit("a.TIF")), True),
        (formats.pdf_date(F.lit("2024-02-29 01:02:03").cast("timestamp")), "D:20240229010203Z"), (T.win_ansi(F.lit("a€é中")), "6180E93F"), (T.one_line(F.lit(" a \n b ")), "a b"), (T.pdf_string(F.lit("a(b)\\")), "(a\\(b\\)\\\\)"),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(checks)]).first()
    for i, (_, expected) in enumerate(checks):
        assert row[i] == expected, i
    kinds = {("Title", None): ("title", 0), ("heading 3", None): ("heading", 3), ("Heading9", None): ("heading", 6), ("HeadingX", None): ("heading", 1), ("IntenseQuote", None): ("quote", 0), ("ListBullet", None): ("list", 0), (None, 1): ("heading", 2), ("Body", 8): ("heading", 6), ("Body", None): ("normal", 0), ("Title", 3): ("title", 0)}
    for (style, outline), expected in kinds.items():
        assert tuple(one(spark, formats.style_kind(F.lit(style), F.lit(outline).cast("int")))) == expected


def test_geometry(spark):
    grid = lambda w, h, s: one(spark, geometry.grid(F.lit(w), F.lit(h), F.lit(s)))
    assert all(grid(612.0, 792.0, s).cols == 1 for s in (0.5, 1.0, 2.0, 4.0))
    for w, h, s in ((612.0, 792.0, 16.0), (2384.0, 3370.0, 9.0), (72.0, 72.0, 400.0)):
        g = grid(w, h, s)
        assert g.cols > 1
        tiles = one(spark, geometry.tiles_over(F.lit(0) * 0 + geometry.grid(F.lit(w), F.lit(h), F.lit(s)) if False else geometry.grid(F.lit(w), F.lit(h), F.lit(s)), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)))
        assert len(tiles) == g.cols * g.rows
        area = sum(min(g.tile_w, g.width - t.col * g.tile_w) * min(g.tile_h, g.height - t.row * g.tile_h) for t in tiles)
        assert area == g.width * g.height
    spread = lambda per, cover, p, n: tuple(one(spark, geometry.spread_of(per, cover, F.lit(p), F.lit(n))))
    assert [spread(2, False, p, 5) for p in range(5)] == [(0, 2), (0, 2), (2, 4), (2, 4), (4, 5)]
    assert [spread(2, True, p, 5) for p in range(5)] == [(0, 1), (1, 3), (1, 3), (3, 5), (3, 5)]
    assert spread(1, True, 3, 5) == (3, 4) and spread(2, True, 0, 0) == (0, 0)
    assert [one(spark, geometry.tap_turn(F.lit(x), F.lit(90.0))) for x in (0.0, 29.0, 45.0, 61.0, 91.0)] == ["previous", "previous", None, "next", None]
    assert one(spark, geometry.turned(F.lit(0), F.lit(-90))) == 270
    assert abs(one(spark, geometry.fit_scale(F.lit(612.0), F.lit(792.0), F.lit(4e6))) - (4e6 / (612 * 792)) ** 0.5) < 1e-9
    assert tuple(one(spark, geometry.flow_point(F.lit(1), F.lit(0.25), F.lit(0.5)))) == (0.5, 0.75)


def _matches(text, query):
    """Ranges found letter by letter."""
    letters = [(n, i) for i, c in enumerate(text) for n in T.normalize_literal(c)]
    q, at, found = T.normalize_literal(query), 0, []
    while at + len(q) <= len(letters):
        if all(letters[at + k][0] == c for k, c in enumerate(q)):
            found.append((letters[at][1], letters[at + len(q) - 1][1] + 1))
            at += len(q)
        else:
            at += 1
    return found


def test_matches_by_pattern_and_by_owners(spark):
    rng = random.Random(5)
    texts = ["", None, "\u212aelvin K \u212a", "\u212b\xe5 \xc5", "Οδός ΣΑΣ", "i\u0307 İ", "😀th th😀 T\xadh\u2003TH"]
    texts += ["".join(rng.choices("tThH \n\u3000\xad", k=30)) for _ in range(60)] + ["".join(rng.choices("fFiIlsStTİſﬁﬃﬆ \u2019'.-–", k=40)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for query in ("TH th", "k", "å", "σας", "fi", "ff", "st", "t'", "-", ".", "İ", "i", "  "):
        got = rows.select("id", T.holds(F.col("text"), query).alias("held"), T.match_ranges(F.col("text"), query).alias("m")).collect()
        for r in got:
            want = _matches(texts[r.id], query) if texts[r.id] and T.normalize_literal(query) else []
            assert [tuple(x) for x in r.m or []] == want, (query, texts[r.id])
            assert bool(r.held) == bool(want)


def test_search_looks_at_texts_as_they_are(spark):
    from quire.operators import search

    pages = spark.createDataFrame([("a",)], "text string")
    plan = lambda query: search.search(pages, "text", query)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan("dogma") and "RLIKE" in plan("dogma")
    assert plan("TH th").index("RLIKE") < plan("TH th").index("regexp_replace")
