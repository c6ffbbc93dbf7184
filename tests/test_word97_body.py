"""Formatted Word 97 files: pieces, pages of changes, fields, cells, converting."""

import io
import random
import struct
import zipfile

import pytest

from quire.plans import convert
from quire.sources import files, word97, word97_body

STYLES = [(0, "Normal"), (1, "heading 1"), (62, "Title"), (0, "My Quote"), (0, "List Bullet")]
FONTS = ["Georgia", "Arial"]


def sprm(code, value):
    return struct.pack("<H", code) + value.to_bytes(word97.OPERANDS[code >> 13], "little")


def run(text, *told):
    return {"text": text, "changes": b"".join(sprm(*t) for t in told)}


def para(*runs, style=0, mark="\r", told=()):
    return {"style": style, "mark": mark, "changes": b"".join(sprm(*t) for t in told), "runs": list(runs)}


def found(spark, **docs):
    return spark.createDataFrame([(k, v, "doc") for k, v in docs.items()], "path string, content binary, format string")


def read(spark, *paragraphs):
    doc = word97.formatted_document(list(paragraphs), STYLES, FONTS)
    return word97_body.body(found(spark, d=doc)).orderBy("paragraph")


BOLD, ITALIC = (0x0835, 1), (0x0836, 0x81)


def test_looks_over_two_pieces(spark):
    rows = read(
        spark,
        para(run("plain "), run("bold", BOLD), run(" and ", BOLD), run("both", BOLD, ITALIC, (0x4A43, 36), (0x4A4F, 1)), told=[(0x2461, 1)]),
        para(run("Žluť 😀 "), run("red", (0x6870, 0x0000C0)), run("x", (0x2A42, 2)), run("auto", (0x6870, 0xFF000000)), run("gone", (0x083C, 1)), style=1),
        para(run("a\x0bb\x1ec\x02￼\td")),
        para(run("x\x0cy"), run("\x01", (0x0855, 1), (0x6A03, 77)), run("\x01")),
        para(),
    ).collect()
    text = [[(r.text, r.bold, r.italic, r.half_points, r.colour, r.font) for r in p.runs] for p in rows]
    none = (False, False, None, None, None)
    assert text[0] == [("plain ", *none), ("bold and ", True, False, None, None, None), ("both", True, True, 36, None, "Arial")]
    assert text[1] == [("Žluť 😀 ", *none), ("red", False, False, None, "C00000", None), ("x", False, False, None, "0000FF", None), ("auto", *none)]
    assert [r.text for r in rows[2].runs] == ["a\nb-c\td"]
    assert [(r.kind, r.text, r.picture) for r in rows[3].runs] == [("text", "x", None), ("page", "", None), ("text", "y", None), ("picture", "", 77)]
    assert rows[4].runs == [] and [r.paragraph for r in rows] == [0, 1, 2, 3, 4]
    assert [(r.align, r.style, r.sti) for r in rows[:2]] == [("center", "Normal", 0), ("left", "heading 1", 1)]


def test_kinds(spark):
    rows = word97_body.kinds(read(spark, para(style=1), para(style=2), para(style=3), para(style=4, told=[(0x260A, 2)]), para(told=[(0x2640, 1)]), para(told=[(0x460B, 3)]), para())).orderBy("paragraph").collect()
    assert [(r.kind, r.kind_level) for r in rows] == [("heading", 1), ("title", 0), ("quote", 0), ("list", 2), ("heading", 2), ("list", 0), ("normal", 0)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a\x13CODE\x14shown\x15b", "ashownb"),
        ("a\x13CODE\x15b", "ab"),
        ("a\x13X\x13Y\x14in\x15Z\x14out\x13W\x14deep\x15\x15b", "aoutdeepb"),
        ("a\x15\x15b\x13C\x14d\x14e\x15f", "abdef"),
        ("a\x14b\x13cut off", "ab"),
    ],
)
def test_fields_show_their_results(spark, text, want):
    assert "".join(r.text for p in read(spark, para(run(text))).collect() for r in p.runs) == want


def test_long_documents_meet_changes_by_blocks(spark):
    rng = random.Random(3)
    paragraphs = []
    for k in range(300):
        letters = "abc" if k % 40 < 20 else "žα😀b"
        paragraphs.append(para(*[run("".join(rng.choices(letters, k=rng.randrange(0, 90))), (0x0835, j % 2), (0x4A43, 20 + rng.randrange(9))) for j in range(rng.randrange(6))], told=[(0x2461, k % 3)]))
    paragraphs.append(para(run("w" * 60_000, (0x4A43, 31))))
    rows = read(spark, *paragraphs).collect()
    assert len(rows) == len(paragraphs)
    for want, got in zip(paragraphs, rows, strict=True):
        merged = []
        for r in want["runs"]:
            if not r["text"]:
                continue
            look = (r["changes"][2] == 1 if r["changes"][:2] == b"\x35\x08" else False, r["changes"][-2])
            if merged and merged[-1][0] == look:
                merged[-1][1] += r["text"]
            else:
                merged.append([look, r["text"]])
        assert [[(r.bold, r.half_points), r.text] for r in got.runs] == merged


def cell(text, depth=1, **more):
    return para(run(text), mark="\x07" if depth == 1 else "\r", told=[(0x2416, 1), (0x6649, depth), *more.get("told", [])])


ROW = [(0x2417, 1)]


def test_cells_of_nested_tables(spark):
    inner = [cell("i1", 2, told=[(0x244B, 1)]), cell("i2", 2, told=[(0x244B, 1)]), cell("", 2, told=[(0x244C, 1)])]
    rows = read(
        spark, para(run("before")), cell("a"), para(run("b"), told=[(0x2416, 1)]), cell("c"), cell("", told=ROW), cell("d"), para(run("e"), told=[(0x2416, 1)]), *inner, cell("f"), cell("", told=ROW), para(run("after")), cell("only"), cell("", told=ROW)
    )
    got = sorted(tuple(r) for r in word97_body.cells(rows).drop("path").collect())
    assert got == [(1, 1, 0, 0, "a"), (1, 1, 0, 1, "b\nc"), (1, 1, 1, 0, "d"), (1, 1, 1, 1, "e\ni1\ni2\n\nf"), (1, 13, 0, 0, "only"), (2, 7, 0, 0, "i1"), (2, 7, 0, 1, "i2")]


def test_unreadable_and_plain_files(spark):
    good = word97.formatted_document([para(run("x"))], STYLES, FONTS)
    df = found(spark, bad=good[:700], none=None, plain=word97.text_document("one\ntwo"), empty=word97.text_document(""))
    assert {(r.path, r.kind) for r in word97_body.layout(df).where("kind = 'error'").collect()} == {("bad", "error"), ("none", "error")}
    rows = word97_body.body(df).orderBy("paragraph").collect()
    assert [(r.path, r.mark, [x.text for x in r.runs]) for r in rows] == [("plain", "\r", ["one"]), ("plain", None, ["two"])]
    assert word97_body.body(df.limit(0)).count() == 0


def test_odd_changes():
    definition = struct.pack("<H", 0xD608) + struct.pack("<H", 600) + bytes([1]) + b"\0" * 24 + sprm(0x2417, 1)
    assert [c for c, _ in word97.changes(definition)] == [0xD608, 0x2417]
    tabs = struct.pack("<H", 0xC615) + bytes([255, 1]) + b"\0" * 4 + bytes([2]) + b"\0" * 6 + sprm(0x2416, 1)
    assert [c for c, _ in word97.changes(tabs)] == [0xC615, 0x2416]


def test_converted_files_keep_looks_and_tables(spark):
    doc = word97.formatted_document([para(run("Head"), style=1), para(run("plain "), run("big", BOLD, (0x4A43, 36), (0x6870, 0x0000C0), (0x4A4F, 0))), cell("a"), cell("b"), cell("", told=ROW), para(run("x\x0cend"), told=[(0x2461, 2)])], STYLES, FONTS)
    made = convert.convert(found(spark, d=doc), "docx").collect()[0]
    assert made.error is None
    back = spark.createDataFrame([("d", bytes(made.content), "docx")], "path string, content binary, format string")
    shredded = files.elements(files.package_parts(back)).cache()
    runs = {r.text: r for r in files.runs(shredded).collect()}
    assert runs["big"].bold and not runs["plain "].bold
    xml = zipfile.ZipFile(io.BytesIO(made.content)).read("word/document.xml").decode()
    for part in ('w:val="36"', 'w:val="C00000"', 'w:ascii="Georgia"', '<w:br w:type="page"/>', '<w:jc w:val="right"/>', 'w:val="Heading1"'):
        assert part in xml, part
    assert sorted(tuple(r)[1:] for r in files.cells(shredded).select("path", "row", "col", "text").collect()) == [(0, 0, "a"), (0, 1, "b")]


def test_a_file_is_parsed_once_and_shuffled_twice(spark):
    plan = word97_body.cells(word97_body.body(found(spark, d=b"")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hash") == 2 and "BroadcastExchange" not in plan and "CartesianProduct" not in plan


def test_lines_are_paragraphs_without_looks(spark):
    inner = [cell("i1", 2, told=[(0x244B, 1)]), cell("i2", 2, told=[(0x244B, 1)]), cell("", 2, told=[(0x244C, 1)])]
    paragraphs = [
        para(run("a\x13CODE\x14sh"), run("own", BOLD), run("\x15b\x0cc"), run("gone", (0x083C, 1)), run("\x01", (0x0855, 1)), style=1, told=[(0x2461, 1), (0x260A, 2)]), para(),
        *[p for k in range(400) for p in (cell(f"n{k}"), para(run("žα😀" * (k % 50)), told=[(0x2416, 1)]), *inner, cell("f"), cell("", told=ROW))], para(run("Ž after"), run(" all", ITALIC)), cell("lone"),
    ]
    df = found(spark, d=word97.formatted_document(paragraphs, STYLES, FONTS), plain=word97.text_document("one\ntwo"), none=None)
    whole, lines = word97_body.body(df).cache(), word97_body.lines(df).cache()
    want = sorted((*r[:-1], "".join(x.text for x in r.runs if x.kind == "text")) for r in whole.collect())
    assert want == sorted(map(tuple, lines.collect())) and len(want) == len(paragraphs) + 2
    cells = sorted(map(tuple, word97_body.cells(whole).drop("path").collect()))
    assert cells == sorted(map(tuple, word97_body.cells(lines).drop("path").collect())) and len(cells) == 400 * 4 + 1


def test_the_query_of_cells_deals_its_files_and_blocks(spark):
    from quire.plans import package_queries

    plan = package_queries.word97_cells(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Line items by order, blocks, files; Spark's sizes of small rows decide nothing about the first two, where the files are made and read.
    assert plan.count("Exchange hash") == 3 and plan.count("REPARTITION_BY_NUM") == 2 and plan.count("MapInArrow") == 2


def test_neighbours_that_say_the_same_are_one_span():
    same = [para(run("one"), run(" two")), para(run("three"))]
    content = word97.formatted_document([*same, para(run("four", BOLD)), para(run("five"), told=[(0x2461, 1)])], STYLES, FONTS)
    ((_, texts, spans),) = word97_body._blocks(content)
    # Both first paragraphs; the bold text; its mark; the one that is centred.
    assert [b - a for a, b, *_ in spans] == [len("one two\rthree\r"), len("four"), 1, len("five\r")] and len(texts) == 1
