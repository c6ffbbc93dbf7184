"""Elements of a few names: the same cells and sections as of all elements, in plans that shuffle files once."""

import gc
import io
import zipfile

from quire.functions import xml
from quire.plans import package_queries
from quire.sources import files, packages

from .test_sources import W, package

M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
EQUATION = "<m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath>"
CELL = "<w:tc><w:tcPr>{}</w:tcPr>{}</w:tc>"
TABLE = "<w:tbl>" + "".join(
    f"<w:tr>{row}</w:tr>"
    for row in (
        CELL.format('<w:gridSpan w:val="2"/><w:tcPrChange><w:tcPr><w:gridSpan w:val="7"/></w:tcPr></w:tcPrChange>', "<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t a:x='1'>one</w:t><w:tab/><w:br w:type='page'/><w:br/><w:t>žα</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>end</w:t></w:r></w:p>"),
        CELL.format("", f"<w:p><w:r><w:t>is </w:t></w:r>{EQUATION}<m:oMathPara><m:oMath/>{EQUATION}</m:oMathPara><w:r><w:drawing><w:p><w:r><w:t>drawn</w:t></w:r></w:p></w:drawing></w:r></w:p>")
        + CELL.format('<w:gridSpan w:val="x"/>', "<w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>out</w:t></w:r><wps:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></wps:txbxContent></w:p>"),
        "<w:tc/>",
    )
) + "</w:tbl>"
BODY = f"<w:document {W} {M} xmlns:a='a' xmlns:wps='s'><w:body><w:p><w:r><w:t>free</w:t></w:r></w:p>{TABLE}<w:p><w:pPr><w:sectPr><w:pgSz w:w='240'/></w:sectPr></w:pPr></w:p><w:sectPr><w:pgMar w:top='40'/></w:sectPr></w:body></w:document>"


def test_few_elements_give_the_same_cells_and_sections(spark):
    contents = {"whole": {"word/document.xml": BODY, "word/styles.xml": "<a><tc/></a>"}, "cut": {"word/document.xml": BODY[:-30]}, "none": {"other.xml": "<a/>"}}
    found = spark.createDataFrame([*((n, bytearray(package(p)), "docx") for n, p in contents.items()), ("junk", bytearray(b"PK"), "docx")], "path string, content binary, format string")
    whole = files.elements(files.package_parts(found)).cache()
    few = lambda asked: files.few_elements(found, ["word/document.xml"], *asked)
    for read, asked in ((files.cells, files.CELLS), (files.sections, files.SECTIONS)):
        want = sorted(map(str, read(whole).collect()))
        assert want and sorted(map(str, read(few(asked)).collect())) == want
    assert [r.path for r in few(files.CELLS).where("error is not null").collect()] == ["cut"] and few(files.CELLS).where("path = 'cut'").count() == 1
    cells = [(r.row, r.col, r.span, r.text) for r in files.cells(whole).orderBy("tbl", "row", "col").collect()]
    assert cells == [(0, 0, 2, "one\t\nžα\n\nend"), (1, 0, 1, "is a/b    a/b\n"), (1, 1, 1, "\nout"), (2, 0, 1, ""), (0, 0, 1, "in")]


def test_packages_are_those_of_zipfile():
    for parts in ([], [("ž/é.xml", b""), ("a", b"x" * 1000)], [(f"p{k}.xml", bytes([k]) * k) for k in range(200)]):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in parts:
                z.writestr(zipfile.ZipInfo(name), content)
        assert packages.package(parts) == out.getvalue()


def test_tables_are_written_and_read_in_two_shuffles(spark):
    plan = package_queries.tables_to_packages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Line items by order and elements by file; nothing is written between.
    assert plan.count("Exchange") == 2 and plan.count("MapInArrow") == 2 and "ArrowEvalPython" not in plan and "Join" not in plan


def test_sections_are_written_and_read_in_two_shuffles(spark):
    plan = package_queries.page_setups(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("MapInArrow") == 2


def test_a_parser_is_let_go_with_its_file():
    gc.collect()
    gc.disable()
    try:
        for k in range(50):
            xml.walk(b"<a><b/></a>", lambda *_: None, lambda _: None)
        assert not sum(type(x).__name__ == "xmlparser" for x in gc.get_objects())
    finally:
        gc.enable()
