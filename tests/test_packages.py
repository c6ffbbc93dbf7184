"""Packages written back: what is kept stays byte for byte, what is edited is made anew, and packages join into one."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import equations, xml
from quire.plans import merge
from quire.sources import files, packages, sinks

from .test_sources import W, package

R = f'xmlns:r="{packages.OFFICE_NS}"'
PNG = b"\x89PNG\r\n orchard"
SHEET = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="Heading2"/></w:styles>'


def document(body, extra=""):
    return f"<w:document {W} {R} {extra}><w:body>{body}</w:body></w:document>"


def docx(body, **parts):
    names = {"styles": "word/styles.xml", "numbering": "word/numbering.xml", "rels": "word/_rels/document.xml.rels", "picture": "word/media/pear.png"}
    return package({"[Content_Types].xml": sinks.CONTENT_TYPES.replace("<Override", '<Default Extension="png" ContentType="image/png"/><Override', 1), "word/document.xml": document(body)} | {names.get(k, k): v for k, v in parts.items()})


def part(content, name="word/document.xml"):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.read(name).decode() if name in z.namelist() else None


def names(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return sorted(z.namelist())


@pytest.fixture
def save(spark):
    def run(content, *lines):
        found = spark.createDataFrame([("a", bytearray(content), "docx")], "path string, content binary, format string")
        rows = [("a", k, line["action"], line.get("item"), line.get("kind", "normal"), line.get("level", 0), line.get("align"), line.get("runs"), line.get("xml")) for k, line in enumerate(lines)]
        out = spark.createDataFrame(rows, f"path string, seq int, action string, item int, kind string, level int, align string, runs array<{packages.RUN}>, xml string")
        return bytes(packages.save(found, out).first().content)

    return run


def keep(i):
    return {"action": "keep", "item": i}


def para(text, item=None, **more):
    run = {"text": text, "bold": False, "italic": False, "underline": False, "highlight": False, "props": "", "drawing": None} | more.pop("run", {})
    return {"action": "para", "item": item, "runs": [run]} | more


MIXED = '<w:bookmarkStart w:id="4"/><w:p><w:pPr><w:jc w:val="right"/></w:pPr><w:r><w:rPr><w:rFonts w:ascii="Gentium"/><w:sz w:val="19"/></w:rPr><w:t>Pears &amp; figs</w:t></w:r></w:p> <w:bookmarkEnd w:id="4"/><w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r></w:p><w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl><w:sectPr><w:pgSz w:w="9000"/></w:sectPr>'


def test_unchanged_documents_keep_every_byte(save, spark):
    content = docx(MIXED)
    found = spark.createDataFrame([("a", bytearray(content), "docx")], "path string, content binary, format string")
    items = files.items(files.elements(files.package_parts(found))).orderBy("item").collect()
    assert [(r.kind, r.n_blocks) for r in items] == [("other", 0), ("paragraph", 1), ("other", 0), ("locked", 1), ("table", 1), ("other", 0)]
    assert part(save(content, keep(1), keep(3), keep(4))) == part(content)


def test_an_edit_touches_its_paragraph_only(save):
    run = {"bold": True, "props": '<w:rFonts w:ascii="Gentium"/><w:sz w:val="19"/><w:i/>'}
    made = part(save(docx(MIXED), para("Figs <only>\tnow\nhere", 1, run=run), keep(3), para("Coda", kind="heading", level=2)))
    assert '<w:p><w:pPr><w:jc w:val="right"/></w:pPr><w:r><w:rPr><w:rFonts w:ascii="Gentium"/><w:b/><w:sz w:val="19"/></w:rPr><w:t xml:space="preserve">Figs &lt;only&gt;</w:t><w:tab/><w:t xml:space="preserve">now</w:t><w:br/><w:t xml:space="preserve">here</w:t></w:r></w:p>' in made
    assert '<w:pPr><w:outlineLvl w:val="1"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="26"/></w:rPr>' in made  # no such style: formatted directly
    # Bookmarks stay before what they stood before; section properties end the body; the table is gone.
    assert made.index("bookmarkStart") < made.index("Figs") < made.index("bookmarkEnd") < made.index("fldChar") < made.index("Coda") < made.index("<w:sectPr>") and "<w:tbl>" not in made
    assert part(save(docx(MIXED, styles=SHEET), para("Coda", kind="heading", level=2))).count('<w:pStyle w:val="Heading2"/>') == 1


def test_lists_and_quotes(save):
    listed = '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="7"/></w:numPr><w:spacing w:after="2"/></w:pPr><w:r><w:t>x</w:t></w:r></w:p>'
    bulleted = f'<w:numbering {W}><w:abstractNum w:abstractNumId="3"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="9"><w:abstractNumId w:val="3"/></w:num></w:numbering>'
    made = part(save(docx(listed, numbering=bulleted), para("deeper", 0, kind="list", level=1), para("new", kind="list", level=2), para("said", kind="quote", align="center")))
    assert '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="7"/></w:numPr><w:spacing w:after="2"/>' in made and '<w:numPr><w:ilvl w:val="2"/><w:numId w:val="9"/></w:numPr>' in made
    assert '<w:ind w:left="480"/><w:jc w:val="center"/>' in made and "<w:i/>" in made
    assert "• " in part(save(docx("<w:p/>"), para("typed", kind="list")))


def test_runs_fields_notes_and_equations(spark):
    body = (
        '<w:p><w:r><w:rPr><w:b/><w:vanish/></w:rPr><w:t>dark</w:t></w:r><w:r><w:t>a</w:t><w:noBreakHyphen/><w:sym w:char="F041"/></w:r><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> NUMPAGES </w:instrText></w:r>'
        '<w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>12</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:fldSimple w:instr="PAGE"><w:r><w:t>3</w:t></w:r></w:fldSimple><w:r><w:footnoteReference w:id="5"/></w:r>'
        '<m:oMath><m:r><m:t>k</m:t></m:r></m:oMath><w:r><w:br w:type="page"/></w:r><w:r><w:t>end</w:t></w:r></w:p>'
    )
    found = spark.createDataFrame([("a", bytearray(package({"word/document.xml": document(body, 'xmlns:m="m"')})), "docx")], "path string, content binary, format string")
    shredded = files.elements(files.package_parts(found))
    got = files.runs(shredded).orderBy("pos").collect()
    assert [(r.text, r.field, r.placeholder) for r in got] == [("dark", None, False), ("a‑A", None, False), ("12", "pages", False), ("3", "page", False), ("*", None, False), ("k", None, True), ("[page break]", None, True), ("end", None, False)]
    assert got[0].bold and got[0].hidden and got[0].props == "<w:b/><w:vanish/>" and got[4].note_id == 5 and got[4].foot and got[5].math == "<i>k</i>"
    assert files.paragraphs(shredded).first().text == "darka123kend"


def test_equations():
    r = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"
    cases = {
        f"<m:oMath><m:func><m:fName>{r('sin')}</m:fName><m:e>{r('t')}</m:e></m:func></m:oMath>": ("sin t", "sin <i>t</i>"),
        f"<m:oMath><m:limLow><m:e>{r('lim')}</m:e><m:lim>{r('Z')}</m:lim></m:limLow></m:oMath>": ("lim_(Z)", "<i>l</i><i>i</i><i>m</i><sub><i>Z</i></sub>"),
        f'<m:oMath><m:nary><m:naryPr><m:supHide m:val="1"/></m:naryPr><m:sub>{r("0")}</m:sub><m:sup>{r("9")}</m:sup><m:e>{r("u")}</m:e></m:nary></m:oMath>': ("∫₀ u", "∫<sub>0</sub> <i>u</i>"),
        f"<m:oMath><m:rad><m:deg>{r('3')}</m:deg><m:e>{r('x+y')}</m:e></m:rad></m:oMath>": ("³√(x+y)", "<sup>3</sup>√(<i>x</i>+<i>y</i>)"),
        f"<m:oMath><m:m><m:mr><m:e>{r('1')}</m:e><m:e>{r('2')}</m:e></m:mr><m:mr><m:e>{r('3')}</m:e><m:e>{r('4')}</m:e></m:mr></m:m></m:oMath>": ("1  2; 3  4", "1  2; 3  4"),
        f'<m:oMath><m:acc><m:accPr><m:chr m:val="→"/></m:accPr><m:e>{r("v")}</m:e></m:acc><m:bar><m:e>{r("w")}</m:e></m:bar></m:oMath>': ("v→w", '<i>v</i>→<span overline="single"><i>w</i></span>'),
        '<m:oMath><m:r><m:rPr><m:sty m:val="p"/></m:rPr><m:t>d&lt;</m:t></m:r><m:r>': ("d<", "d&lt;"),  # broken off
        "": ("", ""),
    }
    for source, want in cases.items():
        assert tuple(equations.linear(source)) == want


def test_xml_helpers():
    assert xml.stripped("<a><n><n/>x</n>é<b><n y='>'/></b></a>", {"n"}) == "<a>é<b></b></a>"
    assert xml.stripped("<broken", {"n"}) == "<broken" and xml.children("<x") == [] and xml.inner("<p/>", "p") == "" and xml.inner("<p/>", "q") is None
    assert xml.splice(b"0123456789", [(7, 8, b""), (2, 4, b"ab")]) == b"01ab45689"
    assert xml.declared('<w:d xmlns:w="u"><w:b r:x="1"/>', {"w": "u", "r": "v"}) == '<w:d xmlns:w="u" xmlns:r="v"><w:b r:x="1"/>'


NUMBERS = f'<w:numbering {W}><w:abstractNum w:abstractNumId="4"><w:lvl w:ilvl="0"/></w:abstractNum><w:num w:numId="6"><w:abstractNumId w:val="4"/></w:num></w:numbering>'


def test_merge_brings_all_that_a_body_refers_to(spark):
    first = docx('<w:p><w:r><w:t>Plums</w:t></w:r></w:p><w:sectPr><w:pgSz w:w="7000"/></w:sectPr>', styles=SHEET, numbering=NUMBERS)
    rels = (
        '<Relationships><Relationship Id="one" Type="t/image" Target="media/pear.png"/><Relationship Id="two" Type="t/chart" Target="charts/c.xml"/><Relationship Id="web" Type="t/link" Target="http://p.example/?a&amp;b" TargetMode="External"/>'
        '<Relationship Id="unused" Type="t/x" Target="unused.xml"/></Relationships>'
    )
    inner = '<Relationships><Relationship Id="c1" Type="t/data" Target="../embeddings/d.bin"/><Relationship Id="c2" Type="t/loop" Target="c.xml"/></Relationships>'
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Fancy"/><w:numPr><w:numId w:val="6"/></w:numPr></w:pPr><w:r><w:t>Pears</w:t><w:footnoteReference w:id="2"/></w:r></w:p><w:p><w:hyperlink r:id="web"/><w:r><w:drawing r:embed="one"/></w:r><c:chart r:id="two"/></w:p><w:sectPr/>'
    )
    second = docx(body, styles=SHEET.replace("<w:style ", '<w:style w:styleId="Fancy" w:type="paragraph"/><w:style ', 1), numbering=NUMBERS, rels=rels, picture=PNG, **{"word/charts/c.xml": "<c/>", "word/charts/_rels/c.xml.rels": inner, "word/embeddings/d.bin": b"d", "word/unused.xml": "<u/>"})
    third = docx('<w:p><w:pPr><w:numPr><w:numId w:val="6"/></w:numPr></w:pPr><w:r><w:t>Quinces</w:t></w:r></w:p>', styles=SHEET.replace('"Heading2"', '"Fancy" w:customStyle="1"'))
    lone = docx("<w:p><w:r><w:t>A</w:t></w:r></w:p>")
    rows = [(1, 0, first), (1, 1, second), (1, 2, third), (2, 0, lone), (2, 1, second)]
    found = spark.createDataFrame([(j, n, bytearray(c)) for j, n, c in rows], "job int, file_no int, content binary")
    made = {r.job: bytes(r.content) for r in merge.merge(found).collect()}

    text = part(made[1])
    assert text.index("Plums") < text.index('w:type="page"') < text.index("Pears") < text.index("Quinces") < text.index("<w:sectPr>") and text.count("sectPr") == 2 and text.count('w:type="page"') == 2
    assert 'r:id="f1.web"' in text and 'r:embed="f1.one"' in text and "footnoteReference" not in text
    assert '<w:numId w:val="13"/>' in text and text.count("numPr") == 2  # 6 moved behind the first one's 6; the third has no definitions
    numbers = part(made[1], "word/numbering.xml")
    assert 'abstractNumId="9"' in numbers and '<w:num w:numId="13"><w:abstractNumId w:val="9"/>' in numbers and numbers.index('abstractNumId="9"') < numbers.index("<w:num ")
    styles = part(made[1], "word/styles.xml")
    assert styles.count('"Heading2"') == 1 and styles.count('"Fancy"') == 1 and "customStyle" not in styles
    assert {"word/media/from1-pear.png", "word/charts/from1-c.xml", "word/charts/_rels/from1-c.xml.rels", "word/embeddings/from1-d.bin"} <= set(names(made[1])) and not any("unused" in n for n in names(made[1]))
    inner_rels = part(made[1], "word/charts/_rels/from1-c.xml.rels")
    assert 'Target="/word/embeddings/from1-d.bin"' in inner_rels and 'Target="/word/charts/from1-c.xml"' in inner_rels
    rels_made = part(made[1], "word/_rels/document.xml.rels")
    assert 'Id="f1.one" Type="t/image" Target="media/from1-pear.png"' in rels_made and 'Target="http://p.example/?a&amp;b" TargetMode="External"' in rels_made and "unused" not in rels_made
    with zipfile.ZipFile(io.BytesIO(made[1])) as z:
        assert z.read("word/media/from1-pear.png") == PNG

    # A first package without lists gets a numbering part, with its relationship and its type.
    assert 'Id="fNumbering"' in part(made[2], "word/_rels/document.xml.rels") and 'PartName="/word/numbering.xml"' in part(made[2], "[Content_Types].xml") and '<w:num w:numId="7">' in part(made[2], "word/numbering.xml")
    back = files.paragraphs(files.elements(files.package_parts(spark.createDataFrame([("m", bytearray(made[1]), "docx")], "path string, content binary, format string")))).orderBy("pos")
    assert [r.text for r in back.collect()] == ["Plums", "", "Pears", "", "", "Quinces"]


def test_pictures_and_tables_as_xml(spark):
    made = spark.range(1).select(packages.drawing_xml(F.lit("rId9"), F.lit(3), F.lit(914400), F.lit(0)).alias("x")).first().x
    assert [n for n, _ in xml.children(made)] == ["drawing"] and 'r:embed="rId9"' in made and 'cx="914400" cy="1"' in made and made.count('id="3"') == 2
    cells = spark.createDataFrame([(1, 0, 0, "a<b\nc", 2, False, "AABB00"), (1, 1, 0, "d", 1, True, None)], "t int, row int, col int, text string, span int, merged boolean, shade string")
    table = packages.table_xml(cells, ["t"], 100.0).first().xml
    assert '<w:tblW w:w="2000"' in table and table.count("<w:gridCol") == 2 and '<w:gridSpan w:val="2"/><w:shd w:val="clear" w:color="auto" w:fill="AABB00"/>' in table and "<w:vMerge/>" in table and "a&lt;b" in table
    assert table.count("<w:tc>") == 3 and table.count("<w:p>") == 3  # the short row is filled out


def test_new_packages_have_styles_lists_and_paper(spark):
    rows = spark.createDataFrame([("a", 0, "Almanac", "title", 0, None), ("a", 1, "Spring", "heading", 3, None), ("a", 2, "sow", "list", 1, 1), ("a", 3, "wait", "quote", 0, None), ("a", 4, "plain", "normal", 0, None)], "path string, pos int, text string, kind string, level int, num int")
    made = sinks.packages(rows, ["path"], "letter").withColumn("format", F.lit("docx"))
    shredded = files.elements(files.package_parts(made))
    back = files.paragraphs(shredded).orderBy("pos").collect()
    assert [(r.text, r.kind, r.style_level, r.num, r.level) for r in back] == [("Almanac", "title", 0, None, None), ("Spring", "heading", 3, None, None), ("sow", "list", 0, 1, 1), ("wait", "quote", 0, None, None), ("plain", "normal", 0, None, None)]
    named = {r.style_id: r for r in files.styles(shredded).collect()}
    assert {r.style_id for r in back if r.style_id} <= set(named) and named["Heading3"].size == 12.0 and named["Heading3"].based_on == "Normal"
    assert [(r.width, r.height, r.left) for r in files.sections(shredded).collect()] == [(612.0, 792.0, 72.0)]
    assert {r.num for r in files.list_levels(shredded).where("format = 'bullet'").collect()} == {1}
    by_name, _ = files.content_types(shredded)
    assert {r.name for r in by_name.collect()} == {"word/document.xml", "word/styles.xml", "word/numbering.xml"} <= set(names(bytes(made.first().content)))


def test_new_pictures_are_numbered_by_their_first_place(spark):
    rng = random.Random(6)
    kinds = [b"\x89PNG" + bytes([k]) for k in range(6)] + [b"no picture"]
    placed = [(d, p, rng.choice(kinds)) for d in range(5) for p in range(40)]
    taken = spark.createDataFrame([(d, d, 10 * d) for d in range(1, 5)], "doc int, n int, drawing int")
    plan = packages.media_plan(spark.createDataFrame(rng.sample(placed, len(placed)), "doc int, pos int, content binary"), taken, ["doc"], "pos")
    text = plan._jdf.queryExecution().executedPlan().toString()
    # Rows are dealt by number, by content and then by document, and nothing is gathered or broadcast by its packed size.
    assert text.count("REPARTITION_BY_NUM") == 2 and "Broadcast" not in text and "Aggregate" not in text
    want, numbers, drawn = [], {}, {}
    for d, p, content in placed:
        if content != b"no picture":
            here = numbers.setdefault(d, {})
            added = content not in here
            n = here.setdefault(content, len(here) + 1) + d
            drawn[d] = drawn.get(d, 10 * d) + 1
            want.append((d, p, f"rIdPicture{n}", f"word/media/picture{n}.png", added, drawn[d]))
    assert sorted(map(tuple, plan.collect())) == want
