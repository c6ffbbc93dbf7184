"""Style sheets: property sets, defaults, themes, chains."""

import io
import zipfile

from quire.sources import files, sheets

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def style(id_, *inner, based=None, kind="paragraph", more=""):
    return f'<w:style w:type="{kind}" w:styleId="{id_}"{more}>' + (f'<w:basedOn w:val="{based}"/>' if based else "") + "".join(inner) + "</w:style>"


def r(xml):
    return f"<w:rPr>{xml}</w:rPr>"


def p(xml):
    return f"<w:pPr>{xml}</w:pPr>"


def looks(spark, *styles, theme=None, defaults=""):
    parts = {"word/styles.xml": f"<w:styles {W}>{defaults}{''.join(styles)}</w:styles>"}
    if theme is not None:
        parts["word/theme/theme1.xml"] = f'<a:theme xmlns:a="a">{theme}</a:theme>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    shredded = files.elements(files.package_parts(spark.createDataFrame([("d", out.getvalue(), "docx")], "path string, content binary, format string"))).cache()
    return {x.style_id: x for x in sheets.decided(sheets.resolved(sheets.sheet(shredded), sheets.themes(shredded))).collect()}


DEFAULTS = f'<w:docDefaults><w:rPrDefault>{r("<w:sz w:val=\"23\"/><w:i/>")}</w:rPrDefault><w:pPrDefault>{p("<w:spacing w:after=\"160\" w:line=\"259\"/>")}</w:pPrDefault></w:docDefaults>'


def test_chains_defaults_and_theme(spark):
    got = looks(
        spark,
        style("A", p('<w:ind w:start="200" w:hanging="100"/><w:jc w:val="both"/><w:tabs><w:tab w:val="right" w:pos="900"/><w:tab w:val="clear" w:pos="5"/><w:tab w:pos="100"/></w:tabs>' + r("<w:strike/>")), r('<w:rFonts w:asciiTheme="majorHAnsi"/><w:b/><w:color w:val="00aaff"/><w:rPrChange><w:rPr><w:b w:val="0"/><w:caps/></w:rPr></w:rPrChange>')),
        style("B", p('<w:ind w:firstLine="40"/><w:numPr><w:ilvl w:val="2"/><w:numId w:val="7"/></w:numPr><w:spacing w:before="20" w:beforeAutospacing="1" w:line="300" w:lineRule="exact"/>'), r('<w:color w:val="auto"/><w:i w:val="off"/><w:u w:color="FF0000"/>'), based="A"),
        style("T", '<w:tblStylePr w:type="firstRow">' + r("<w:b/>") + "</w:tblStylePr>", kind="table"),
        style("C", r('<w:vertAlign w:val="superscript"/>'), based="A", kind="character"),
        style("Loop", r("<w:caps/>"), based="Pool"),
        style("Pool", r('<w:highlight w:val="yellow"/>'), based="Loop"),
        style("Twice", r("<w:b/>")),
        style("Twice", r("<w:smallCaps/>"), based="none"),
        theme='<a:majorFont><a:latin typeface="Big"/></a:majorFont><a:minorFont><a:latin typeface=""/></a:minorFont>',
        defaults=DEFAULTS,
    )
    a, b = got["A"], got["B"]
    assert (a.run.font, a.run.size, a.run.bold, a.run.italic, a.run.caps, a.run.strike, a.run.colour) == ("Big", 11.5, True, True, False, False, "00AAFF")
    assert (a.paragraph.left, a.paragraph.first, a.paragraph.align, a.paragraph.after, a.paragraph.line.rule) == (10.0, -5.0, "justify", 8.0, "auto")
    assert [(t.pos, t.align) for t in a.paragraph.tabs] == [(5.0, "left"), (45.0, "right")]
    assert (b.run.font, b.run.bold, b.run.italic, b.run.underline, b.run.colour) == ("Big", True, False, False, None)
    assert (b.paragraph.left, b.paragraph.first, b.paragraph.num, b.paragraph.level, b.paragraph.before, tuple(b.paragraph.line)) == (10.0, 2.0, 7, 2, 14.0, ("exact", 15.0))
    assert b.origin["bold"] == "A" and b.origin["colour"] == "B" and b.origin["size"] == sheets.DEFAULTS and "caps" not in b.origin
    assert not got["T"].run.bold and got["T"].run.font == "Calibri"
    assert (got["C"].run.vertical, got["C"].run.bold, got["C"].run.size) == ("super", False, 10.0)
    assert got["Loop"].run.caps and got["Loop"].run.highlight == "FFFF00"
    assert not got["Twice"].run.bold and got["Twice"].run.small_caps


def test_a_sheet_without_theme_or_defaults(spark):
    got = looks(spark, style("A", r('<w:rFonts w:hAnsiTheme="majorHAnsi"/>')), style("B"), style("U", r('<w:u w:color="FF0000"/>')))
    assert (got["A"].run.font, got["B"].run.font, got["B"].run.size, got["B"].paragraph.after) == ("Calibri Light", "Calibri", 10.0, None)
    assert not got["U"].run.underline
    assert looks(spark) == {}
