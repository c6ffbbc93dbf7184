"""Parts of packages: only those asked for are unzipped; texts of headers, footers and boxes."""

import io
import zipfile

from quire.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_rels_", "_rels/").replace("_png", ".png"), content)
    return out.getvalue()


def found(spark, **docs):
    return spark.createDataFrame([(k, v, "docx") for k, v in docs.items()], "path string, content binary, format string")


def test_only_wanted_parts_are_unzipped(spark):
    whole = package(word__styles_xml="<s/>", word__media__a_png=bytes(range(256)) * 20)
    at = whole.index(b"word/media/a.png") + len("word/media/a.png") + 5
    broken = whole[:at] + b"\xff" * 8 + whole[at + 8 :]  # unzipping the picture fails
    df = found(spark, d=broken)
    assert [(r.part, r.error) for r in files.package_parts(df, ["*.xml"]).collect()] == [("word/styles.xml", None)]
    assert [r.part for r in files.package_parts(df).collect()] == [None]
    assert {(r.part, r.size) for r in files.package_entries(df).collect()} == {("word/styles.xml", 4), ("word/media/a.png", 5120)}
    assert files.package_parts(df, ["nothing"]).count() == 0


def test_large_and_broken_parts_have_errors(spark):
    df = found(spark, d=package(small_xml="<a/>", large_xml="x" * 100_000), bad=b"no package", none=None)
    got = {(r.path, r.part): (bytes(r.content) if r.content is not None else None, r.error) for r in files.package_parts(df, largest=1000).collect()}
    assert got[("d", "small.xml")] == (b"<a/>", None)
    assert got[("d", "large.xml")] == (None, "a part of more than 1000 bytes")
    assert got[("bad", None)][1] and got[("none", None)][1]
    assert files.package_entries(df).where("path <> 'd'").count() == 0


def test_texts_of_boxes(spark):
    box = lambda inner: f"<w:r><w:drawing><w:txbxContent>{inner}</w:txbxContent></w:drawing></w:r>"
    p = lambda inner: f"<w:p>{inner}</w:p>"
    t = lambda s: f"<w:r><w:t>{s}</w:t></w:r>"
    body = p(t("a") + box(p(t("b")) + p(box(p(t("c"))) + t("d"))) + t("e")) + p("<w:r><w:pict><w:txbxContent>" + p(t("f")) + "</w:txbxContent></w:pict></w:r>") + p("")
    doc = package(word__document_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>", word__header1_xml=f"<w:hdr {W}>{p(t('h'))}</w:hdr>")
    shredded = files.elements(files.package_parts(found(spark, d=doc)), boxes=True).cache()
    rows = files.texts_of_parts(shredded).orderBy("part", "pos").collect()
    assert [(r.text, r.box is not None, r.outer is not None) for r in rows] == [("ae", False, False), ("b", True, False), ("d", True, False), ("c", True, True), ("", False, False), ("f", True, False), ("", False, False), ("h", False, False)]
    of = {r.text: r for r in rows}
    assert of["b"].host == of["ae"].pos and of["c"].host == of["d"].pos and of["c"].outer == of["b"].box
    assert files.part_roles(shredded).count() == 0
    plain = files.elements(files.package_parts(found(spark, d=doc)))
    assert [r.text for r in files.paragraphs(plain).orderBy("pos").collect()] == ["ae", "", ""]
