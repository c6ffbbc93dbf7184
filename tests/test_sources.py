import io
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import lookup, texts
from quire.sources import files, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCUMENT = f"""<w:document {W}><w:body><w:p><w:pPr><w:outlineLvl w:val="2"/></w:pPr><w:r><w:t>Harvest report</w:t></w:r></w:p>
<w:p><w:r><w:t>Apples</w:t><w:tab/></w:r><w:r><w:rPr><w:i/></w:rPr><w:t>and pears</w:t><w:cr/></w:r><w:r><w:t>dried</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="ListNumber"/><w:numPr><w:ilvl w:val="2"/><w:numId w:val="11"/></w:numPr></w:pPr><w:r><w:t>quinces</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>crates</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:gridSpan w:val="3"/></w:tcPr><w:p><w:r><w:t>forty</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
STYLES = f"""<w:styles {W}><w:style w:type="paragraph" w:styleId="Plain"><w:pPr><w:spacing w:after="50"/></w:pPr><w:rPr><w:rFonts w:ascii="Gentium"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="Banner"><w:basedOn w:val="Plain"/><w:rPr><w:sz w:val="37"/><w:b w:val="true"/><w:color w:val="8A2BE2"/></w:rPr></w:style></w:styles>"""
RELS = '<Relationships><Relationship Id="chart7" Target="charts/./c.xml"/><Relationship Id="top" Target="/custom/item.xml"/><Relationship Id="web" Target="http://orchard.example" TargetMode="External"/></Relationships>'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def tiff():
    head = struct.pack("<2sHI", b"II", 42, 8)
    entries = [(256, 3, 1, 300), (257, 3, 1, 600), (282, 5, 1, 100), (283, 5, 1, 100), (296, 3, 1, 2), (274, 3, 1, 6)]
    body = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 8)  # loops
    return (head + body).ljust(100, b"\0") + struct.pack("<II", 150, 1)


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.docx").write_bytes(package({"word/document.xml": DOCUMENT, "word/styles.xml": STYLES, "word/_rels/document.xml.rels": RELS, "bad.xml": "<a>"}))
    (tmp_path / "broken.docx").write_bytes(b"PK nonsense")
    (tmp_path / "sub" / "t.txt").write_bytes(b"caf\xe9\nline")
    (tmp_path / "scan.tif").write_bytes(tiff())
    (tmp_path / "junk.bin").write_bytes(b"\0\1\2")
    (tmp_path / "sheet.xls").write_bytes(compound({"Workbook": b"cells"}))
    (tmp_path / "memo.doc").write_bytes(compound({"WordDocument": b"text"}))
    (tmp_path / "cut.doc").write_bytes(compound({"WordDocument": b"text"})[:300])
    found = files.read_files(spark, str(tmp_path)).cache()
    assert {r.path.rpartition("/")[2]: r.format for r in found.collect()} == {"a.docx": "docx", "broken.docx": "docx", "t.txt": "text", "scan.tif": None, "junk.bin": None, "sheet.xls": None, "memo.doc": "doc", "cut.doc": None}
    assert [r.text for r in files.text_files(found).collect()] == ["café\nline"]

    parts = files.package_parts(found).cache()
    assert parts.where("error is not null").count() == 1 and parts.where("part is not null").count() == 4
    shredded = files.elements(parts).cache()
    assert [r.part for r in shredded.where("error is not null").collect()] == ["bad.xml"]
    p = files.paragraphs(shredded).orderBy("pos").collect()
    assert [(r.kind, r.style_level, r.num, r.level, r.in_cell, r.text) for r in p] == [
        ("heading", 3, None, None, False, "Harvest report"), ("normal", 0, None, None, False, "Apples\tand pears\ndried"), ("list", 0, 11, 2, False, "quinces"),
        ("normal", 0, None, None, True, "crates"), ("normal", 0, None, None, True, "forty"), ("normal", 0, None, None, True, "two"),
    ]
    span = DOCUMENT.encode()[p[0]["first"] : p[0]["end"]]
    assert span.startswith(b"<w:p><w:pPr>") and span.endswith(b"report</w:t></w:r></w:p>")
    assert [(r.row, r.col, r.span, r.text) for r in files.cells(shredded).orderBy("row", "col").collect()] == [(0, 0, 1, "crates"), (1, 0, 3, "forty\ntwo")]
    styles = files.styles(shredded)
    got = {r.style_id: r for r in lookup.cascade(styles.drop("kind"), ["font", "size", "bold", "after"], {"font": "x"}, ["path"]).collect()}
    assert (got["Banner"].font, got["Banner"].size, got["Banner"].bold, got["Banner"].after) == ("Gentium", 18.5, True, 2.5)
    assert sorted((r.rel_id, r.target) for r in files.relationships(shredded).collect()) == [("chart7", "word/charts/c.xml"), ("top", "custom/item.xml")]
    page = files.tiff_table(found).collect()
    assert [(r.page, r.width_pt, r.height_pt, r.turn) for r in page] == [(0, 144.0, 288.0, 1)]


def test_package_round_trip(spark):
    text = "Salt & <pepper>\n\n\tthyme \"dried\"\nsage\n"
    df = spark.createDataFrame([("a", text), ("b", "")], "path string, text string")
    paragraphs = texts.paragraphs(df, "path", "text").selectExpr("path", "pos", "text", "case when pos = 0 then 'heading' else 'normal' end as kind", "2 as level", "cast(null as int) as num")
    made = sinks.packages(paragraphs, ["path"]).withColumn("format", F.lit("docx"))
    back = files.paragraphs(files.elements(files.package_parts(made)))
    assert dict(map(tuple, texts.text_of(back, ["path"]).collect())) == {"a": text, "b": "\n"}
    assert back.where("path = 'a' and kind = 'heading' and style_level = 2").count() == 1


def compound(streams):
    """A compound file with whole sectors only."""
    size, free, end = 512, 0xFFFFFFFF, 0xFFFFFFFE
    bodies = {n: b.ljust(max(4096, -(-len(b) // size) * size), b"\0") for n, b in streams.items()}
    fat, sectors, starts = [0xFFFFFFFD], [b""], {}

    def put(data):
        first = len(sectors)
        n = len(data) // size
        sectors.extend(data[k * size : (k + 1) * size] for k in range(n))
        fat.extend([*range(first + 1, first + n), end])
        return first

    for n, b in bodies.items():
        starts[n] = put(b)
    entry = lambda name, kind, start, length: (name.encode("utf-16le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + struct.pack("<III", free, free, free) + b"\0" * 36 + struct.pack("<IQ", start, length)
    folder = entry("Root Entry", 5, end, 0) + b"".join(entry(n, 2, starts[n], len(bodies[n])) for n in bodies)
    at = put(folder.ljust(-(-len(folder) // size) * size, b"\0"))
    sectors[0] = struct.pack(f"<{len(fat)}I", *fat).ljust(size, b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, 1, at, 0, 4096, end, 0, end, 0, 0) + struct.pack("<108I", *[free] * 108)
    return head + b"".join(sectors)


def test_word97(spark):
    cp, wide = "Pâté “œufs”\r".encode("cp1252"), "Žluť\rbox\x07".encode("utf-16le")
    main = bytearray(2048)
    struct.pack_into("<HH", main, 0, 0xA5EC, 193)
    struct.pack_into("<H", main, 10, 0x0200)
    n = len(cp) + len(wide) // 2
    struct.pack_into("<I", main, 76, n)
    clx = b"\x01" + struct.pack("<H", 3) + b"abc" + b"\x02" + struct.pack("<I", 4 * 3 + 8 * 2) + struct.pack("<III", 0, len(cp), n)
    clx += struct.pack("<HIH", 0, 1024 * 2 | 0x40000000, 0) + struct.pack("<HIH", 0, 1200, 0)
    struct.pack_into("<II", main, 418, 16, len(clx))
    main[1024 : 1024 + len(cp)] = cp
    main[1200 : 1200 + len(wide)] = wide
    doc = compound({"WordDocument": bytes(main), "1Table": b"\0" * 16 + clx})
    df = spark.createDataFrame([("ok", doc, "doc"), ("bad", doc[:600], "doc")], "path string, content binary, format string")
    got = {r.path: r for r in files.word97_texts(df).collect()}
    assert got["ok"].text == "Pâté “œufs”\nŽluť\nbox\t" and got["ok"].error is None
    assert got["bad"].text is None and got["bad"].error


def test_small_files_share_batches_and_none_grows_with_the_input():
    schema = pa.schema([("n", pa.int64())])
    got = list(files.passed_on((([(k,)], 10) for k in range(10 * files.BATCH_ROWS)), schema))
    assert [b.num_rows for b in got] == [files.BATCH_ROWS] * 10 and [b.column(0)[0].as_py() for b in got] == [k * files.BATCH_ROWS for k in range(10)]
    assert [b.num_rows for b in files.passed_on((([(k,)], files.BATCH_BYTES // 2) for k in range(7)), schema)] == [2, 2, 2, 1]
    big = pa.RecordBatch.from_arrays([pa.array([b"x" * (1 << 20)] * 20)], ["content"])
    cut = list(files.slices([big]))
    assert sum(b.num_rows for b in cut) == 20 and max(b.num_rows for b in cut) <= files.BATCH_BYTES >> 20
