"""Packages written back: kept spans byte for byte, edited paragraphs made anew, tables, pictures and manifests."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import formats
from quire.functions import xml as X
from quire.operators import ordered
from quire.sources import files, tables

# The schema's order of a paragraph's and of a run's properties.
PARAGRAPH_ORDER = (
    "pStyle keepNext keepLines pageBreakBefore framePr widowControl numPr suppressLineNumbers pBdr shd tabs suppressAutoHyphens kinsoku wordWrap "
    "overflowPunct topLinePunct autoSpaceDE autoSpaceDN bidi adjustRightInd snapToGrid spacing ind contextualSpacing mirrorIndents suppressOverlap jc textDirection "
    "textAlignment textboxTightWrap outlineLvl divId cnfStyle rPr sectPr pPrChange"
).split()
RUN_ORDER = (
    "rStyle rFonts b bCs i iCs caps smallCaps strike dstrike outline shadow emboss imprint noProof snapToGrid vanish webHidden color spacing w kern "
    "position sz szCs highlight u effect bdr shd fitText vertAlign rtl cs em lang eastAsianLayout specVanish oMath"
).split()
#: Half points of a title where a document has no style for it; a heading has so many at level 0 and so many less a level.
TITLE_SIZE, HEADING_SIZE, SIZE_STEP = 44, 30, 2
#: Twentieths of a point that a quotation without a style is moved in, and what stands before an item of a list without numbering.
QUOTE_INDENT, TYPED_BULLET = 480, "• "
PAGE_BREAK = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
# Namespaces.
TYPES_NS = "http://schemas.openxmlformats.org/package/2006/content-types"
RELS_NS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
NAMESPACES = {"r": OFFICE_NS, "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"}
DRAWING_NS = "http://schemas.openxmlformats.org/drawingml/2006/main"

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,highlight:boolean,props:string,drawing:string>"


PROPERTIES = "array<struct<name:string,xml:string>>"
#: Properties that say what kind of paragraph it is, and those that a run's own flags stand for.
OF_KIND, OF_FLAGS = ["pStyle", "numPr", "outlineLvl"], ["b", "bCs", "i", "iCs", "u", "highlight"]


def _element(name: str, **attributes: Column | str) -> Column:
    """An empty element as a property (name, xml); null where an attribute is."""
    said = [x for key, value in attributes.items() for x in (F.lit(f' w:{key}="'), value if isinstance(value, Column) else F.lit(value), F.lit('"'))]
    return _property(name, F.concat(F.lit(f"<w:{name}"), *said, F.lit("/>")))


def _property(name: str, xml: Column) -> Column:
    return F.when(xml.isNotNull(), F.struct(F.lit(name).alias("name"), xml.alias("xml")))


def properties(order: list[str], *sources: Column) -> Column:
    """The XML of one set of properties out of several, the nearest first: of a name the first one counts, in the schema's order.

    A source is an array of (name, xml), in which nulls are nothing; a null source is empty. Names that the
    schema does not list come last.
    """
    every = F.concat(*(F.coalesce(source.cast(PROPERTIES), F.array().cast(PROPERTIES)) for source in sources))
    place = F.create_map(*(x for k, name in enumerate(order) for x in (F.lit(name), F.lit(k))))
    seen = F.filter(every, lambda x: x.isNotNull())
    named = F.transform(seen, lambda x, i: F.struct(F.coalesce(F.element_at(place, x["name"]), F.lit(len(order))).alias("place"), i.alias("i"), x["name"].alias("name"), x["xml"].alias("xml")))
    once = lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: (y["name"] == x["name"]) & (y["i"] < x["i"])))
    return F.array_join(F.transform(F.array_sort(F.flatten(F.transform(F.array(named), once))), lambda x: x["xml"]), "")


def _wrapped(name: str, inner: Column) -> Column:
    return F.when(inner != "", F.concat(F.lit(f"<w:{name}>"), inner, F.lit(f"</w:{name}>"))).otherwise("")


def _text(text: Column) -> Column:
    """Text as elements of a run: tabs and line ends are elements, other control characters go."""
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0b-\\x1f]", "")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    for char, mark in (("\t", "<w:tab/>"), ("\n", "<w:br/>")):
        out = F.replace(out, F.lit(char), F.lit(f'</w:t>{mark}<w:t xml:space="preserve">'))
    return F.replace(F.concat(F.lit('<w:t xml:space="preserve">'), out, F.lit("</w:t>")), F.lit('<w:t xml:space="preserve"></w:t>'), F.lit(""))


def run_xml(run: Column, own: Column, kind: Column) -> Column:
    """A run: its kind's properties before its four flags before what else its properties (``own``) say; a drawing as it is."""
    flags = F.array(F.when(run["bold"], _element("b")), F.when(run["italic"], _element("i")), F.when(run["underline"], _element("u", val="single")), F.when(run["highlight"], _element("highlight", val="yellow")))
    rest = F.filter(own, lambda x: ~x["name"].isin(OF_FLAGS))
    written = F.concat(_wrapped("rPr", properties(RUN_ORDER, kind, flags, rest)), _text(run["text"]))
    drawn = F.concat(_wrapped("rPr", F.coalesce(run["props"], F.lit(""))), run["drawing"])
    return F.concat(F.lit("<w:r>"), F.coalesce(drawn, written), F.lit("</w:r>"))


def paragraphs_xml(lines: DataFrame) -> DataFrame:
    """``lines`` with ``made``: each as a paragraph element.

    A line has kind, level, align and runs; of the paragraph that it was edited from, if any, base_kind,
    origin (the XML in its properties) and num; of its document, styles (ids) and bullet (a list of bullets).
    A paragraph of its origin's kind keeps the origin's properties as they are. Another one has, the nearest
    first, its alignment, what its kind takes (a style if the document has it), and the origin's others.
    """
    kind, level = F.col("kind"), F.coalesce(F.col("level"), F.lit(0))
    style = formats.style_id(kind, level)
    lines = lines.withColumns({"_origin": X.children_of(F.col("origin")), "_own": X.children_of_each(F.transform("runs", lambda r: r["props"])), "_styled": F.coalesce(F.array_contains("styles", style), F.lit(False))})
    bare = ~F.col("_styled")
    number = F.coalesce("num", "bullet").cast("string")
    listed = F.concat(F.lit('<w:numPr><w:ilvl w:val="'), level.cast("string"), F.lit('"/><w:numId w:val="'), number, F.lit('"/></w:numPr>'))
    takes = F.array(
        F.when(F.col("_styled"), _element("pStyle", val=style)),
        F.when(bare & (kind == "heading"), _element("outlineLvl", val=(level - 1).cast("string"))),
        F.when(bare & (kind == "quote"), _element("ind", left=str(QUOTE_INDENT))),
        F.when(kind == "list", _property("numPr", listed)),
    )
    size = F.when(kind == "title", TITLE_SIZE).when(kind == "heading", HEADING_SIZE - SIZE_STEP * level).cast("string")
    looks = F.array(F.when(bare & size.isNotNull(), _element("b")), F.when(bare, _element("sz", val=size)), F.when(bare & (kind == "quote"), _element("i")))
    rest = F.filter("_origin", lambda x: ~x["name"].isin(OF_KIND))
    fresh = properties(PARAGRAPH_ORDER, F.array(_element("jc", val=F.col("align"))), takes, rest)
    same = F.col("base_kind").eqNullSafe(F.struct(kind.alias("kind"), level.alias("level")))
    lines = lines.withColumns({"_looks": looks.cast(PROPERTIES), "_props": F.when(same, F.coalesce("origin", F.lit(""))).otherwise(fresh)})
    shown = F.transform("runs", lambda r, i: F.when((r["text"] != "") | r["drawing"].isNotNull(), run_xml(r, F.get("_own", i), F.col("_looks"))).otherwise(""))
    typed = F.when((kind == "list") & ~F.contains("_props", F.lit("<w:numPr")), F.concat(F.lit("<w:r>"), _text(F.lit(TYPED_BULLET)), F.lit("</w:r>"))).otherwise("")
    made = F.concat(F.lit("<w:p>"), _wrapped("pPr", F.col("_props")), typed, F.coalesce(F.array_join(shown, ""), F.lit("")), F.lit("</w:p>"))
    return lines.withColumn("made", made).drop("_origin", "_own", "_styled", "_looks", "_props")


def repackaged(package: bytes, replace: dict[str, bytes], remove: set[str] = frozenset()) -> bytes:
    """A package with parts replaced or added, and some removed; the others are copied."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(package)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            if info.filename not in replace and info.filename not in remove:
                new.writestr(zipfile.ZipInfo(info.filename), old.read(info.filename))
        for name, content in replace.items():
            new.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


#: Bytes and parts up to which a package is joined of its entries.
SMALL, MANY = 1 << 30, 1 << 15
#: Version and system that wrote a part, date (the first of 1980) and rights of its file, as ``zipfile`` has them.
VERSION, SYSTEM, DATE, RIGHTS = 20, 3, 0x21, 0o600 << 16


@lru_cache(256)
def _small_entry(name: str, content: bytes) -> tuple[bytes, bytes]:
    """``_entry`` of a part of few bytes, of which packages have many that are the same."""
    return _entry(name, content)


def _entry(name: str, content: bytes) -> tuple[bytes, bytes]:
    """(a stored part with its head, what the directory says of it up to its offset)."""
    coded, size = name.encode(), len(content)
    told = struct.pack("<HHHHIIIHH", 0 if name.isascii() else 0x800, 0, 0, DATE, zlib.crc32(content), size, size, len(coded), 0)
    return b"PK\3\4" + struct.pack("<H", VERSION) + told + coded + content, b"PK\1\2" + struct.pack("<BBH", VERSION, SYSTEM, VERSION) + told + struct.pack("<HHHI", 0, 0, 0, RIGHTS)


def package(parts: Sequence[tuple[str, bytes]]) -> bytes:
    """A package of parts (name, content), which are stored. Large ones are left to ``zipfile``, the bytes of small ones are the same as its."""
    if len(parts) > MANY or sum(len(content) for _, content in parts) > SMALL:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in parts:
                z.writestr(zipfile.ZipInfo(name), content)
        return out.getvalue()
    bodies, folder, at = [], [], 0
    for name, content in parts:
        body, told = _small_entry(name, content) if len(content) < 512 else _entry(name, content)
        bodies.append(body)
        folder.append(told + struct.pack("<I", at) + name.encode())
        at += len(body)
    size = sum(map(len, folder))
    return b"".join([*bodies, *folder, b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(parts), len(parts), size, at, 0)])


def zipped(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): a package of the parts (name, content as text or bytes) of each document, in order of their names."""
    # A number of partitions that is given stays: by the bytes of its small parts, Spark would leave this work to a task or two.
    dealt = parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return zipped_rows(dealt.groupBy(*keys).agg(F.collect_list(F.struct("name", F.col("content").cast("binary").alias("content"))).alias("parts")))


def zipped_rows(docs: DataFrame) -> DataFrame:
    """(keys, content): ``zipped`` of documents whose last column is the array of their parts (name, content)."""
    body = docs.withColumn(docs.columns[-1], F.array_sort(docs.columns[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files.slices(batches):
            lists = batch.column(batch.num_columns - 1)
            every = list(zip(*(c.to_pylist() for c in lists.flatten().flatten()), strict=True))
            ends = list(accumulate(lists.value_lengths().to_pylist(), initial=0))
            made = [package(every[a:b]) for a, b in pairwise(ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], [*batch.schema.names[:-1], "content"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in body.schema.fields[:-1]) + ", content binary"
    return body.mapInArrow(run, schema)


def save(found: DataFrame, out: DataFrame) -> DataFrame:
    """(path, content): packages (path, content, format) with their bodies written as ``out`` says.

    ``out`` has path, seq, action, item, kind, level, align, runs (array of RUN) and xml: keep puts the item
    as it was; para makes a paragraph anew, from the item (which may be null) it was edited from; block puts
    ``xml``. What does not show, such as bookmarks, goes before the item that it stood before, once; that of
    items that are gone comes after all others, and what stood last, such as section properties, ends the body.
    The result is a written table (``tables.release``).
    """
    with tables.steps(found.sparkSession) as keep:
        return tables.saved(_saved_packages(found, out, keep(files.elements(files.package_parts(found)), "elements")), "saved")


def _saved_packages(found: DataFrame, out: DataFrame, shredded: DataFrame) -> DataFrame:
    body_items = files.items(shredded)
    shows = (F.col("n_blocks") > 0) | F.col("kind").isin("paragraph", "locked", "table")
    owned = ordered.owner_of_hidden(body_items, ["path"], "item", shows).withColumn("shows", shows)
    hidden = owned.where(~F.col("shows")).select("path", "item", "owner", "first", "end")
    of_item = files.paragraphs(shredded).select("path", "pos", F.struct("kind", F.coalesce("level", "style_level").alias("level")).cast("struct<kind:string,level:int>").alias("base_kind"), "num")
    origin = shredded.where("name = 'pPr' and part = 'word/document.xml'").select("path", F.col("parent").alias("pos"), F.regexp_replace("text", r"(?s)^<[^>]*>|</[^>]*>$", "").alias("origin"))
    known = body_items.join(of_item, ["path", "pos"], "left").join(origin, ["path", "pos"], "left").select("path", "item", "first", "end", "base_kind", "num", "origin")
    styles = files.styles(shredded).groupBy("path").agg(F.collect_set("style_id").alias("styles"))
    bullets = files.list_levels(shredded).where("level = 0 and format = 'bullet'").groupBy("path").agg(F.min("num").alias("bullet"))

    lines = out.withColumns({"runs": F.col("runs").cast(f"array<{RUN}>"), "level": F.col("level").cast("int")}).join(known, ["path", "item"], "left").join(styles, "path", "left").join(bullets, "path", "left")
    placed_lines = paragraphs_xml(lines).select("path", F.lit(0).alias("part"), "seq", F.lit(1).alias("late"), F.coalesce("item", F.lit(0)).alias("item"), "action", "first", "end", F.when(F.col("action") == "para", F.col("made")).otherwise(F.col("xml")).alias("xml"))
    first_use = out.where("item is not null").groupBy("path", F.col("item").alias("owner")).agg(F.min("seq").alias("seq"))
    placed = hidden.join(first_use, ["path", "owner"], "left")
    part = F.when(F.col("seq").isNotNull(), 0).when(F.col("owner").isNotNull(), 1).otherwise(2)
    kept = placed.select("path", part.alias("part"), F.coalesce("seq", F.lit(0)).alias("seq"), F.lit(0).alias("late"), "item", F.lit("keep").alias("action"), "first", "end", F.lit(None).cast("string").alias("xml"))
    pieces = placed_lines.unionByName(kept).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "late", "item", "action", "first", "end", "xml"))).alias("pieces"))
    span = body_items.groupBy("path").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    docs = found.where("format = 'docx'").select("path", "content").join(pieces, "path").join(span, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files.slices(batches):
            made = []
            for d in batch.to_pylist():
                with zipfile.ZipFile(io.BytesIO(d["content"])) as z:
                    xml = z.read("word/document.xml")
                first, end = d["first"], d["end"]
                if first is None:
                    first = end = xml.rindex(b"</", 0, xml.rindex(b"</"))
                body = b"".join((p["xml"] or "").encode() if p["action"] != "keep" else xml[p["first"] : p["end"]] if p["first"] is not None else b"" for p in d["pieces"])
                made.append(repackaged(d["content"], {"word/document.xml": xml[:first] + body + xml[end:]}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["path", "content"])

    return docs.select("path", "content", "pieces", "first", "end").mapInArrow(run, "path string, content binary")


# Tables, pictures and manifests, as XML made by expressions ---------------------------------


def attribute(text: Column) -> Column:
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def table_xml(cells: DataFrame, keys: list[str], text_width: float = 468.0, borders: bool = True) -> DataFrame:
    """(keys, xml) of tables of cells (row, col, text, span, merged, shade): a paragraph a line of text, columns sharing the width in points.

    Rows that are short are filled out to the widest; ``shade`` is RRGGBB or null.
    """
    w = Window.partitionBy(*keys, "row").orderBy("col")
    wide = cells.withColumn("_span", F.greatest(F.coalesce("span", F.lit(1)), F.lit(1))).withColumn("_to", F.sum("_span").over(w))
    n_columns = F.max("_to").over(Window.partitionBy(*keys))
    unit = F.floor(F.lit(text_width * 20) / F.col("_n")).cast("long")
    known = wide.withColumn("_n", n_columns).withColumn("_unit", unit)
    line = lambda t: F.concat(F.lit("<w:p>"), F.when(t != "", F.concat(F.lit('<w:r><w:t xml:space="preserve">'), attribute(t), F.lit("</w:t></w:r>"))).otherwise(""), F.lit("</w:p>"))
    width = lambda n: F.concat(F.lit('<w:tcW w:w="'), n.cast("string"), F.lit('" w:type="dxa"/>'))
    props = F.concat(
        width(F.col("_span") * F.col("_unit")),
        F.when(F.col("_span") > 1, F.concat(F.lit('<w:gridSpan w:val="'), F.col("_span").cast("string"), F.lit('"/>'))).otherwise(""),
        F.when(F.coalesce("merged", F.lit(False)), "<w:vMerge/>").otherwise(""),
        F.when(F.col("shade").isNotNull(), F.concat(F.lit('<w:shd w:val="clear" w:color="auto" w:fill="'), "shade", F.lit('"/>'))).otherwise(""),
    )
    cell = F.concat(F.lit("<w:tc><w:tcPr>"), props, F.lit("</w:tcPr>"), F.array_join(F.transform(F.split("text", "\n"), line), ""), F.lit("</w:tc>"))
    ordered_text = lambda at, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), what.alias("x")))), lambda s: s["x"]), "")
    rows = known.groupBy(*keys, "row").agg(ordered_text("col", cell).alias("_cells"), F.max("_to").alias("_held"), F.max("_n").alias("_n"), F.max("_unit").alias("_unit"))
    lacking = F.repeat(F.concat(F.lit("<w:tc><w:tcPr>"), width(F.col("_unit")), F.lit("</w:tcPr><w:p/></w:tc>")), (F.col("_n") - F.col("_held")).cast("int"))
    full = rows.withColumn("_row", F.concat(F.lit("<w:tr>"), "_cells", lacking, F.lit("</w:tr>")))
    edges = "".join(f'<w:{e} w:val="single" w:sz="4" w:space="0" w:color="auto"/>' for e in ("top", "left", "bottom", "right", "insideH", "insideV"))
    lines = f"<w:tblBorders>{edges}</w:tblBorders>" if borders else ""
    whole = full.groupBy(*keys).agg(ordered_text("row", F.col("_row")).alias("_rows"), F.max("_n").alias("_n"), F.max("_unit").alias("_unit"))
    grid = F.repeat(F.concat(F.lit('<w:gridCol w:w="'), F.col("_unit").cast("string"), F.lit('"/>')), F.col("_n").cast("int"))
    total = (F.col("_n") * F.col("_unit")).cast("string")
    head = F.concat(F.lit('<w:tbl><w:tblPr><w:tblW w:w="'), total, F.lit(f'" w:type="dxa"/>{lines}<w:tblLayout w:type="fixed"/></w:tblPr><w:tblGrid>'), grid, F.lit("</w:tblGrid>"))
    return whole.select(*keys, F.concat(head, "_rows", F.lit("</w:tbl>")).alias("xml"))


def media_plan(pictures: DataFrame, taken: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """(keys, pos, rel_id, part, added, drawing_id) of new pictures (content): equal ones share a part; none is one that ``taken`` (n, drawing) has.

    ``taken`` has a row a document: the largest number of such a part and the largest drawing id there.
    Content that is no picture is left out.
    """
    kind = formats.picture_type(F.col("content"))
    real = pictures.select(*keys, pos, kind.alias("_kind"), F.unhex(F.sha2("content", 256)).alias("_hash")).where("_kind is not null")
    # Few narrow rows are held at once: a task's sorts add up, and by the packed bytes of such rows Spark would leave many to one task.
    tasks = int(pictures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = Window.partitionBy(*keys, "_hash").orderBy(F.asc_nulls_last(pos)).rowsBetween(Window.unboundedPreceding, 0)
    first = real.repartition(tasks, *keys, "_hash").withColumn("_first", F.min(pos).over(same))
    dealt = first.select(*keys, pos, "_kind", "_first", F.substring("_hash", 1, 8).alias("_tie")).repartition(tasks, *keys)
    numbered = dealt.withColumn("_n", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first", "_tie"))).drop("_tie")
    placed = numbered.withColumn("_drawing", F.row_number().over(Window.partitionBy(*keys).orderBy(pos)))
    joined = placed.join(taken.select(*keys, "n", "drawing").hint("merge"), keys, "left")
    n = (F.col("_n") + F.coalesce("n", F.lit(0))).cast("string")
    drawing = F.col("_drawing") + F.coalesce("drawing", F.lit(0))
    return joined.select(*keys, pos, F.concat(F.lit("rIdPicture"), n).alias("rel_id"), F.concat(F.lit("word/media/picture"), n, F.lit("."), "_kind").alias("part"), (F.col(pos) == F.col("_first")).alias("added"), drawing.cast("long").alias("drawing_id"))


def drawing_xml(rel_id: Column, drawing_id: Column, cx: Column, cy: Column) -> Column:
    """A picture in the text, of a size in EMU."""
    ident, x, y = drawing_id.cast("string"), F.greatest(cx, F.lit(1)).cast("string"), F.greatest(cy, F.lit(1)).cast("string")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    picture = cat(
        f'<pic:pic xmlns:pic="{files.PICTURE}"><pic:nvPicPr><pic:cNvPr id="', ident, '" name="Picture ', ident, '"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="', rel_id,
        '"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="', x, '" cy="', y, '"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic>',
    )
    return cat(
        '<w:drawing><wp:inline distT="0" distB="0" distL="0" distR="0"><wp:extent cx="', x, '" cy="', y, '"/><wp:docPr id="', ident, '" name="Picture ', ident,
        f'"/><a:graphic xmlns:a="{DRAWING_NS}"><a:graphicData uri="{files.PICTURE}">', picture, "</a:graphicData></a:graphic></wp:inline></w:drawing>",
    )


def relationships_xml(rels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xml): a relationships part of rows (seq, rel_id, type, target, external), in order of seq."""
    mode = F.when(F.coalesce("external", F.lit(False)), ' TargetMode="External"').otherwise("")
    one = F.concat(F.lit('<Relationship Id="'), attribute(F.col("rel_id")), F.lit('" Type="'), attribute(F.col("type")), F.lit('" Target="'), attribute(F.col("target")), F.lit('"'), mode, F.lit("/>"))
    rows = F.array_sort(F.collect_list(F.struct("seq", one.alias("x"))))
    return rels.groupBy(*keys).agg(F.concat(F.lit(f'{HEAD}<Relationships xmlns="{RELS_NS}">'), F.array_join(F.transform(rows, lambda r: r["x"]), ""), F.lit("</Relationships>")).alias("xml"))


def content_types_xml(by_ext: DataFrame, by_name: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xml): a content types part, extensions (ext, type) and then parts (name, type), each in order."""
    ext = F.concat(F.lit('<Default Extension="'), attribute(F.col("ext")), F.lit('" ContentType="'), attribute(F.col("type")), F.lit('"/>'))
    name = F.concat(F.lit('<Override PartName="/'), attribute(F.col("name")), F.lit('" ContentType="'), attribute(F.col("type")), F.lit('"/>'))
    both = by_ext.select(*keys, F.lit(0).alias("_kind"), F.col("ext").alias("_by"), ext.alias("x")).unionByName(by_name.select(*keys, F.lit(1).alias("_kind"), F.col("name").alias("_by"), name.alias("x")))
    rows = F.array_sort(F.collect_list(F.struct("_kind", "_by", "x")))
    return both.groupBy(*keys).agg(F.concat(F.lit(f'{HEAD}<Types xmlns="{TYPES_NS}">'), F.array_join(F.transform(rows, lambda r: r["x"]), ""), F.lit("</Types>")).alias("xml"))
