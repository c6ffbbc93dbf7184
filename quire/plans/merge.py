"""Packages joined into one: bodies one after the other with all that they refer to, renamed and renumbered so that nothing collides.

What each package adds to the first is a plan over tables of its parts, relationships, styles and list
definitions; a task then writes one job's package. Notes, comments and the other packages' own sections
are left behind.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import formats
from quire.functions import xml as X
from quire.operators import lookup
from quire.sources import files, packages, tables

LEFT_BEHIND = ("footnoteReference", "endnoteReference", "commentReference", "commentRangeStart", "commentRangeEnd")
DOCUMENT, STYLES, NUMBERING, TYPES = "word/document.xml", "word/styles.xml", "word/numbering.xml", "[Content_Types].xml"
NUMBERING_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml"
NUMBERING_HEAD = f'{packages.HEAD}<w:numbering xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"></w:numbering>'
_FILE = ["job", "file_no"]


def _bodies(parts: DataFrame, items: DataFrame) -> DataFrame:
    """(job, file_no, prefix, xml): what goes over of each later body, and its prefix for relationships."""
    spans = items.where("not (kind = 'other' and name = 'sectPr')").groupBy(*_FILE).agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))
    rows = parts.where(F.col("part") == DOCUMENT).join(spans, _FILE).select(*_FILE, "content", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, bodies = [], []
            for content, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                named = re.search(rf'xmlns:(\w+)="{re.escape(packages.OFFICE_NS)}"'.encode(), content)
                prefixes.append(named.group(1).decode() if named else "r")
                bodies.append(X.stripped(b"".join(content[s["first"] : s["end"]] for s in spans).decode(), LEFT_BEHIND))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prefixes), pa.array(bodies)], [*_FILE, "prefix", "xml"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"job {kinds['job']}, file_no {kinds['file_no']}, prefix string, xml string")


def _renamed(part, n):
    return F.concat(F.regexp_extract(part, "^(.*/)?[^/]*$", 1), F.lit("from"), n.cast("string"), F.lit("-"), F.regexp_extract(part, "([^/]*)$", 1))


def _numbers(shredded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((job, file_no, kind, id, base, xml) of list definitions, (job, file_no, num_base) of the files that have any)."""
    own = shredded.where((F.col("part") == NUMBERING) & F.col("error").isNull() & F.col("name").isin("abstractNum", "num"))
    ident = F.element_at("attrs", F.when(F.col("name") == "num", "numId").otherwise("abstractNumId")).try_cast("int")
    defs = own.select(*_FILE, F.col("name").alias("kind"), "pos", ident.alias("id"), F.col("text").alias("xml")).where("id is not null")
    tops = shredded.select(*_FILE).distinct().join(defs.groupBy(*_FILE).agg(F.max(F.when(F.col("kind") == "num", F.col("id"))).alias("num"), F.max(F.when(F.col("kind") != "num", F.col("id"))).alias("abstract")), _FILE, "left")
    w = Window.partitionBy("job").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    room = lambda c, least: F.coalesce(F.sum(F.coalesce(F.col(c) + 1, F.when(F.col("file_no") == 0, F.lit(least)).otherwise(F.lit(0)))).over(w), F.lit(0)).cast("int")
    bases = tops.withColumns({"num_base": room("num", 1), "abstract_base": room("abstract", 0)})
    placed = defs.join(bases.select(*_FILE, "num_base", "abstract_base"), _FILE)
    return placed, bases.where("num is not null or abstract is not null").select(*_FILE, "num_base")


def _shifted(xml: str, element: str, attribute: str, by: int, known: set[int] | None = None) -> str:
    """A numeric attribute of all elements of a name moved up, for the numbers that are known."""

    def move(m: re.Match) -> str:
        n = int(m.group(2))
        return m.group(1) + (str(n + by) if known is None or n in known else m.group(2))

    return re.sub(rf'(<\w+:{element}\b[^>]*?\b\w+:{attribute}=")(\d+)(?=")', move, xml)


def _copies(rels: DataFrame, taken: DataFrame) -> DataFrame:
    """(job, file_no, part): parts that go over, those that the body refers to and what they refer to in turn, however far and in circles."""
    folder = F.regexp_extract("source_part", "^(.*/)?[^/]*$", 1)
    edges = rels.where("not external").select(*_FILE, "source_part", formats.resolve_path(folder, F.col("target")).alias("part"))
    start = taken.where("not external").groupBy(*_FILE).agg(F.collect_set(formats.resolve_path(F.lit("word/"), F.col("target"))).alias("start"))
    of_file = edges.groupBy(*_FILE).agg(F.collect_list(F.struct("source_part", "part")).alias("edges"))
    rows = start.join(of_file, _FILE, "left").select(*_FILE, "start", "edges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                leads: dict[str, list[str]] = {}
                for e in row["edges"] or []:
                    leads.setdefault(e["source_part"], []).append(e["part"])
                reached, left = set(), list(row["start"])
                while left:
                    part = left.pop()
                    if part not in reached:
                        reached.add(part)
                        left += leads.get(part, [])
                found.append(sorted(reached))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], [*_FILE, "parts"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"job {kinds['job']}, file_no {kinds['file_no']}, parts array<string>").select(*_FILE, F.explode("parts").alias("part"))


def merge(found: DataFrame) -> DataFrame:
    """(job, content): the packages (job, file_no from 0, content) of each job as one, each later one on a new page.

    Each package is unzipped and parsed once. What several steps read (parts, elements, body items,
    relationships, what goes over) is written and read back, so that no plan holds another one many times;
    those tables go when the result, itself a table, is written (``tables.release`` deletes that one).
    """
    with tables.steps(found.sparkSession) as keep:
        return tables.saved(_merged(found, keep), "merged")


def _merged(found: DataFrame, keep: Callable[..., DataFrame]) -> DataFrame:
    key = F.to_json(F.struct(*_FILE))
    found = keep(found.select(*_FILE, "content", key.alias("path")), "packages")
    names = found.select(*_FILE, "path")
    known = lambda df, name: keep(df.join(names, "path").drop("path"), name)
    raw = keep(files.package_parts(found.select("path", "content", F.lit("docx").alias("format"))).where("error is null"), "parts")
    shred = keep(files.elements(raw), "elements")
    parts, shredded, items = known(raw, "parts"), known(shred, "elements"), known(files.items(shred), "items")
    rels = known(files.all_relationships(shred), "relationships")
    bodies = keep(_bodies(parts, items.where("file_no > 0")), "bodies")
    of_body = rels.where((F.col("source_part") == DOCUMENT) & (F.col("file_no") > 0))
    taken = keep(lookup.referenced(of_body, bodies, _FILE), "taken")
    copies = keep(_copies(rels.where("file_no > 0"), taken), "copies")
    new_id = F.concat(F.lit("f"), F.col("file_no").cast("string"), F.lit("."), "rel_id")

    # Relationships of the joined document: those of the first, then of what goes over.
    own_target = F.regexp_replace(_renamed(formats.resolve_path(F.lit("word/"), F.col("target")), F.col("file_no")), "^word/", "")
    outside = ~formats.resolve_path(F.lit("word/"), F.col("target")).startswith("word/")
    moved = taken.select("job", "file_no", "seq", new_id.alias("rel_id"), "type", F.when(F.col("external"), F.col("target")).otherwise(F.concat(F.when(outside, "/").otherwise(""), own_target)).alias("target"), "external")
    first = rels.where((F.col("source_part") == DOCUMENT) & (F.col("file_no") == 0)).select("job", "file_no", "seq", "rel_id", "type", "target", "external")
    numbers, num_bases = (keep(df, "numbers") for df in _numbers(shredded))
    lists = num_bases.groupBy("job").agg(F.min("file_no").alias("_first"))
    lacking = lists.where("_first > 0").select("job", F.lit(2**30).alias("file_no"), F.lit(0).alias("seq"), F.lit("fNumbering").alias("rel_id"), F.lit(f"{packages.OFFICE_NS}/numbering").alias("type"), F.lit("numbering.xml").alias("target"), F.lit(False).alias("external"))
    document_rels = packages.relationships_xml(first.unionByName(moved).unionByName(lacking).withColumn("seq", F.struct("file_no", "seq")), ["job"]).withColumn("name", F.lit("word/_rels/document.xml.rels"))

    # Parts under new names, and the relationships of those that have any, which name parts from the root.
    went = keep(copies.withColumn("name", _renamed(F.col("part"), F.col("file_no"))), "went")
    bytes_of = parts.join(went, [*_FILE, "part"]).select("job", "name", "content")
    inner = rels.where("file_no > 0").join(went.select(*_FILE, F.col("part").alias("source_part"), "name"), [*_FILE, "source_part"])
    folder = F.regexp_extract("source_part", "^(.*/)?[^/]*$", 1)
    resolved = _renamed(formats.resolve_path(folder, F.col("target")), F.col("file_no"))
    inner_rels = packages.relationships_xml(inner.withColumn("target", F.when(F.col("external"), F.col("target")).otherwise(F.concat(F.lit("/"), resolved))).withColumn("seq", F.struct("file_no", "seq")), ["job", "name"])
    inner_parts = inner_rels.select("job", formats.rels_path(F.col("name")).alias("name"), F.encode("xml", "UTF-8").alias("content"))

    # Content types: the first package's, and by name those that it does not know by extension.
    named, by_ext = (known(df, "types") for df in files.content_types(shred))
    ext = F.lower(F.regexp_extract("part", r"\.([^./]*)$", 1))
    typed = went.withColumn("ext", ext).join(named.withColumnRenamed("name", "part").withColumnRenamed("type", "_o"), [*_FILE, "part"], "left").join(by_ext.withColumnRenamed("type", "_d"), [*_FILE, "ext"], "left")
    ours = by_ext.where("file_no = 0").select("job", "ext", F.col("type").alias("_ours"))
    wanted = typed.withColumn("type", F.coalesce("_o", "_d")).join(ours, ["job", "ext"], "left").where("type is not null and not (type <=> _ours)").select("job", "name", "type")
    listed = lists.where("_first > 0").select("job", F.lit(NUMBERING).alias("name"), F.lit(NUMBERING_TYPE).alias("type"))
    types = packages.content_types_xml(by_ext.where("file_no = 0").select("job", "ext", "type"), named.where("file_no = 0").select("job", "name", "type").unionByName(wanted).unionByName(listed), ["job"]).withColumn("name", F.lit(TYPES))

    # Styles that no package before has.
    styles = shredded.where((F.col("part") == STYLES) & F.col("error").isNull() & (F.col("name") == "style")).select(*_FILE, "pos", F.element_at("attrs", "styleId").alias("style_id"), F.col("text").alias("xml"))
    winner = F.row_number().over(Window.partitionBy("job", "style_id").orderBy("file_no", "pos"))
    extra = styles.withColumn("_k", winner).where("_k = 1 and file_no > 0").groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_no", "pos", "xml"))), lambda s: s["xml"]), "").alias("styles"))

    # Bodies with their references rewritten.
    ids = taken.groupBy(*_FILE).agg(F.map_from_entries(F.collect_list(F.struct("rel_id", new_id.alias("to")))).alias("ids"))
    nums = numbers.where("kind = 'num'").groupBy(*_FILE).agg(F.collect_set("id").alias("nums"))
    full = bodies.join(ids, _FILE, "left").join(nums, _FILE, "left").join(num_bases, _FILE, "left")
    appended = full.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("file_no", "prefix", "xml", F.map_entries("ids").alias("ids"), "nums", "num_base"))).alias("bodies"))
    defs = numbers.where("file_no > 0").groupBy("job").agg(F.array_sort(F.collect_list(F.struct("kind", "file_no", "pos", "id", "num_base", "abstract_base", "xml"))).alias("defs"))
    ends = items.where("file_no = 0 and not (kind = 'other' and name = 'sectPr')").groupBy("job").agg(F.max("end").alias("end"))
    other = bytes_of.unionByName(inner_parts).unionByName(document_rels.select("job", "name", F.encode("xml", "UTF-8").alias("content"))).unionByName(types.select("job", "name", F.encode("xml", "UTF-8").alias("content")))
    added = keep(other.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("name", "content"))).alias("added")), "added")
    base = found.where("file_no = 0").select("job", "content")
    jobs = base.join(ends, "job", "left").join(appended, "job", "left").join(defs, "job", "left").join(extra, "job", "left").join(added, "job", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_written(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["job", "content"])

    kind = found.schema["job"].dataType.simpleString()
    return jobs.select("job", "content", "end", "bodies", "defs", "styles", "added").mapInArrow(run, f"job {kind}, content binary")


def _rewritten(b: dict, prefix: str) -> str:
    """A body with its relationships' ids, its prefix for them and its list numbers as the joined document has them."""
    ids = {e["key"]: e["value"] for e in b["ids"] or []}
    xml = re.sub(rf'( {b["prefix"]}:\w+=")([^"]*)', lambda m: m.group(1) + ids.get(m.group(2), m.group(2)), b["xml"])
    if b["prefix"] != prefix:
        xml = xml.replace(f" {b['prefix']}:", f" {prefix}:")
    if b["num_base"] is None:
        return X.stripped(xml, ["numPr"])
    return _shifted(xml, "numId", "val", b["num_base"], set(b["nums"] or []))


def _numbered(xml: str, defs: list[dict]) -> str:
    """A numbering part with more definitions; those of lists come after all of what they are based on."""
    abstracts = "".join(_shifted(d["xml"], "abstractNum", "abstractNumId", d["abstract_base"]) for d in defs if d["kind"] == "abstractNum")
    lists = "".join(_shifted(_shifted(d["xml"], "num", "numId", d["num_base"]), "abstractNumId", "val", d["abstract_base"]) for d in defs if d["kind"] == "num")
    end = xml.rindex("</w:numbering>")
    at = re.search(r"<w:num[ >]", xml)
    at = at.start() if at else end
    return xml[:at] + abstracts + xml[at:end] + lists + xml[end:]


def _written(job: dict) -> bytes:
    with zipfile.ZipFile(io.BytesIO(job["content"])) as z:
        held = {n: z.read(n) for n in (DOCUMENT, STYLES, NUMBERING) if n in z.namelist()}
    document = held[DOCUMENT]
    named = re.search(rf'xmlns:(\w+)="{re.escape(packages.OFFICE_NS)}"'.encode(), document)
    prefix = named.group(1).decode() if named else "r"
    body = "".join(packages.PAGE_BREAK + _rewritten(b, prefix) for b in job["bodies"] or [])
    end = job["end"] if job["end"] is not None else document.index(b"</w:body>")
    document = document[:end] + body.encode() + document[end:]
    head, rest = document.decode().split("<w:body", 1)
    replace = {p["name"]: p["content"] for p in job["added"] or []}
    replace[DOCUMENT] = (X.declared(head, {prefix: packages.OFFICE_NS}) + "<w:body" + rest).encode()
    if job["styles"] and STYLES in held:
        old = held[STYLES].decode()
        at = old.rindex("</w:styles>")
        replace[STYLES] = (old[:at] + job["styles"] + old[at:]).encode()
    if job["defs"]:
        replace[NUMBERING] = _numbered(held.get(NUMBERING, NUMBERING_HEAD.encode()).decode(), job["defs"]).encode()
    return packages.repackaged(job["content"], replace)
