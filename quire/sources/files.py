"""Files as tables: bytes, formats, text, packages and their parts."""

from __future__ import annotations

import fnmatch
import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quire.functions import equations, formats
from quire.functions import text as T
from quire.functions.xml import local, parse, tag_end, walk
from quire.sources import tables

#: Subtrees that hold what is shown elsewhere, or not at all.
SKIPPED = frozenset({"txbxContent", "Fallback"})
#: Ancestors that each element names.
NAMED = ("p", "r", "tc", "tr", "tbl", "pPr", "rPr", "oMath", "oMathPara", "fldSimple", "drawing")
#: Elements whose text is all of their XML.
WHOLE = {"pPr", "rPr", "oMath", "oMathPara", "drawing", "tblBorders", "tcBorders", "tblCellMar", "tcMar", "style", "abstractNum", "num"}
#: An equation that is no part of another one.
EQUATION = "p is not null and oMath is null and oMathPara is null and name in ('oMath', 'oMathPara')"
EQUATIONS = frozenset({"oMath", "oMathPara"})
PAGE_BREAK = "[page break]"
#: Names of parts that are XML.
XML = ("*.xml", "*.rels")
#: Bytes of a part: an Arrow value holds less than 2 GB.
LARGEST = 1 << 30
#: Rows and bytes of what a task holds before it passes them on; a single part may be larger.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
PARTS = "path string, part string, content binary, error string"
ELEMENTS = "path string, part string, pos int, parent int, name string, attrs map<string,string>, text string, first int, end int, error string, " + ", ".join(f"{n} int" for n in NAMED)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, format): every file below a folder, and what its bytes are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", formats.sniff(F.col("content"), holds_word97(F.col("content"))).alias("format"))


def is_word97(content: bytes | None) -> bool:
    """Whether a compound file holds a Word document."""
    try:
        return content is not None and "WordDocument" in compound_streams(content)
    except (IndexError, struct.error):
        return False


@F.pandas_udf(BooleanType())
def _holds_word97(content: pd.Series) -> pd.Series:
    return content.map(is_word97).astype(bool)


def holds_word97(content: Column) -> Column:
    """Whether a compound file holds a Word document; only compound files go to Python."""
    return _holds_word97(F.when(F.hex(F.substring(content, 1, 8)) == "D0CF11E0A1B11AE1", content))


def text_files(files: DataFrame) -> DataFrame:
    """(path, text) of text files, by mark or as UTF-8 or Windows-1252."""
    return files.where("format = 'text'").select("path", T.decode_text(F.col("content")).alias("text"))


def passed_on(found: Iterable[tuple[list[tuple], int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the rows of many files, each given with its bytes: a small file has no batch of its own, and no batch grows with the input."""
    rows, held = [], 0
    for some, size in found:
        rows += some
        held += size
        if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def slices(batches: Iterable[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to some ``most`` bytes (a row at least), as Python objects take many times the bytes of their batch."""
    for batch in batches:
        n = max(1, min(BATCH_ROWS, batch.num_rows * most // max(batch.nbytes, 1)))
        for k in range(0, batch.num_rows, n):
            yield batch.slice(k, n)


def _unzipped(path: str, content: bytes | None, parts: Sequence[str] | None, largest: int) -> list[tuple]:
    """Rows of PARTS of a package."""

    def content_of(z: zipfile.ZipFile, entry: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        with z.open(entry) as f:
            content = f.read(largest + 1) if entry.file_size <= largest else None
        return (content, None) if content is not None and len(content) <= largest else (None, f"a part of more than {largest} bytes")

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            wanted = [e for e in z.infolist() if not e.is_dir() and (parts is None or any(fnmatch.fnmatchcase(e.filename, p) for p in parts))]
            return [(path, e.filename, *content_of(z, e)) for e in wanted]
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, TypeError, NotImplementedError, RuntimeError) as e:
        return [(path, None, None, str(e) or type(e).__name__)]


def package_parts(files: DataFrame, parts: Sequence[str] | None = None, largest: int = LARGEST) -> DataFrame:
    """(path, part, content, error): a row a part of each zip package; one row with an error for a broken one.

    ``parts`` are patterns of names as of a shell (all by default); a package's directory is read first, and
    only the parts that it wants are unzipped. A part of more than ``largest`` bytes, by its directory or once
    unzipped, has an error instead of its content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("part", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        found = (_unzipped(path.as_py(), content.as_py(), parts, largest) for batch in batches for path, content in zip(batch.column(0), batch.column(1), strict=True))
        return passed_on(((rows, sum(len(r[2] or b"") for r in rows)) for rows in found), schema)

    return files.where("format = 'docx'").select("path", "content").mapInArrow(run, PARTS)


def package_entries(files: DataFrame) -> DataFrame:
    """(path, part, size, packed): the directories of packages, nothing of which is unzipped; a broken package has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        rows += [(path, e.filename, e.file_size, e.compress_size) for e in z.infolist() if not e.is_dir()]
                except (zipfile.BadZipFile, OSError, ValueError, TypeError, NotImplementedError):
                    continue
            if rows:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "part", "size", "packed"])

    return files.where("format = 'docx'").select("path", "content").mapInArrow(run, "path string, part string, size long, packed long")


def _shred(content: bytes, skipped: frozenset[str] = SKIPPED, named: tuple[str, ...] = NAMED) -> list[tuple]:
    """Elements of an XML part in order: names without prefixes, their own text, byte span and named ancestors.

    Of what ``skipped`` names only the element itself is there.
    """
    rows: list[list] = []
    stack: list[int] = []
    place = {n: i for i, n in enumerate(named)}
    near: list[tuple] = [(None,) * len(named)]
    skip = [0]

    def start(name: str, attrs: dict, first: int) -> None:
        if skip[0]:
            skip[0] += 1
            return
        pos = len(rows)
        above, i = near[-1], place.get(name)
        rows.append([pos, stack[-1] if stack else None, name, attrs, "", first, None, above])
        stack.append(pos)
        near.append(above if i is None else (*above[:i], pos, *above[i + 1 :]))
        skip[0] = int(name in skipped)

    def end(at: int) -> None:
        if skip[0]:
            skip[0] -= 1
            if skip[0]:
                return
        row = rows[stack.pop()]
        row[6] = at
        if row[2] in WHOLE:
            row[4] = content[row[5] : at].decode("utf-8", "replace")
        near.pop()

    def chars(data: str) -> None:
        if stack and not skip[0]:
            rows[stack[-1]][4] += data

    walk(content, start, end, chars)
    return [(*r[:7], *r[7]) for r in rows]


def elements(parts: DataFrame, boxes: bool = False) -> DataFrame:
    """A row an element of every XML part; one row with an error for a part that is not well formed.

    With ``boxes``, what is in text boxes too, with a column ``txbxContent``: the box that an element is in.
    """
    given = parts.where("error is null and (part like '%.xml' or part like '%.rels')").select("path", "part", "content")
    return given.mapInArrow(_shredding(boxes, lambda path, part, content: [(path, part, content)]), ELEMENTS + (", txbxContent int" if boxes else ""))


def _shredding(boxes: bool, parts_of: Callable[..., list[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes rows of ELEMENTS of batches, of whose rows ``parts_of`` gives the parts (path, part, content)."""
    named = (*NAMED, "txbxContent") if boxes else NAMED
    skipped = SKIPPED - {"txbxContent"} if boxes else SKIPPED

    def rows_of(path: str, part: str, content: bytes) -> list[tuple]:
        try:
            return [(path, part, *r[:3], list(r[3].items()), *r[4:7], None, *r[7:]) for r in _shred(content, skipped, named)]
        except expat.ExpatError as e:
            return [(path, part, *[None] * 7, str(e), *[None] * len(named))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("part", pa.string()), ("pos", pa.int32()), ("parent", pa.int32()), ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("error", pa.string()), *((n, pa.int32()) for n in named)])
        given = (part for batch in batches for row in zip(*batch.columns, strict=True) for part in parts_of(*(c.as_py() for c in row)))
        return passed_on(((rows_of(*part), len(part[2])) for part in given), schema)

    return run


def shredded_packages(files: DataFrame, parts: Sequence[str] = XML) -> DataFrame:
    """``elements`` of packages as a written table (``tables.release``): plans that read them in several places parse each file once.

    ``parts`` are patterns of the names of parts that are wanted, as in ``package_parts``.
    """

    def parts_of(path: str, content: bytes | None) -> list[tuple]:
        found = _unzipped(path, content, parts, LARGEST)
        return [(path, part, content) for path, part, content, error in found if error is None and part.endswith((".xml", ".rels"))]

    given = files.where("format = 'docx'").select("path", "content")
    return tables.saved(given.mapInArrow(_shredding(False, parts_of), ELEMENTS), "elements")


#: Columns of elements of a few names; ``math`` is the line of an equation that is no part of another one, and positions are those among all elements.
FEW = "path string, part string, pos int, name string, attrs map<string,string>, text string, math string, error string"


class _Few:
    """Rows of FEW and ``within`` by columns, of elements of some names."""

    def __init__(self, names: frozenset[str], within: tuple[str, ...]):
        self.names, self.within = names, within
        self.schema = pa.schema([("path", pa.string()), ("part", pa.string()), ("pos", pa.int32()), ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("math", pa.string()), ("error", pa.string()), *((n, pa.int32()) for n in within)])
        self.kinds: dict[str, tuple | None] = {}
        self.clear()

    def clear(self) -> None:
        self.paths, self.pos, self.name, self.attrs, self.text, self.near = ([] for _ in range(6))
        # Rows that have a line of an equation, or an error: few.
        self.math: dict[int, str] = {}
        self.error: dict[int, str] = {}

    def kind(self, name: str) -> tuple[str, bool, int | None, bool, bool] | None:
        """(name without prefix, asked for, its place in ``within``, an equation, skipped); null where all that counts is that it is there."""
        bare = local(name)
        found = bare, bare in self.names, self.within.index(bare) if bare in self.within else None, bare in EQUATIONS, bare in SKIPPED
        self.kinds[name] = found if any(found[1:]) or found[2] is not None else None
        return self.kinds[name]

    def add(self, path: str, part: str, content: bytes) -> None:
        before = len(self.pos)
        try:
            self._parse(content)
        except expat.ExpatError as e:
            for column in (self.pos, self.name, self.attrs, self.text, self.near):
                column[before:] = [None]
            self.near[before] = (None,) * len(self.within)
            self.math, self.error[before] = {k: v for k, v in self.math.items() if k < before}, str(e)
        self.paths += [(path, part)] * (len(self.pos) - before)

    def _parse(self, content: bytes) -> None:
        kinds, names, texts, nears = self.kinds, self.name, self.text, self.near
        add_pos, add_name, add_attrs, add_text, add_near = (c.append for c in (self.pos, names, self.attrs, texts, nears))
        # What is open: null, or the row of an element, if it has one, and the ancestors around it.
        open_: list[tuple | None] = []
        put, take = open_.append, open_.pop
        near: tuple = (None,) * len(self.within)
        pos = skip = equations_open = 0

        def start(name: str, attrs: list[str]) -> None:
            nonlocal near, pos, skip, equations_open
            if skip:
                skip += 1
                return
            kind = kinds[name] if name in kinds else self.kind(name)
            if kind is None:
                put(None)
                pos += 1
                return
            bare, wanted, place, equation, skipped = kind
            first = None
            if equation:
                equations_open += 1
                first = parser.CurrentByteIndex if wanted and equations_open == 1 else -1
            if wanted:
                put((len(names), near, first, pos))
                add_pos(pos)
                add_name(bare)
                add_attrs(list({local(k): v for k, v in zip(attrs[::2], attrs[1::2], strict=True) if not k.startswith("xmlns")}.items()) if attrs else None)
                add_text("")
                add_near(near)
            else:
                put((None, near, first, pos))
            if place is not None:
                near = (*near[:place], pos, *near[place + 1 :])
            pos += 1
            if skipped:
                skip = 1

        def end(_: str) -> None:
            nonlocal near, skip, equations_open
            if skip:
                skip -= 1
                if skip:
                    return
            one = take()
            if one is None:
                return
            row, near, first, at = one
            if first is not None:
                equations_open -= 1
                if first >= 0:
                    self.math[row] = equations.linear(content[first : tag_end(content, parser.CurrentByteIndex, first if pos == at + 1 else -1)].decode("utf-8", "replace"))[0]

        def chars(data: str) -> None:
            if open_ and not skip and open_[-1] is not None and open_[-1][0] is not None:
                texts[open_[-1][0]] += data

        parser = expat.ParserCreate()
        parser.buffer_text = parser.ordered_attributes = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
        parse(parser, content)

    def batch(self) -> pa.RecordBatch:
        few = lambda told: [told.get(k) for k in range(len(self.pos))] if told else pa.nulls(len(self.pos), pa.string())
        columns = *zip(*self.paths, strict=True), self.pos, self.name, self.attrs, self.text, few(self.math), few(self.error), *zip(*self.near, strict=True)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.clear()
        return made


def few_elements(files: DataFrame, parts: Sequence[str], names: Iterable[str], within: tuple[str, ...] = ()) -> DataFrame:
    """FEW and ``within`` of packages: elements of some names, parsed as they are read; one row with an error for a part that is not well formed.

    For a plan that reads its elements once, as ``cells`` (CELLS) and ``sections`` (SECTIONS) do: no row is made
    of what it does not ask for. ``within`` are the named ancestors that it asks for.
    """
    names = frozenset(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = _Few(names, within), 0
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                for path_, part, xml, error in _unzipped(path.as_py(), content.as_py(), parts, LARGEST):
                    if error is None and part.endswith((".xml", ".rels")):
                        made.add(path_, part, xml)
                        held += len(xml)
                    if len(made.pos) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield made.batch()
                        held = 0
        if made.pos:
            yield made.batch()

    return files.where("format = 'docx'").select("path", "content").mapInArrow(run, FEW + "".join(f", {n} int" for n in within))


#: Elements and ancestors that ``cells`` and ``sections`` ask for.
CELLS = ("tc", "gridSpan", "p", "t", "tab", "br", "cr", "oMath", "oMathPara"), ("p", "r", "tc", "tr", "tbl", "pPr", "oMath", "oMathPara", "drawing")
SECTIONS = ("sectPr", "pgSz", "pgMar"), ()


def paragraphs(shredded: DataFrame, part: str = "word/document.xml") -> DataFrame:
    """(path, pos, style_id, kind, style_level, num, level, in_cell, first, end, text) of a document's paragraphs in order.

    Text is that of the runs, with tabs and line breaks as characters and equations on one line; page breaks, notes' and fields' codes are none.
    """
    own = shredded.where((F.col("part") == part) & F.col("error").isNull())
    value = lambda name: F.max(F.when((F.col("name") == name) & F.col("pPr").isNotNull() & F.col("rPr").isNull(), F.element_at("attrs", "val")))
    breaks = F.coalesce(F.element_at("attrs", "type").isin("page", "column"), F.lit(False))
    shown = F.when(F.col("name") == "t", F.col("text")).when(F.col("name") == "tab", F.lit("\t")).when(F.col("name").isin("br", "cr") & ~breaks, F.lit("\n"))
    plain = F.col("r").isNotNull() & F.col("pPr").isNull() & F.col("oMath").isNull() & F.col("drawing").isNull() & shown.isNotNull()
    pieces = F.array_sort(F.collect_list(F.when(plain, F.struct("pos", shown.alias("s"))).when(F.expr(EQUATION), F.struct("pos", F.col("math").alias("s")))))
    own = own.withColumn("math", equations.equation_text(F.when(F.expr(EQUATION), F.col("text")))["plain"])
    inner = own.where(F.col("p").isNotNull()).groupBy("path", F.col("p").alias("pos")).agg(
        value("pStyle").alias("style_id"), value("numId").try_cast("int").alias("num"), value("ilvl").try_cast("int").alias("_ilvl"), value("outlineLvl").try_cast("int").alias("_outline"),
        F.array_join(F.transform(pieces, lambda x: x["s"]), "").alias("text"),
    )
    bare = own.where("name = 'p'").select("path", "pos", F.col("tc").isNotNull().alias("in_cell"), "tc", "first", "end")
    joined = bare.join(inner, ["path", "pos"], "left")
    kind = formats.style_kind(F.col("style_id"), F.col("_outline"))
    return joined.select("path", "pos", "style_id", kind["kind"].alias("kind"), kind["level"].alias("style_level"), "num", formats.list_level(F.col("num"), F.col("_ilvl")).alias("level"), "in_cell", "tc", "first", "end", F.coalesce("text", F.lit("")).alias("text"))


def cells(shredded: DataFrame, part: str = "word/document.xml") -> DataFrame:
    """(path, tbl, row, col, span, text) of table cells: rows and columns counted from 0, paragraphs apart by line ends.

    Reads ``elements`` or ``few_elements`` of CELLS, once, and shuffles them once.
    """
    name = F.col("name")
    breaks = F.coalesce(F.element_at("attrs", "type").isin("page", "column"), F.lit(False))
    shown = F.when(name == "t", F.col("text")).when(name == "tab", F.lit("\t")).when(name.isin("br", "cr") & ~breaks, F.lit("\n"))
    plain = F.col("p").isNotNull() & F.col("r").isNotNull() & F.col("pPr").isNull() & F.col("oMath").isNull() & F.col("drawing").isNull() & shown.isNotNull()
    math = F.col("math") if "math" in shredded.columns else equations.equation_text(F.when(F.expr(EQUATION), F.col("text")))["plain"]
    own = shredded.where((F.col("part") == part) & F.col("error").isNull()).select(
        "path", "name", "pos", "tbl", "tr", "tc", "p", F.when(plain, shown).when(F.expr(EQUATION), math).alias("s"), F.when(name == "gridSpan", F.greatest(F.element_at("attrs", "val").try_cast("int"), F.lit(1))).alias("span")
    )
    dealt = own.where("name in ('tc', 'p') or s is not null or span is not null").repartition(int(shredded.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    # Text is its paragraph's, and the paragraph is its cell's; a cell and what says its width stand beside the paragraphs.
    of_cell = F.when(name == "tc", F.col("pos")).when(name == "gridSpan", F.col("tc"))
    of_p = F.when(name == "p", F.col("pos")).when(F.col("s").isNotNull(), F.col("p"))
    only = lambda what, c: F.max(F.when(name == what, F.col(c)))
    joined = lambda by, what: F.sort_array(F.collect_list(F.when(F.col(what).isNotNull(), F.struct(by, what))))[what]
    lines = dealt.groupBy("path", of_p.alias("line"), of_cell.alias("cell")).agg(
        only("p", "tc").alias("tc"), F.bool_or(name == "p").alias("is_p"), F.bool_or(name == "tc").alias("is_cell"), only("tc", "tbl").alias("tbl"), only("tc", "tr").alias("tr"), F.min(F.when(name == "gridSpan", F.struct("pos", "span")))["span"].alias("span"), F.array_join(joined("pos", "s"), "").alias("text")
    )
    held = lines.select("path", F.coalesce("cell", "tc").alias("tc"), "line", "is_cell", "tbl", "tr", "span", F.when(F.col("is_p"), F.col("text")).alias("text")).where("tc is not null")
    made = held.groupBy("path", "tc").agg(F.bool_or("is_cell").alias("is_cell"), F.max("tbl").alias("tbl"), F.max("tr").alias("tr"), F.max("span").alias("span"), F.array_join(joined("line", "text"), "\n").alias("text")).where("is_cell")
    # Columns are numbered first: rows then need no other order.
    placed = made.withColumn("col", F.row_number().over(Window.partitionBy("path", "tbl", "tr").orderBy("tc")) - 1).withColumn("row", F.dense_rank().over(Window.partitionBy("path", "tbl").orderBy("tr")) - 1)
    return placed.select("path", "tbl", "row", "col", F.coalesce("span", F.lit(1)).alias("span"), "text")


def styles(shredded: DataFrame) -> DataFrame:
    """(path, style_id, kind, based_on, font, size, bold, colour, after, num) of style sheets, null where a style is silent."""
    own = shredded.where("part = 'word/styles.xml' and error is null")
    heads = own.where("name = 'style'").select("path", F.col("pos").alias("style"), F.element_at("attrs", "styleId").alias("style_id"), F.element_at("attrs", "type").alias("kind"))
    # The style that an element is in begins last before it.
    w = Window.partitionBy("path", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    within = own.withColumn("style", F.last(F.when(F.col("name") == "style", F.col("pos")), ignorenulls=True).over(w)).where("style is not null")
    val = lambda name, attr="val": F.max(F.when(F.col("name") == name, F.element_at("attrs", attr)))
    props = within.groupBy("path", "style").agg(
        val("basedOn").alias("based_on"), val("rFonts", "ascii").alias("font"), (val("sz").try_cast("double") / 2).alias("size"),
        F.max(F.when(F.col("name") == "b", formats.toggle(F.element_at("attrs", "val"), ("false", "0", "none", "off")))).alias("bold"),
        formats.colour(val("color")).alias("colour"), formats.twips(val("spacing", "after")).alias("after"), val("numId").try_cast("int").alias("num"),
    )
    return heads.join(props, ["path", "style"], "left").drop("style")


def all_relationships(shredded: DataFrame) -> DataFrame:
    """(path, source_part, seq, rel_id, type, target, external) as they stand in every relationships part."""
    rel = shredded.where("name = 'Relationship' and error is null")
    source = F.regexp_replace("part", r"_rels/([^/]*)\.rels$", "$1")
    attr = lambda a: F.element_at("attrs", a)
    return rel.select("path", source.alias("source_part"), F.col("pos").alias("seq"), attr("Id").alias("rel_id"), attr("Type").alias("type"), attr("Target").alias("target"), F.coalesce(attr("TargetMode") == "External", F.lit(False)).alias("external"))


def relationships(shredded: DataFrame) -> DataFrame:
    """(path, source_folder, rel_id, target) of internal relationships, targets as part names."""
    rel = shredded.where("name = 'Relationship'")
    folder = F.regexp_replace("part", r"_rels/[^/]*$", "")
    inside = rel.where(F.coalesce(F.element_at("attrs", "TargetMode"), F.lit("Internal")) != "External")
    return inside.select("path", folder.alias("source_folder"), F.element_at("attrs", "Id").alias("rel_id"), formats.resolve_path(folder, F.element_at("attrs", "Target")).alias("target"))


# Compound files -----------------------------------------------------------------


def compound_streams(content: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name. Chains that loop or leave the file end there."""
    shift, mini_shift = struct.unpack_from("<HH", content, 30)
    size, mini = 1 << shift, 1 << mini_shift
    n_fat, first_dir = struct.unpack_from("<I", content, 44)[0], struct.unpack_from("<I", content, 48)[0]
    cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIII", content, 56)
    sector = lambda i: content[(i + 1) * size : (i + 2) * size]
    table = list(struct.unpack_from("<109I", content, 76))
    at = first_difat
    for _ in range(n_difat):
        entries = struct.unpack(f"<{size // 4}I", sector(at).ljust(size, b"\xff"))
        table += entries[:-1]
        at = entries[-1]
    fat = [x for s in table[:n_fat] for x in struct.unpack(f"<{size // 4}I", sector(s).ljust(size, b"\xff"))]

    def chain(i: int, links: list[int]) -> list[int]:
        out: list[int] = []
        while i < len(links) and len(out) <= len(links):
            out.append(i)
            i = links[i]
        return out

    whole = lambda i: b"".join(map(sector, chain(i, fat)))
    mini_bytes = whole(first_mini)
    mini_fat = list(struct.unpack(f"<{len(mini_bytes) // 4}I", mini_bytes))
    folder = whole(first_dir)
    entries = [folder[k : k + 128] for k in range(0, len(folder) - 127, 128)]
    store = whole(struct.unpack_from("<I", entries[0], 116)[0])
    found = {}
    for e in entries:
        length, kind = struct.unpack_from("<HB", e, 64)
        start, n = struct.unpack_from("<IQ", e, 116)
        n &= 0xFFFFFFFF
        if kind == 2:
            body = whole(start) if n >= cutoff else b"".join(store[k * mini : (k + 1) * mini] for k in chain(start, mini_fat))
            found[e[: max(length - 2, 0)].decode("utf-16le", "replace")] = body[:n]
    return found


def word97_streams(content: bytes) -> dict[str, bytes]:
    """Streams of a Word 97 document, its table stream as ``table``; ValueError for other and encrypted ones."""
    streams = compound_streams(content)
    main = streams["WordDocument"]
    magic, version = struct.unpack_from("<HH", main, 0)
    flags = struct.unpack_from("<H", main, 10)[0]
    if magic != 0xA5EC or version < 193 or flags & 0x0100:
        raise ValueError("not a Word 97 document, or an encrypted one")
    return {**streams, "table": streams["1Table" if flags & 0x0200 else "0Table"]}


def word97_pieces(main: bytes, side: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(place, units, offset, bytes a unit) of the pieces of the main text, in order."""
    n_chars = struct.unpack_from("<I", main, 76)[0]
    at, size = struct.unpack_from("<II", main, 418)
    clx, k = side[at : at + size], 0
    while clx[k] == 1:
        k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
    n = (struct.unpack_from("<I", clx, k + 1)[0] - 4) // 12
    places = struct.unpack_from(f"<{n + 1}I", clx, k + 5)
    for i in range(n):
        fc = struct.unpack_from("<I", clx, k + 5 + 4 * (n + 1) + 8 * i + 2)[0]
        units = min(places[i + 1], n_chars) - places[i]
        if units > 0:
            yield (places[i], units, (fc & 0x3FFFFFFF) // 2, 1) if fc & 0x40000000 else (places[i], units, fc & 0x3FFFFFFF, 2)


def cp1252(data: bytes) -> str:
    return "".join(T.CP1252_HIGH[b - 128] if 128 <= b < 160 else chr(b) for b in data)


def word97_text(content: bytes) -> str:
    """The main text of a Word 97 document, through its piece table; paragraph marks as line ends, cell marks as tabs."""
    streams = word97_streams(content)
    main, out = streams["WordDocument"], []
    for _, units, start, width in word97_pieces(main, streams["table"]):
        data = main[start : start + width * units]
        out.append(cp1252(data) if width == 1 else data.decode("utf-16le", "replace"))
    return "".join(out).replace("\r", "\n").replace("\x07", "\t").replace("\x0b", "\n")


def word97_texts(files: DataFrame) -> DataFrame:
    """(path, text, error) of Word 97 files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, errors = [], []
            for content in batch.column(1).to_pylist():
                try:
                    texts.append(word97_text(content))
                    errors.append(None)
                except (KeyError, IndexError, ValueError, struct.error) as e:
                    texts.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    return files.where("format = 'doc'").select("path", "content").mapInArrow(run, "path string, text string, error string")


# TIFF ------------------------------------------------------------------------------

#: Tag numbers of what a page's size needs.
TIFF_TAGS = {256: "width", 257: "height", 258: "bits", 274: "orientation", 282: "x_dpi", 283: "y_dpi", 296: "unit"}


def tiff_pages(content: bytes) -> list[dict]:
    """Tags of every page of a classic or big TIFF; a chain of directories that loops or leaves the file ends."""
    e = "<" if content[:2] == b"II" else ">"
    big = struct.unpack_from(e + "H", content, 2)[0] == 43
    # Counts of entries, an entry's count and offsets: 2, 4 and 4 bytes, or 8 each.
    entries, word, width = ("Q", "Q", 20) if big else ("H", "I", 12)
    number = struct.calcsize(e + word)
    sizes = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 16: ("Q", 8)}
    at, pages, seen = struct.unpack_from(e + word, content, 8 if big else 4)[0], [], set()
    while at and at not in seen and at + struct.calcsize(e + entries) <= len(content):
        seen.add(at)
        tags = {}
        n = struct.unpack_from(e + entries, content, at)[0]
        base = at + struct.calcsize(e + entries)
        if base + width * n + number > len(content):
            break
        for k in range(n):
            spot = base + width * k
            tag, kind, count = struct.unpack_from(e + "HH" + word, content, spot)
            if tag in TIFF_TAGS and kind in sizes:
                form, size = sizes[kind]
                place = spot + 4 + number
                if size * count > number:
                    place = struct.unpack_from(e + word, content, place)[0]
                if place + size <= len(content):
                    value = struct.unpack_from(e + form, content, place)
                    tags[TIFF_TAGS[tag]] = float(value[0]) if len(value) == 1 else value[0] / value[1] if value[1] else 0.0
        pages.append(tags)
        at = struct.unpack_from(e + word, content, base + width * n)[0]
    return pages


def tiff_table(files: DataFrame) -> DataFrame:
    """(path, page, width, height, width_pt, height_pt, turn): pages of TIFF files and their size in points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(TIFF_TAGS.values())
        for batch in batches:
            rows = [(p, k, *(t.get(n) for n in names)) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, t in enumerate(tiff_pages(c))]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[2:])], ["path", "page", *names])

    raw = files.where(formats.is_tiff(F.col("content"))).select("path", "content").mapInArrow(run, "path string, page int, " + ", ".join(f"{n} double" for n in TIFF_TAGS.values()))
    per_inch = lambda c: F.when((F.col(c) > 0) & (F.col("unit") == 3), F.col(c) * 2.54).when(F.col(c) > 0, F.col(c)).otherwise(F.lit(72.0))
    turn = F.when(F.col("orientation") == 6, 1).when(F.col("orientation") == 3, 2).when(F.col("orientation") == 8, 3).otherwise(0)
    return raw.select("path", "page", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), (F.col("width") / per_inch("x_dpi") * 72).alias("width_pt"), (F.col("height") / per_inch("y_dpi") * 72).alias("height_pt"), turn.alias("turn"))


# More of word-processor packages -------------------------------------------------------

# Elements in a paragraph that mean that it is kept word for word. A drawing that is just a picture in a run does not.
LOCKING = [
    "drawing", "pict", "object", "fldChar", "fldSimple", "oMath", "oMathPara", "footnoteReference", "endnoteReference", "commentReference",
    "ins", "del", "moveFrom", "moveTo", "sdt", "ruby", "sym", "AlternateContent",
]
PICTURE = "http://schemas.openxmlformats.org/drawingml/2006/picture"


def _within(shredded: DataFrame, head: str) -> DataFrame:
    """Elements with ``at``: the position of the last ``head`` element that begins before or with each."""
    w = Window.partitionBy("path", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return shredded.withColumn("at", F.last(F.when(F.col("name") == head, F.col("pos")), ignorenulls=True).over(w))


def list_levels(shredded: DataFrame) -> DataFrame:
    """(path, num, level, format, template, start) of numbering parts: lists, what they are based on, starts that they override."""
    own = shredded.where("part = 'word/numbering.xml' and error is null")
    val = lambda name: F.max(F.when(F.col("name") == name, F.element_at("attrs", "val")))
    abstract = _within(own, "abstractNum").where("at is not null").withColumnRenamed("at", "abs_at")
    ids = own.where("name = 'abstractNum'").select("path", F.col("pos").alias("abs_at"), F.element_at("attrs", "abstractNumId").alias("abstract"))
    inner = _within(abstract, "lvl").where("at is not null and at > abs_at")
    levels = inner.groupBy("path", "abs_at", "at").agg(F.max(F.when(F.col("name") == "lvl", F.element_at("attrs", "ilvl"))).try_cast("int").alias("level"), val("numFmt").alias("format"), val("lvlText").alias("template"), val("start").try_cast("int").alias("start"))
    nums = _within(own, "num").where("at is not null")
    heads = nums.groupBy("path", "at").agg(F.max(F.when(F.col("name") == "num", F.element_at("attrs", "numId"))).try_cast("int").alias("num"), val("abstractNumId").alias("abstract")).drop("at")
    over = _within(nums.withColumnRenamed("at", "num_at"), "lvlOverride").where("at > num_at")
    starts = over.groupBy("path", "num_at", "at").agg(F.max(F.when(F.col("name") == "lvlOverride", F.element_at("attrs", "ilvl"))).try_cast("int").alias("level"), val("startOverride").try_cast("int").alias("_start"))
    named = starts.join(own.where("name = 'num'").select("path", F.col("pos").alias("num_at"), F.element_at("attrs", "numId").try_cast("int").alias("num")), ["path", "num_at"]).select("path", "num", "level", "_start")
    full = heads.join(ids, ["path", "abstract"]).join(levels, ["path", "abs_at"]).join(named, ["path", "num", "level"], "left")
    return full.select("path", "num", "level", F.coalesce("format", F.lit("decimal")).alias("format"), F.coalesce("template", F.lit("")).alias("template"), F.coalesce("_start", "start", F.lit(1)).alias("start"))


def notes(shredded: DataFrame, kind: str = "footnote") -> DataFrame:
    """(path, note_id, type, text) of the foot- or endnotes part; paragraphs apart by line ends."""
    own = _within(shredded.where((F.col("part") == f"word/{kind}s.xml") & F.col("error").isNull()), kind).where("at is not null")
    heads = own.where(F.col("name") == kind).select("path", "at", F.element_at("attrs", "id").try_cast("int").alias("note_id"), F.element_at("attrs", "type").alias("type"))
    lines = own.where("name = 't'").groupBy("path", "at", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("line"))
    text = lines.groupBy("path", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return heads.join(text, ["path", "at"], "left").select("path", "note_id", "type", F.coalesce("text", F.lit("")).alias("text"))


def note_references(shredded: DataFrame) -> DataFrame:
    """(path, pos, foot, note_id) of the references to notes in a document, in order of pos."""
    refs = shredded.where("part = 'word/document.xml' and name in ('footnoteReference', 'endnoteReference')")
    return refs.select("path", "pos", (F.col("name") == "footnoteReference").alias("foot"), F.element_at("attrs", "id").try_cast("int").alias("note_id"))


def sections(shredded: DataFrame) -> DataFrame:
    """(path, section, width, height, top, right, bottom, left) in points; what a section leaves out is that of the one before.

    Reads ``elements`` or ``few_elements`` of SECTIONS.
    """
    named = shredded.where("part = 'word/document.xml' and error is null and name in ('sectPr', 'pgSz', 'pgMar')").select("path", "part", "pos", "name", "attrs")
    # Dealt by file once, for all that is worked out within a file.
    dealt = named.repartition(int(shredded.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    own = _within(dealt, "sectPr").where("at is not null")
    attr = lambda name, a: formats.twips(F.max(F.when(F.col("name") == name, F.element_at("attrs", a))))
    names = {"width": ("pgSz", "w"), "height": ("pgSz", "h"), **{m: ("pgMar", m) for m in ("top", "right", "bottom", "left")}}
    rows = own.groupBy("path", "at").agg(*[attr(*where).alias(n) for n, where in names.items()])
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    number = F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1
    return rows.select("path", number.alias("section"), *[F.last(n, ignorenulls=True).over(w).alias(n) for n in names])


def locked_paragraphs(shredded: DataFrame) -> DataFrame:
    """(path, pos) of paragraphs that are kept word for word: fields, equations, notes, tracked changes, objects, page breaks, drawings but pictures."""
    body = shredded.where("part = 'word/document.xml' and error is null and p is not null")
    breaks = (F.col("name") == "br") & F.element_at("attrs", "type").isin("page", "column")
    picture = (F.col("parent") == F.col("r")) & F.contains("text", F.lit(f'"{PICTURE}"')) & F.contains("text", F.lit(":embed=")) & ~F.contains("text", F.lit("txbxContent"))
    locking = F.col("name").isin(*LOCKING) & ~((F.col("name") == "drawing") & F.coalesce(picture, F.lit(False)))
    inside = F.col("drawing").isNull()
    return body.where(inside & (locking | breaks)).select("path", F.col("p").alias("pos")).distinct()


def items(shredded: DataFrame) -> DataFrame:
    """(path, item, pos, name, kind, n_blocks, first, end) of what a document's body holds, in order.

    Kinds are paragraph, locked, table and other. A span goes on to where the next one begins, so that
    all spans together are the body. n_blocks counts the paragraphs in it.
    """
    own = shredded.where("part = 'word/document.xml' and error is null")
    body = own.where("name = 'body'").select("path", F.col("pos").alias("parent"))
    tops = own.join(body, ["path", "parent"]).select("path", "pos", "name", "first", "end")
    locked = locked_paragraphs(shredded).withColumn("locked", F.lit(True))
    kind = F.when(F.col("name") == "tbl", "table").when(F.col("name") != "p", "other").when(F.col("locked"), "locked").otherwise("paragraph")
    w = Window.partitionBy("path").orderBy("pos")
    placed = tops.join(locked, ["path", "pos"], "left").withColumns({"item": F.row_number().over(w) - 1, "last": F.coalesce(F.lead("first").over(w), "end"), "next": F.lead("pos").over(w)})
    marks = own.where("name = 'p'").select("path", F.col("pos").alias("_p"))
    within = _as_of(placed.select("path", "pos"), marks).groupBy("path", "pos").agg(F.count(F.lit(1)).alias("n_blocks"))
    counted = placed.join(within, ["path", "pos"], "left")
    return counted.select("path", "item", "pos", "name", kind.alias("kind"), F.coalesce("n_blocks", F.lit(0)).cast("int").alias("n_blocks"), "first", F.col("last").alias("end"))


def _as_of(tops: DataFrame, marks: DataFrame) -> DataFrame:
    """(path, pos): for each mark (path, _p) the last of ``tops`` that begins before or with it."""
    both = tops.select("path", F.col("pos").alias("_at"), F.lit(0).alias("_kind"), "pos").unionByName(marks.select("path", F.col("_p").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("pos")))
    w = Window.partitionBy("path").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("pos", F.last("pos", ignorenulls=True).over(w)).where("_kind = 1 and pos is not null").select("path", "pos")


def runs(shredded: DataFrame, part: str = "word/document.xml") -> DataFrame:
    """(path, p, pos, text, bold, italic, underline, highlight, hidden, caps, props, field, math, foot, note_id, placeholder) of runs in order of pos.

    ``p`` is the run's paragraph and ``props`` the XML in its properties. Tabs and breaks are characters;
    equations and page breaks are runs of their own, with placeholder set. ``field`` is page or pages for
    runs of a field that shows them; fields in fields are not told apart.
    """
    own = shredded.where((F.col("part") == part) & F.col("error").isNull() & F.col("p").isNotNull() & F.col("pPr").isNull())
    plain = own.where("r is not null and oMath is null and drawing is null")
    value, kind = F.element_at("attrs", "val"), F.element_at("attrs", "type")
    code = F.conv(F.element_at("attrs", "char"), 16, 10).cast("long")
    symbol = F.char(F.when(code.between(0xF000, 0xF0FF), code - 0xF000).otherwise(code))
    is_break = (F.col("name") == "br") & F.coalesce(kind.isin("page", "column"), F.lit(False))
    shown = (
        F.when(F.col("name") == "t", F.col("text")).when(F.col("name") == "tab", F.lit("\t")).when(F.col("name") == "noBreakHyphen", F.lit("\u2011")).when(F.col("name") == "sym", symbol)
        .when(F.col("name").isin("footnoteReference", "endnoteReference"), F.lit("*")).when(F.col("name").isin("br", "cr") & ~is_break, F.lit("\n"))
    )
    pieces = F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct("pos", shown.alias("s")))))
    flag = lambda name, on: F.coalesce(F.max(F.when((F.col("name") == name) & F.col("rPr").isNotNull(), on)), F.lit(False))
    toggled, said = formats.toggle(value), F.coalesce(value != "none", F.lit(False))
    note = lambda c: F.max(F.when(F.col("name").isin("footnoteReference", "endnoteReference"), c))
    of_run = plain.groupBy("path", "p", F.col("r").alias("pos")).agg(
        F.array_join(F.transform(pieces, lambda x: x["s"]), "").alias("text"), flag("b", toggled).alias("bold"), flag("i", toggled).alias("italic"), flag("u", said).alias("underline"), flag("highlight", said).alias("highlight"),
        flag("vanish", toggled).alias("hidden"), flag("caps", toggled).alias("caps"), F.max(F.when(F.col("name") == "rPr", F.regexp_replace("text", r"(?s)^<[^>]*>|</[^>]*>$", ""))).alias("props"),
        note(F.col("name") == "footnoteReference").alias("foot"), note(F.element_at("attrs", "id").try_cast("int")).alias("note_id"),
        F.max(F.when(is_break, F.lit(True))).alias("breaks"), F.max(F.when(F.col("name") == "fldChar", F.element_at("attrs", "fldCharType"))).alias("mark"),
        F.max(F.when(F.col("name") == "instrText", F.col("text"))).alias("instr"), F.max("fldSimple").alias("simple"),
    )
    simple = own.where("name = 'fldSimple'").select("path", F.col("pos").alias("simple"), F.element_at("attrs", "instr").alias("_simple"))
    w = Window.partitionBy("path", "p").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(F.col("mark").isNotNull(), F.col("mark")), ignorenulls=True).over(w)
    code_of = F.last(F.when(F.col("instr").isNotNull(), F.col("instr")), ignorenulls=True).over(w)
    fielded = of_run.join(simple, ["path", "simple"], "left").withColumns({"_state": state, "_code": code_of})
    field = formats.field_kind(F.coalesce("_simple", F.when(F.col("_state") == "separate", F.col("_code"))))
    texts = fielded.where(F.length("text") > 0).select("path", "p", "pos", "text", "bold", "italic", "underline", "highlight", "hidden", "caps", F.coalesce("props", F.lit("")).alias("props"), field.alias("field"), F.lit(None).cast("string").alias("math"), "foot", "note_id", F.lit(False).alias("placeholder"))
    no = F.lit(False)
    bare = lambda df, text, math: df.select("path", "p", "pos", text.alias("text"), *[no.alias(n) for n in ("bold", "italic", "underline", "highlight", "hidden", "caps")], F.lit("").alias("props"), F.lit(None).cast("string").alias("field"), math.alias("math"), F.lit(None).cast("boolean").alias("foot"), F.lit(None).cast("int").alias("note_id"), F.lit(True).alias("placeholder"))
    breaks = bare(of_run.where("breaks"), F.lit(PAGE_BREAK), F.lit(None).cast("string"))
    maths = own.where(F.expr(EQUATION)).withColumn("_m", equations.equation_text(F.col("text")))
    return texts.unionByName(breaks).unionByName(bare(maths, F.col("_m.plain"), F.col("_m.markup")))


def borders(shredded: DataFrame, name: str = "tblBorders") -> DataFrame:
    """(path, part, pos, edge, colour, width): lines that border sets name; a line that is explicitly none has a null width. Widths are points."""
    sets = shredded.where((F.col("name") == name) & F.col("error").isNull()).select("path", "part", F.col("pos").alias("parent"))
    lines = shredded.join(sets, ["path", "part", "parent"])
    edge = F.when(F.col("name") == "start", "left").when(F.col("name") == "end", "right").otherwise(F.col("name"))
    kind = F.coalesce(F.element_at("attrs", "val"), F.lit(""))
    there = ~kind.isin("nil", "none", "")
    width = F.greatest(F.coalesce(F.element_at("attrs", "sz").try_cast("double"), F.lit(4.0)) / 8, F.lit(0.25))
    shown = lines.select("path", "part", F.col("parent").alias("pos"), edge.alias("edge"), F.when(there, F.coalesce(formats.colour(F.element_at("attrs", "color")), F.lit(0))).alias("colour"), F.when(there, width).alias("width"))
    return shown.where(F.col("edge").isin("top", "left", "bottom", "right", "insideH", "insideV"))


def cell_margins(shredded: DataFrame, name: str = "tblCellMar") -> DataFrame:
    """(path, part, pos, top, right, bottom, left) in points of margin sets, null where a set is silent."""
    sets = shredded.where((F.col("name") == name) & F.col("error").isNull()).select("path", "part", F.col("pos").alias("parent"))
    inner = shredded.join(sets, ["path", "part", "parent"])
    side = lambda *names: formats.twips(F.max(F.when(F.col("name").isin(*names), F.element_at("attrs", "w"))))
    return inner.groupBy("path", "part", F.col("parent").alias("pos")).agg(side("top").alias("top"), side("right", "end").alias("right"), side("bottom").alias("bottom"), side("left", "start").alias("left"))


def content_types(shredded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, name, type) of parts named one by one, (path, ext, type) by extension)."""
    own = shredded.where("part = '[Content_Types].xml' and error is null")
    attr = lambda a: F.element_at("attrs", a)
    by_name = own.where("name = 'Override'").select("path", F.regexp_replace(attr("PartName"), "^/", "").alias("name"), attr("ContentType").alias("type"))
    by_ext = own.where("name = 'Default'").select("path", F.lower(attr("Extension")).alias("ext"), attr("ContentType").alias("type"))
    return by_name, by_ext


def drawings(shredded: DataFrame, part: str = "word/document.xml") -> DataFrame:
    """(path, p, pos, kind, rel_id, cx, cy, shape, h_from, v_from, h_offset, v_offset, h_align, v_align, behind, wrapped) of drawings.

    Kinds are picture, textbox and shape; offsets are EMU. Inline ones have no anchor: their frames are null.
    """
    own = shredded.where((F.col("part") == part) & F.col("error").isNull())
    heads = own.where("name = 'drawing'").select("path", "p", "pos", F.contains("text", F.lit("txbxContent")).alias("_box"))
    inner = own.where("drawing is not null").withColumn("_up", F.col("parent"))
    names = own.where("drawing is not null").select("path", F.col("pos").alias("_up"), F.col("name").alias("up"))
    near = inner.join(names, ["path", "_up"], "left")
    attr = lambda name, a: F.max(F.when(F.col("name") == name, F.element_at("attrs", a)))
    under = lambda name, up: F.max(F.when((F.col("name") == name) & (F.col("up") == up), F.trim("text")))
    read = near.groupBy("path", F.col("drawing").alias("pos")).agg(
        attr("blip", "embed").alias("rel_id"), attr("extent", "cx").try_cast("long").alias("cx"), attr("extent", "cy").try_cast("long").alias("cy"), attr("prstGeom", "prst").alias("shape"),
        attr("positionH", "relativeFrom").alias("h_from"), attr("positionV", "relativeFrom").alias("v_from"), under("posOffset", "positionH").try_cast("long").alias("h_offset"), under("posOffset", "positionV").try_cast("long").alias("v_offset"),
        under("align", "positionH").alias("h_align"), under("align", "positionV").alias("v_align"), F.coalesce(attr("anchor", "behindDoc").isin("1", "true"), F.lit(False)).alias("behind"),
        F.bool_or(F.col("name").isin("wrapSquare", "wrapTight", "wrapThrough", "wrapTopAndBottom")).alias("wrapped"),
    )
    joined = heads.join(read, ["path", "pos"], "left")
    kind = F.when(F.col("_box"), "textbox").when(F.col("rel_id").isNotNull(), "picture").otherwise("shape")
    return joined.select("path", "p", "pos", kind.alias("kind"), *[c for c in read.columns if c not in ("path", "pos")])


def part_roles(shredded: DataFrame) -> DataFrame:
    """(path, section, role, type, part): headers and footers (role) that sections of a document name, by the relationships of the document."""
    named = shredded.where("part = 'word/document.xml' and name in ('headerReference', 'footerReference')")
    inner = shredded.where("part = 'word/document.xml' and name = 'sectPr'").select("path", F.col("pos").alias("parent"), (F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1).alias("section"))
    own = named.select("path", "parent", F.regexp_replace("name", "Reference$", "").alias("role"), F.coalesce(F.element_at("attrs", "type"), F.lit("default")).alias("type"), F.element_at("attrs", "id").alias("rel_id"))
    rels = all_relationships(shredded).where("source_part = 'word/document.xml' and not external").select("path", "rel_id", formats.resolve_path(F.lit("word/"), F.col("target")).alias("part"))
    return own.join(inner, ["path", "parent"]).join(rels, ["path", "rel_id"]).select("path", "section", "role", "type", "part")


def texts_of_parts(shredded: DataFrame) -> DataFrame:
    """(path, part, pos, box, host, outer, text): paragraphs of every Word part (``elements`` with boxes): body, headers, footers, notes, text boxes.

    ``box`` is the text box that a paragraph stands in, ``host`` the paragraph that holds the box, and ``outer``
    the box around that one; all are null outside of boxes. A host's text is without that of its boxes. What
    is there twice for older readers is read once.
    """
    own = shredded.where("part like 'word/%.xml' and error is null")
    breaks = F.coalesce(F.element_at("attrs", "type").isin("page", "column"), F.lit(False))
    shown = F.when(F.col("name") == "t", F.col("text")).when(F.col("name") == "tab", F.lit("\t")).when(F.col("name").isin("br", "cr") & ~breaks, F.lit("\n"))
    # A run of a box stands in a drawing, but the box begins after it.
    inside = F.col("drawing").isNull() | F.coalesce(F.col("txbxContent") > F.col("drawing"), F.lit(False))
    run = F.col("r") > F.col("p")
    pieces = own.where(inside & run & shown.isNotNull() & F.col("pPr").isNull()).groupBy("path", "part", F.col("p").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("s")))), lambda x: x["s"]), "").alias("text"))
    boxes = own.where("name = 'txbxContent'").select("path", "part", F.col("pos").alias("box"), F.col("p").alias("host"), F.col("txbxContent").alias("outer"))
    bare = own.where("name = 'p' and part <> 'word/styles.xml'").select("path", "part", "pos", F.col("txbxContent").alias("box"))
    return bare.join(pieces, ["path", "part", "pos"], "left").join(boxes, ["path", "part", "box"], "left").select("path", "part", "pos", "box", "host", "outer", F.coalesce("text", F.lit("")).alias("text"))
