"""Formatted text of Word 97 files: pieces and formatted pages as rows, joined by offset; paragraphs, runs and cells."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import formats
from quire.sources import files as source
from quire.sources import word97

#: Bytes of the stream by which pieces and spans meet: both are cut where one begins.
BLOCK = 4096
#: Pieces and spans of an Arrow batch.
BATCH = 20_000
# Changes of paragraphs by code; those of characters that word97.CHANGES does not name; pages of the stream.
PARAGRAPH = {0x2403: "align", 0x2461: "align_2000", 0x2416: "in_table", 0x2417: "row_end", 0x6649: "depth", 0x244B: "inner_cell", 0x244C: "inner_row", 0x460B: "listed", 0x260A: "level", 0x2640: "outline"}
CHARACTER = {**word97.CHANGES, 0x2A0C: "highlight", 0x4A4F: "font", 0x6870: "rgb", 0x0855: "special", 0x6A03: "picture"}
PAGE = 512
# Where the header tells style sheet, character pages, paragraph pages and fonts, as offset and size in the table stream.
STYLES_AT, CHARACTERS_AT, PARAGRAPHS_AT, FONTS_AT = 162, 250, 258, 274

_TEXT = "start:bigint,end:bigint,width:int,place:bigint,text:string"
_SPAN = "start:bigint,end:bigint,font:string,changes:map<int,bigint>,sti:int,style:string,told:map<int,bigint>"
LAYOUT = f"path string, kind string, block bigint, texts array<struct<{_TEXT}>>, spans array<struct<{_SPAN}>>, error string"

#: The second unit of a character beyond U+FFFF, so that places of text are places of units.
SECOND = "\uffff"


def _part(main: bytes, side: bytes, at: int) -> bytes:
    start, size = struct.unpack_from("<II", main, at)
    return side[start : start + size]


def _units(data: bytes, width: int) -> str:
    """One character a unit: halves without their other half as U+FFFD."""
    if width == 1:
        return source.cp1252(data)
    text = data[: len(data) // 2 * 2].decode("utf-16le", "surrogatepass")
    return re.sub("[\U00010000-\U0010ffff]", lambda m: m[0] + SECOND, re.sub("[\ud800-\udfff]", "\ufffd", text))


def _cuts(start: int, end: int, width: int = 1) -> Iterator[tuple[int, int, int]]:
    """(block, start, end): a stretch cut at blocks; a unit is of the block of its first byte."""
    while start < end:
        block = start // BLOCK
        stop = min(start + -(-((block + 1) * BLOCK - start) // width) * width, end)
        yield block, start, stop
        start = stop


def _spans(main: bytes, bins: bytes, entry: int) -> list[tuple[int, int, bytes | None]]:
    """(start, end, bytes from where the entry points on, within its page) of formatted pages, whose entries have ``entry`` bytes."""
    n = max(len(bins) - 4, 0) // 8
    found = []
    for number in struct.unpack_from(f"<{n}I", bins, 4 * (n + 1)) if n else ():
        page = main[(number & 0x3FFFFF) * PAGE :][:PAGE]
        if len(page) < PAGE:
            continue
        count = min(page[-1], (PAGE - 5) // (4 + entry))
        edges = struct.unpack_from(f"<{count + 1}I", page, 0)
        spots = page[4 * (count + 1) :: entry][:count]
        bodies = {spot: page[2 * spot : -1] if spot else None for spot in set(spots)}
        found += [(edges[k], edges[k + 1], bodies[spot]) for k, spot in enumerate(spots)]
    return sorted(found, key=itemgetter(0, 1))


def _whole(spans: list, first: int, last: int) -> Iterator[tuple[int, int, bytes | None]]:
    """Spans that cover [first, last): gaps as spans without changes, of overlapping ones the earlier."""
    at = first
    for start, end, body in spans:
        start, end = max(start, at), min(end, last)
        if start < end:
            if at < start:
                yield at, start, None
            yield start, end, body
            at = end
    if at < last:
        yield at, last, None


def _styles(sheet: bytes) -> list[tuple[int, str] | None]:
    """(built-in number, name) of styles by index."""
    if len(sheet) < 6:
        return []
    at, found = 2 + struct.unpack_from("<H", sheet, 0)[0], []
    for _ in range(struct.unpack_from("<H", sheet, 2)[0]):
        size = int.from_bytes(sheet[at : at + 2], "little")
        one, base = sheet[at + 2 : at + 2 + size], struct.unpack_from("<H", sheet, 4)[0]
        at += 2 + size
        n = int.from_bytes(one[base : base + 2], "little")
        name = one[base + 2 : base + 2 + 2 * n]
        found.append((int.from_bytes(one[:2], "little") & 0xFFF, name.decode("utf-16le", "replace")) if len(one) >= base + 2 else None)
    return found


def _fonts(names: bytes) -> list[str]:
    """Names of fonts by index."""
    at, found = 4, []
    while at < len(names) and len(found) < int.from_bytes(names[:2], "little"):
        one = names[at + 1 : at + 1 + names[at]][39:]
        found.append(one[: len(one) // 2 * 2].decode("utf-16le", "replace").split("\0")[0])
        at += 1 + names[at]
    return found


def _numbers(body: bytes) -> dict[int, int]:
    """Changes with operands of up to four bytes as numbers, the last of a code."""
    return {code: int.from_bytes(operand, "little") for code, operand in word97.changes(body) if len(operand) <= 4}


def _met(chars: Iterator[tuple], paras: Iterator[tuple]) -> Iterator[tuple[int, int, bytes | None, bytes | None]]:
    """(start, end, body, body): two rows of spans that cover the same stretch, cut where one of either begins."""
    nothing = (0, 0, None)
    (start, to, body), (_, until, told) = next(chars, nothing), next(paras, nothing)
    while start < to:
        end = min(to, until)
        yield start, end, body, told
        start = end
        if end == to:
            _, to, body = next(chars, nothing)
        if end == until:
            _, until, told = next(paras, nothing)


def _character(body: bytes | None, fonts: list[str]) -> tuple:
    """(font, changes) of characters."""
    found = _numbers(body[1 : 1 + body[0]]) if body else {}
    font = fonts[found[0x4A4F]] if found.get(0x4A4F, len(fonts)) < len(fonts) else None
    return font, tuple(found.items())


def _paragraph(body: bytes | None, styles: list[tuple[int, str] | None]) -> tuple:
    """(built-in number and name of the style, changes) of a paragraph."""
    inner = b"" if not body else body[1 : 2 * body[0]] if body[0] else body[2 : 2 + 2 * body[1]]
    index = int.from_bytes(inner[:2], "little")
    sti, name = (styles[index] if index < len(styles) else None) or (None, None)
    return sti, name, tuple(_numbers(inner[2:]).items())


def _blocks(content: bytes) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
    """(block, texts, spans) of a file's blocks in order; what spans say is worked out once for all that say the same."""
    streams = source.word97_streams(content)
    main, side = streams["WordDocument"], streams["table"]
    pieces = list(source.word97_pieces(main, side))
    if not pieces:
        return
    fonts, styles = _fonts(_part(main, side, FONTS_AT)), _styles(_part(main, side, STYLES_AT))
    texts: dict[int, list[tuple]] = {}
    for place, units, start, width in pieces:
        text = _units(main[start : start + units * width], width).ljust(units, SECOND)
        for block, a, b in _cuts(start, start + units * width, width):
            k = (a - start) // width
            texts.setdefault(block, []).append((a, b, width, place + k, text[k : (b - start) // width]))
    first, last = min(p[2] for p in pieces), max(p[2] + p[1] * p[3] for p in pieces)
    spans = (_whole(_spans(main, _part(main, side, at), entry), first, last) for at, entry in ((CHARACTERS_AT, 1), (PARAGRAPHS_AT, 13)))
    looks: dict[bytes | None, tuple] = {}
    told: dict[bytes | None, tuple] = {}
    at, held = first // BLOCK, []
    for a, b, body, own in _met(*spans):
        if body not in looks:
            looks[body] = _character(body, fonts)
        if own not in told:
            told[own] = _paragraph(own, styles)
        for block, start, end in ((at, a, b),) if b <= (at + 1) * BLOCK else _cuts(a, b):
            if block > at:
                if at in texts:
                    yield at, texts.pop(at), held
                at, held = block, []
            # Neighbours that say the same are one span, whatever a file cuts them into.
            if held and held[-1][1] == start and held[-1][2] is looks[body] and held[-1][3] is told[own]:
                held[-1] = (held[-1][0], end, *held[-1][2:])
            else:
                held.append((start, end, looks[body], told[own]))
    if at in texts:
        yield at, texts.pop(at), held


def _told(values: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    """Columns of tuples of which few differ: each is made once and taken by its number."""
    numbers: dict[tuple, int] = {}
    at = pa.array([numbers.setdefault(v, len(numbers)) for v in values], pa.int32())
    return [pa.array([v[k] for v in numbers], t).take(at) for k, t in enumerate(types)]


def _lists(each: list[list[tuple] | None], columns: Callable[[list[tuple]], list[pa.Array]], names: str) -> pa.ListArray:
    flat = [x for some in each for x in some or ()]
    edges = pa.array(accumulate((len(some or ()) for some in each), initial=0), pa.int32())
    return pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(columns(flat), [n.split(":")[0] for n in names.replace("<int,", "<").split(",")]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (path, kind, block, texts, spans, error) of LAYOUT."""
    changes = pa.map_(pa.int32(), pa.int64())
    column = lambda k, kind: pa.array([r[k] for r in rows], kind)
    texts = lambda flat: [pa.array([t[k] for t in flat], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()))]
    spans = lambda flat: [*(pa.array([s[k] for s in flat], pa.int64()) for k in (0, 1)), *_told([s[2] for s in flat], [pa.string(), changes]), *_told([s[3] for s in flat], [pa.int32(), pa.string(), changes])]
    made = [column(0, pa.string()), column(1, pa.string()), column(2, pa.int64()), _lists([r[3] for r in rows], texts, _TEXT), _lists([r[4] for r in rows], spans, _SPAN), column(5, pa.string())]
    return pa.RecordBatch.from_arrays(made, ["path", "kind", "block", "texts", "spans", "error"])


def layout(found: DataFrame) -> DataFrame:
    """A row a block of the stream of Word 97 files (path, content, format): pieces of text, and spans of one set of changes; an error row for a file that cannot be read.

    A block has as many pieces and spans as it has bytes, at most, for pieces that do not overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    read = [(path, "block", *b, None) for b in _blocks(content.as_py())]
                except (KeyError, IndexError, ValueError, TypeError, struct.error, MemoryError) as e:
                    read = [(path, "error", None, None, None, str(e) or type(e).__name__)]
                for row in read:
                    held.append(row)
                    size += 1 + len(row[3] or ()) + len(row[4] or ())
                    if size >= BATCH:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)

    return found.where("format = 'doc'").select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, LAYOUT)


# Segments: text with the changes of its characters and of its paragraph --------------------------


def _segments(laid: DataFrame) -> DataFrame:
    """(path, place, text, font, c, sti, style, p): text of one span of characters and one of paragraphs."""
    # Blocks are dealt to all tasks, as one task may have parsed a large file, or many small ones whose few bytes Spark would leave to it.
    dealt = laid.where("kind = 'block'").repartition(int(laid.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "block")
    cut = dealt.select("path", F.explode("texts").alias("t"), "spans")
    cut = cut.select("path", "t", F.explode(F.filter("spans", lambda s: (s["start"] < F.col("t.end")) & (s["end"] > F.col("t.start")))).alias("s"))
    unit = lambda edge: F.ceil((edge - F.col("t.start")) / F.col("t.width")).cast("int")
    lo, hi = unit(F.greatest("t.start", "s.start")), unit(F.least("t.end", "s.end"))
    placed = cut.select("path", (F.col("t.place") + lo).alias("place"), F.substring("t.text", lo + 1, hi - lo).alias("text"), "s.font", F.col("s.changes").alias("c"), "s.sti", "s.style", F.col("s.told").alias("p"))
    return placed.where("text <> ''")


def _change(column: str, names: dict[int, str], name: str) -> Column:
    return F.try_element_at(column, F.lit(next(code for code, n in names.items() if n == name)))


def _look() -> Column:
    value = lambda name: _change("c", CHARACTER, name)
    on = lambda name: F.coalesce(value(name).isin(1, 0x81), F.lit(False)).alias(name)
    any_ = lambda name: F.coalesce(value(name) != 0, F.lit(False)).alias(name)
    rgb = F.lpad(F.hex(value("rgb")), 8, "0")
    exact = F.when(value("rgb") < 1 << 24, F.concat(F.substring(rgb, 7, 2), F.substring(rgb, 5, 2), F.substring(rgb, 3, 2)))
    numbered = formats.indexed_colour(value("colour"))
    colour = F.when(value("rgb").isNotNull(), exact).otherwise(numbered).alias("colour")
    return F.struct(on("bold"), on("italic"), any_("underline"), on("strike"), any_("highlight"), value("half_points").cast("int").alias("half_points"), colour, "font")


def _tokens(found: DataFrame, looks: bool) -> DataFrame:
    """(path, paragraph, place, k, kind, text, look, picture, m): text between marks in order, null kinds for what does not show, m what a paragraph's mark says.

    A paragraph's mark is in the row of the text before it, if both look alike.
    """
    tokens = _segments(layout(found)).select("*", F.posexplode(F.split("text", "(?<=[\\x01\\x07\\x08\\x0c\\r\\x13-\\x15])|(?=[\\x01\\x08\\x0c\\x13-\\x15])")).alias("k", "token")).drop("text").where("token <> ''")
    special = F.coalesce(_change("c", CHARACTER, "special").isin(1, 0x81), F.lit(False)) & F.col("token").isin("\x01", "\x08")
    hidden = F.coalesce(_change("c", CHARACTER, "hidden").isin(1, 0x81), F.lit(False))
    plain = F.regexp_replace(F.translate("token", "\x0b\x1e\n", "\n-"), "[\x00-\x08\x0c-\x1f\ufffc\uffff]", "")
    mark = F.right("token", F.lit(1))
    ends = mark.isin("\r", "\x07")
    # What changes say is read before the rows are sorted: only a paragraph's mark takes those of its paragraph along.
    said = {"look": _look(), "picture": F.when(special, _change("c", CHARACTER, "picture"))} if looks else {}
    told = F.when(ends, F.struct(mark.alias("token"), "sti", "style", "p"))
    tokens = tokens.select("path", "place", "k", "token", special.alias("_special"), hidden.alias("_hidden"), plain.alias("_plain"), told.alias("m"), *[c.alias(n) for n, c in said.items()])
    order = Window.partitionBy("path").orderBy("place", "k")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    opens, parts, closes = (F.col("token") == c for c in "\x13\x14\x15")
    moved = tokens.withColumns({"paragraph": F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)), "_s": F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(upto)})
    # How many fields are open after a token; one that closes none changes nothing.
    moved = moved.withColumn("_open", F.col("_s") - F.least(F.min("_s").over(upto), F.lit(0)))
    moved = moved.withColumn("_level", F.when(opens | parts, F.col("_open")).when(closes, F.coalesce(F.lag("_open").over(order), F.lit(0))))
    asked = F.coalesce(F.lag("token").over(Window.partitionBy("path", "_level").orderBy("place", "k")), F.lit("")) != "\x13"
    moved = moved.withColumn("_turn", F.when(opens, 1).when((parts | closes) & ~asked, -1).otherwise(0))
    kind = F.when(F.col("token") == "\x0c", "page").when(F.col("_special"), "picture").when(F.col("_plain") != "", "text")
    shown = (F.sum("_turn").over(upto) <= 0) & ~F.col("_hidden")
    return moved.select("path", "paragraph", "place", "k", F.when(shown, kind).alias("kind"), F.when(kind == "text", F.col("_plain")).otherwise("").alias("text"), "m", *said)


def _told_by_marks(whole: DataFrame, *more: str) -> DataFrame:
    """What the marks (m) of paragraphs (path, paragraph) say, and ``more`` columns."""
    p = whole.select("path", "paragraph", F.col("m.token").alias("mark"), "m.sti", "m.style", F.col("m.p").alias("p"), *more)
    value = lambda name: _change("p", PARAGRAPH, name)
    flag = lambda name: F.coalesce(value(name) != 0, F.lit(False))
    sides = F.coalesce(value("align_2000"), value("align"))
    align = F.when(sides == 1, "center").when(sides == 2, "right").when(sides.isin(3, 4), "both").otherwise("left")
    depth = F.greatest(F.coalesce(value("depth"), F.lit(0)), (flag("in_table") | F.coalesce(F.col("mark") == "\x07", F.lit(False))).cast("long")).cast("int")
    return p.select(
        "path", "paragraph", "mark", "sti", "style", align.alias("align"), (depth > 0).alias("in_table"), (flag("row_end") & (flag("in_table") | (value("depth") > 0))).alias("row_end"), depth.alias("depth"), flag("inner_cell").alias("inner_cell"), flag("inner_row").alias("inner_row"),
        flag("listed").alias("listed"), F.least(F.coalesce(value("level"), F.lit(0)), F.lit(8)).cast("int").alias("level"), F.when(value("outline") < 9, value("outline")).cast("int").alias("outline"), *more,
    )


def body(found: DataFrame) -> DataFrame:
    """(path, paragraph, mark, sti, style, align, in_table, row_end, depth, inner_cell, inner_row, listed, level, outline, runs): paragraphs of Word 97 files in order.

    A run is (kind, text, bold, italic, underline, strike, highlight, half_points, colour, font, picture); kinds
    are text, page (a page break) and picture. Neighbours that look alike are one run. Hidden text, the
    instructions of fields and control characters go; a line break is a line end. Text after the last mark is
    a paragraph without a mark and without properties. A file without text gives no row, nor does one that
    cannot be read (``layout`` has its error).
    """
    moved = _tokens(found, True)
    inside = Window.partitionBy("path", "paragraph").orderBy("place", "k")
    visible = F.struct("kind", "look", "picture")
    last = F.last(F.when(F.col("kind").isNotNull(), visible), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("kind").isNotNull() & ~((F.col("kind") == "text") & last.eqNullSafe(visible))
    moved = moved.withColumn("run", F.sum(fresh.cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.when(F.col("kind").isNotNull(), F.struct("place", "k", "text"))
    runs = moved.groupBy("path", "paragraph", "run").agg(F.any_value(F.when(F.col("kind").isNotNull(), visible), ignoreNulls=True).alias("v"), F.array_sort(F.collect_list(piece)).alias("t"), F.any_value("m", ignoreNulls=True).alias("m"))
    one = F.struct("run", F.col("v.kind").alias("kind"), F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"), "v.look.*", F.col("v.picture").alias("picture"))
    whole = runs.groupBy("path", "paragraph").agg(F.any_value("m", ignoreNulls=True).alias("m"), F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), one))).alias("runs"))
    return _told_by_marks(whole.withColumn("runs", F.transform("runs", lambda r: r.dropFields("run"))), "runs")


def lines(found: DataFrame) -> DataFrame:
    """The paragraphs of ``body`` with their ``text`` in place of runs: no looks are worked out."""
    shown = F.when(F.col("kind") == "text", F.struct("place", "k", "text"))
    whole = _tokens(found, False).groupBy("path", "paragraph").agg(F.any_value("m", ignoreNulls=True).alias("m"), F.sort_array(F.collect_list(shown)).alias("_texts"))
    return _told_by_marks(whole.withColumn("text", F.array_join("_texts.text", "")), "text")


def runs(paragraphs: DataFrame) -> DataFrame:
    """(path, paragraph, run, ...): the runs of ``body`` one by one."""
    return paragraphs.select("path", "paragraph", F.posexplode("runs").alias("run", "r")).select("path", "paragraph", "run", "r.*")


def kinds(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` with kind and kind_level (of headings from 1, of lists from 0), by style, list and outline."""
    name = F.lower(F.coalesce("style", F.lit("")))
    said = F.regexp_extract(name, "^heading (.*)", 1).try_cast("int")
    heading = F.when(F.col("sti").between(1, 9), F.least("sti", F.lit(6))).when(name.startswith("heading "), F.greatest(F.least(F.coalesce(said, F.lit(1)), F.lit(6)), F.lit(1)))
    kind = F.when(heading.isNotNull(), "heading").when((F.col("sti") == 62) | (name == "title"), "title").when(name.contains("quote"), "quote").when(F.col("listed") | name.startswith("list"), "list").when(F.col("outline").isNotNull(), "heading").otherwise("normal")
    level = F.when(kind == "heading", F.coalesce(heading, F.least(F.col("outline") + 1, F.lit(6)))).when(kind == "list", F.col("level")).otherwise(0)
    return paragraphs.withColumns({"kind": kind, "kind_level": level})


def cells(paragraphs: DataFrame) -> DataFrame:
    """(path, depth, first, row, cell, text): cells of the tables of ``body`` or of ``lines``; ``first`` is the paragraph that a table begins with.

    Depth 1 is a table in the text, 2 one within a cell, and so on. Paragraphs of a depth that follow each
    other are a table; what is deeper belongs to the outer cell too. Paragraphs of a cell are apart by line
    ends, empty ones before the first with text go. Text after the last mark of a cell is a cell if not empty.
    """
    text = F.col("text") if "text" in paragraphs.columns else F.array_join(F.transform(F.filter("runs", lambda r: r["kind"] == "text"), lambda r: r["text"]), "")
    own = paragraphs.where("depth > 0").select("path", "paragraph", F.col("depth").alias("_depth"), "mark", "row_end", "inner_cell", "inner_row", text.alias("line"), F.explode(F.sequence(F.lit(1), "depth")).alias("depth"))
    here = F.col("_depth") == F.col("depth")
    top = F.col("depth") == 1
    ends_row = F.when(top, F.col("row_end")).otherwise(here & F.col("inner_row"))
    ends_cell = F.when(top, F.coalesce(F.col("mark") == "\x07", F.lit(False)) & ~F.col("row_end")).otherwise(here & F.col("inner_cell") & ~F.col("inner_row"))
    own = own.select("path", "depth", "paragraph", "line", ends_row.alias("_row"), ends_cell.alias("_cell"))
    # One order serves all: rows and cells are numbered by what has ended since their table or row began.
    level = Window.partitionBy("path", "depth").orderBy("paragraph")
    upto, before = (level.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    past = lambda flag: F.coalesce(F.sum(F.col(flag).cast("int")).over(before), F.lit(0)).cast("int")
    begins = F.coalesce(F.lag("paragraph").over(level) + 1 != F.col("paragraph"), F.lit(True))
    own = own.withColumns({"_begins": begins, "_rows": past("_row"), "_cells": past("_cell")})
    own = own.withColumn("_fresh", F.col("_begins") | F.lag("_row", 1, False).over(level))
    since = lambda flag, value: F.last(F.when(F.col(flag), F.col(value)), ignorenulls=True).over(upto)
    own = own.withColumns({"first": since("_begins", "paragraph"), "row": F.col("_rows") - since("_begins", "_rows"), "cell": F.col("_cells") - since("_fresh", "_cells")}).where(~F.col("_row"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("paragraph", "line"))), lambda x: x["line"])
    made = own.groupBy("path", "depth", "first", "row", "cell").agg(lines.alias("lines"), F.bool_or("_cell").alias("ended"))
    joined = F.aggregate("lines", F.lit(""), lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit("\n"), x)))
    return made.select("path", "depth", "first", "row", "cell", joined.alias("text"), "ended").where("ended or text <> ''").drop("ended")
