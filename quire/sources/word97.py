"""Word 97 files: their container written, a text written as the smallest document, and property changes read."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from itertools import accumulate, pairwise

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from quire.sources import files

SECTOR = 512
#: Streams of fewer bytes would go to small sectors; they are filled up instead.
CUTOFF = 4096
# Fixed values of the container: marks in the allocation table, its signature, entries in the header.
FREE, END, TABLE, TABLES = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
IN_HEADER = 109
# Property changes of characters by code, and how their operands are read.
CHANGES = {0x0835: "bold", 0x0836: "italic", 0x2A3E: "underline", 0x2A42: "colour", 0x4A43: "half_points", 0x0837: "strike", 0x083C: "hidden"}
#: Bytes of an operand by the highest three bits of its code; of the sixth kind the first byte says.
OPERANDS = (1, 1, 2, 4, 2, 2, 0, 3)


def _table_size(data: bytes, at: int) -> int:
    """Bytes of a row's definition, by its number of cells; writers differ in what its own size counts."""
    cells = data[at + 2] if at + 2 < len(data) else 0
    whole = 3 + 2 * (cells + 1) + 20 * cells
    return whole if at + whole <= len(data) else 1 + int.from_bytes(data[at : at + 2], "little")


def _tabs_size(data: bytes, at: int) -> int | None:
    """Bytes of a change of tab stops of which 255 says that its two lists tell their sizes; None of another."""
    if data[at : at + 1] != b"\xff":
        return None
    gone = data[at + 1] if at + 1 < len(data) else 0
    spot = at + 2 + 4 * gone
    return 3 + 4 * gone + 3 * (data[spot] if spot < len(data) else 0)


#: Changes whose size is told otherwise.
LONG = {0xD608: _table_size, 0xC615: _tabs_size}


def compound_file(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams by name, each of whole sectors; more tables than the header lists go to sectors of their own."""
    bodies = {n: b.ljust(max(CUTOFF, -(-len(b) // SECTOR) * SECTOR), b"\0") for n, b in streams.items()}
    n_dir = -(-(len(bodies) + 1) // 4)
    n_data = sum(len(b) // SECTOR for b in bodies.values()) + n_dir
    n_fat = n_more = 0
    while True:
        fat = -(-(n_data + n_fat + n_more) // (SECTOR // 4))
        more = -(-max(fat - IN_HEADER, 0) // (SECTOR // 4 - 1))
        if (fat, more) == (n_fat, n_more):
            break
        n_fat, n_more = fat, more
    first_data = n_fat + n_more
    links, starts, at = [TABLE] * n_fat + [TABLES] * n_more, {}, first_data
    for name, body in [*bodies.items(), ("", b"\0" * (n_dir * SECTOR))]:
        n = len(body) // SECTOR
        starts[name] = at
        links += [*range(at + 1, at + n), END]
        at += n
    links += [FREE] * (n_fat * (SECTOR // 4) - len(links))

    def entry(name: str, kind: int, child: int, right: int, start: int, size: int) -> bytes:
        coded = name.encode("utf-16le") + b"\0\0"
        return coded.ljust(64, b"\0") + struct.pack("<HBBIII", len(coded), kind, 1, FREE, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    names = sorted(bodies, key=lambda n: (len(n), n.upper()))
    folder = entry("Root Entry", 5, 1 if names else FREE, FREE, END, 0)
    folder += b"".join(entry(n, 2, FREE, k + 2 if k + 1 < len(names) else FREE, starts[n], len(bodies[n])) for k, n in enumerate(names))
    fats = list(range(n_fat))
    more = b""
    per = SECTOR // 4 - 1
    for k in range(n_more):
        held = fats[IN_HEADER + k * per : IN_HEADER + (k + 1) * per]
        more += struct.pack(f"<{per + 1}I", *held, *[FREE] * (per - len(held)), n_fat + k + 1 if k + 1 < n_more else END)
    head = SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIIII", n_fat, starts[""], 0, CUTOFF, END, 0, n_fat if n_more else END, n_more, 0)[:32]
    head += struct.pack(f"<{IN_HEADER}I", *(fats + [FREE] * IN_HEADER)[:IN_HEADER])
    return head + struct.pack(f"<{len(links)}I", *links) + more + b"".join(bodies.values()) + folder.ljust(n_dir * SECTOR, b"\0")


def text_document(text: str) -> bytes:
    """The smallest document that holds a text: its header and one piece; it names no styles or fonts."""
    units = text.replace("\n", "\r").encode("utf-16le")
    n = len(units) // 2
    main = bytearray(1024) + units
    struct.pack_into("<HH", main, 0, 0xA5EC, 193)
    struct.pack_into("<H", main, 10, 0x0200)
    struct.pack_into("<I", main, 76, n)
    pieces = b"\x02" + struct.pack("<I", 8 + 8) + struct.pack("<II", 0, n) + struct.pack("<HIH", 0, 1024, 0)
    struct.pack_into("<II", main, 418, 0, len(pieces))
    return compound_file({"WordDocument": bytes(main), "1Table": pieces})


def _pages(spans: list[tuple[int, int, bytes]], entry: int) -> tuple[list[bytes], list[int]]:
    """Formatted pages of spans that follow each other, and the offset that each begins with; equal changes of a page stand there once."""
    made, begins, at = [], [], 0
    while at < len(spans):
        low, places, n = SECTOR - 1, {b"": 0}, 0
        while at + n < len(spans):
            body = spans[at + n][2]
            room = low if body in places else (low - len(body)) // 2 * 2
            if 4 * (n + 2) + entry * (n + 1) > room:
                break
            if body not in places:
                low = places[body] = room
            n += 1
        if not n:
            raise ValueError("changes that no page holds")
        taken = spans[at : at + n]
        page = bytearray(SECTOR)
        struct.pack_into(f"<{n + 1}I", page, 0, *(s[0] for s in taken), taken[-1][1])
        for k, (_, _, body) in enumerate(taken):
            page[4 * (n + 1) + entry * k] = places[body] // 2
        for body, place in places.items():
            page[place : place + len(body)] = body if place else page[: len(body)]
        page[-1] = n
        made.append(bytes(page))
        begins.append(taken[0][0])
        at += n
    return made, begins


def _style_sheet(styles: list[tuple[int, str]]) -> bytes:
    """Styles by index (built-in number, name), without changes of their own."""
    head = struct.pack("<HHHHHHHHHH", 18, len(styles), 10, 1, 0x5B, 15, 0, 0, 0, 0)
    body = b""
    for number, name in styles:
        one = struct.pack("<HHHHH", number, 0xFFF1, 0, 0, 0) + struct.pack("<H", len(name)) + name.encode("utf-16le") + b"\0\0"
        body += struct.pack("<H", len(one)) + one
    return head + body


def _font_names(fonts: list[str]) -> bytes:
    body = b""
    for name in fonts:
        one = b"\0" * 39 + name.encode("utf-16le") + b"\0\0"
        body += bytes([len(one)]) + one
    return struct.pack("<HH", len(fonts), 0) + body


def formatted_document(paragraphs: list[dict], styles: list[tuple[int, str]], fonts: list[str]) -> bytes:
    """A document of paragraphs (style, changes, mark, runs of text and changes): a piece for neighbours of one width, 8 bits where all is ASCII."""
    return _formatted([(p["style"], p["changes"], p["mark"], [(r["text"], r["changes"]) for r in p["runs"] or []]) for p in paragraphs], styles, fonts)


def _formatted(paragraphs: Sequence[tuple], styles: list[tuple[int, str]], fonts: list[str]) -> bytes:
    """``formatted_document`` of tuples (style, changes, mark, runs as tuples). Neighbours of equal changes are one span of characters."""
    main, pieces, chars, paras, n = bytearray(2 * SECTOR), [], [], [], 0
    own: dict[tuple, bytes] = {}
    at, since, last = len(main), len(main), b""
    for style, changes, mark, runs in paragraphs:
        begin, mark = at, mark or "\r"
        wide = not (mark.isascii() and all(text.isascii() for text, _ in runs if text))
        coding = "utf-16le" if wide else "ascii"
        for text, told in (*runs, (mark, b"")):
            if text:
                told = told or b""
                if told != last:
                    if since < at:
                        chars.append((since, at, bytes([len(last)]) + last if last else b""))
                    since, last = at, told
                data = text.encode(coding)
                main += data
                at += len(data)
        units = (at - begin) // (1 + wide)
        if pieces and pieces[-1][2] == wide:
            pieces[-1][1] += units
        else:
            pieces.append([begin, units, wide])
        n += units
        body = own.get((style, changes))
        if body is None:
            told = struct.pack("<H", style or 0) + (changes or b"")
            body = own[style, changes] = b"\0" + bytes([(len(told) + 1) // 2]) + told + b"\0" * (len(told) % 2)
        paras.append((begin, at, body))
    if since < at:
        chars.append((since, at, bytes([len(last)]) + last if last else b""))
    end, table = len(main), b""

    def place(at: int, body: bytes) -> None:
        nonlocal table
        struct.pack_into("<II", main, at, len(table), len(body))
        table += body

    for at, spans, entry in ((250, chars, 1), (258, paras, 13)):
        made, begins = _pages(spans, entry)
        main += b"\0" * (-len(main) % SECTOR)
        first = len(main) // SECTOR
        main += b"".join(made)
        place(at, struct.pack(f"<{2 * len(made) + 1}I", *begins, end, *range(first, first + len(made))))
    starts = [0]
    for _, units, _ in pieces:
        starts.append(starts[-1] + units)
    listed = struct.pack(f"<{len(starts)}I", *starts) + b"".join(struct.pack("<HIH", 0, b if wide else 2 * b | 0x40000000, 0) for b, _, wide in pieces)
    place(418, b"\x02" + struct.pack("<I", len(listed)) + listed)
    place(162, _style_sheet(styles))
    place(274, _font_names(fonts))
    struct.pack_into("<HH", main, 0, 0xA5EC, 193)
    struct.pack_into("<H", main, 10, 0x0200)
    struct.pack_into("<H", main, 32, 14)
    struct.pack_into("<H", main, 62, 22)
    struct.pack_into("<I", main, 76, n)
    struct.pack_into("<H", main, 152, 93)
    return compound_file({"WordDocument": bytes(main), "1Table": table})


def formatted_documents(rows: DataFrame, styles: list[tuple[int, str]], fonts: list[str]) -> DataFrame:
    """(path, content): documents of paragraphs (path, pos, style, changes, mark, runs array of (text, changes)), in order of pos.

    ``style`` is an index into ``styles`` (built-in number, name; null is the first), ``mark`` a paragraph mark
    where null or a cell mark. Changes are bytes (``change``). A document must fit a task, as its file does.
    """

    each = F.transform(F.sort_array(F.collect_list(F.struct("pos", "style", "changes", "mark", "runs"))), lambda p: p.dropFields("pos"))
    return written_documents(rows.groupBy("path").agg(each.alias("paragraphs")), styles, fonts)


def written_documents(docs: DataFrame, styles: list[tuple[int, str]], fonts: list[str]) -> DataFrame:
    """``formatted_documents`` of rows (path, paragraphs), which have a document's paragraphs (style, changes, mark, runs) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files.slices(batches):
            made = [_formatted(p, styles, fonts) for p in _paragraphs(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["path", "content"])

    return docs.select(F.col("path").cast("string").alias("path"), "paragraphs").mapInArrow(run, "path string, content binary")


def _paragraphs(lists: pa.ListArray) -> Iterator[list[tuple]]:
    """Lists of paragraphs (style, changes, mark, runs) as ``_formatted`` takes them, turned into Python objects by their columns."""
    ends = lambda of: list(accumulate(pc.fill_null(pc.list_value_length(of), 0).to_pylist(), initial=0))
    objects = lambda c: c.to_numpy(zero_copy_only=False).tolist()
    style, changes, mark, runs = lists.flatten().flatten()
    each, at = list(zip(*map(objects, runs.flatten().flatten()), strict=True)), ends(runs)
    flat = list(zip(objects(pc.fill_null(style, 0)), objects(changes), objects(mark), (each[a:b] for a, b in pairwise(at)), strict=True))
    return (flat[a:b] for a, b in pairwise(ends(lists)))


def change(code: int, value: Column) -> Column:
    """The bytes of a change with a number of its code's size; null where the value is null."""
    size = OPERANDS[code >> 13]
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    turned = F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(size)])
    return F.unhex(F.concat(F.lit(struct.pack("<H", code).hex()), turned))


def text_documents(rows: DataFrame, path: str, text: str) -> DataFrame:
    """(path, content, holds): texts as documents; null texts as empty ones. ``holds`` says whether a file, read back, holds a Word document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A file takes several times the bytes of its text, so that few are made at once; each is told while it is here.
        for batch in files.slices(batches, files.BATCH_BYTES // 4):
            made = [text_document(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(map(files.is_word97, made), pa.bool_())], ["path", "content", "holds"])

    kind = rows.schema[path].dataType.simpleString()
    return rows.select(path, text).mapInArrow(run, f"path {kind}, content binary, holds boolean")


def changes(data: bytes) -> list[tuple[int, bytes]]:
    """(code, operand) of a list of property changes; one that is cut off ends it."""
    found, at = [], 0
    while at + 2 <= len(data):
        code = struct.unpack_from("<H", data, at)[0]
        at += 2
        size = OPERANDS[code >> 13]
        told = LONG[code](data, at) if code in LONG else None
        if told is not None:
            size = told
        elif not size:
            if at >= len(data):
                break
            size = data[at]
            at += 1
        if at + size > len(data):
            break
        found.append((code, data[at : at + size]))
        at += size
    return found


@F.pandas_udf(ArrayType(StructType([StructField("code", IntegerType()), StructField("operand", BinaryType())])))
def _changes(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else [{"code": c, "operand": o} for c, o in changes(d)])


def property_changes(data: Column) -> Column:
    """Array of (code, operand) of property changes."""
    return _changes(data)


def character_properties(found: Column) -> Column:
    """The properties (CHANGES) that changes set, the last of each; flags and numbers as numbers, null where none does."""
    little = lambda b: F.conv(F.concat(F.substring(F.hex(b), 3, 2), F.substring(F.hex(b), 1, 2)), 16, 10).cast("int")
    last = lambda code: F.try_element_at(F.filter(found, lambda c: c["code"] == code), F.lit(-1))["operand"]
    return F.struct(*[little(last(code)).alias(name) for code, name in CHANGES.items()])
