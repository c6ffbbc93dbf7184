"""Names, kinds and small formats: files, titles, styles, colours, lengths, dates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# Fixed values.
TEXT_EXTENSIONS = ["txt", "text", "md", "markdown", "log"]
LETTER_COUNTRIES = ["US", "CA", "MX", "CL", "CO", "VE", "PH", "PR", "GT", "CR", "PA", "DO", "SV", "NI", "BZ"]
PLACEHOLDER_TITLES = ["untitled", "untitled document", "microsoft word", "document"]
MONOSPACE = ["mono", "courier", "consol", "code", "typewriter"]
SERIF = ["times", "georgia", "cambria", "garamond", "serif", "roman", "book", "palatino", "minion"]
HIGHLIGHTS = {
    "yellow": "FFFF00", "green": "00FF00", "cyan": "00FFFF", "magenta": "FF00FF", "blue": "0000FF", "red": "FF0000",
    "darkBlue": "000080", "darkCyan": "008080", "darkGreen": "008000", "darkMagenta": "800080", "darkRed": "800000", "darkYellow": "808000",
    "darkGray": "808080", "lightGray": "C0C0C0", "black": "000000", "white": "FFFFFF",
}
#: The fifteen indexed colours, from 1.
INDEXED = ["000000", "0000FF", "00FFFF", "00FF00", "FF00FF", "FF0000", "FFFF00", "FFFFFF", "000080", "008080", "008000", "800080", "800000", "808000", "C0C0C0"]
EMU_PER_POINT = 12_700
EMU_PER_INCH = 914_400
# FNV-1a.
ID_SEEDS = (0xCBF29CE484222325, 0x84222325CBF29CE4)
ID_PRIME = 0x100000001B3
ANNOTATION_MACHINERY = ["Link", "Widget", "Popup"]
EMU_BY_UNIT = {"pt": EMU_PER_POINT, "": EMU_PER_POINT, "in": EMU_PER_INCH, "cm": 360_000, "mm": 36_000, "px": EMU_PER_INCH / 96}


def format_of(name: Column) -> Column:
    """pdf, doc, text or docx by a file name's extension; docx when it does not say."""
    ext = F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)/*$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("doc", "dot"), "doc").when(ext.isin(*TEXT_EXTENSIONS), "text").otherwise("docx")


def extension(fmt: Column) -> Column:
    return F.when(fmt == "text", "txt").otherwise(fmt)


def is_text(content: Column) -> Column:
    """A UTF-16 mark, or no NUL among the first 64 KiB."""
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    return marked | ~F.contains(F.substring(content, 1, 65_536), F.lit(b"\x00"))


def sniff(content: Column, is_word97: Column | None = None) -> Column:
    """pdf, docx, doc or text by the bytes; null for anything else.

    ``is_word97`` says of a compound file whether it holds a Word stream.
    """
    head = F.substring(content, 1, 1028)
    compound = F.hex(F.substring(content, 1, 8)) == "D0CF11E0A1B11AE1"
    word = is_word97 if is_word97 is not None else F.lit(True)
    return (
        F.when(F.contains(head, F.lit(b"%PDF-")), "pdf")
        .when(F.substring(content, 1, 2) == F.lit(b"PK"), "docx")
        .when(compound, F.when(word, "doc"))
        .when(is_text(content), "text")
    )


def is_tiff(content: Column) -> Column:
    """Classic or big TIFF of either byte order."""
    return F.hex(F.substring(content, 1, 4)).isin("49492A00", "4D4D002A", "49492B00", "4D4D002B")


def is_tiff_name(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)/*$", 1)).isin("tif", "tiff")


def picture_type(content: Column) -> Column:
    """png, jpeg, gif, bmp or tiff by the first bytes; else null."""
    h = F.hex(F.substring(content, 1, 4))
    return (
        F.when(h == "89504E47", "png").when(h.startswith("FFD8FF"), "jpeg").when(h == "47494638", "gif").when(h.startswith("424D"), "bmp").when(h.isin("49492A00", "4D4D002A"), "tiff")
    )


def picture_mime(content: Column) -> Column:
    """The media type of a picture; octet-stream if it is none."""
    kind = picture_type(content)
    return F.when(kind.isNotNull(), F.concat(F.lit("image/"), kind)).otherwise("application/octet-stream")


def picture_emu(width: Column, height: Column, most: Column) -> Column:
    """(cx, cy) of a picture of so many pixels at 96 dpi, shrunk to a width of ``most`` EMU where that is above 0."""
    w, h = (F.greatest(c, F.lit(1)).cast("long") * (EMU_PER_INCH // 96) for c in (width, height))
    over = (most > 0) & (w > most)
    return F.struct(F.when(over, most).otherwise(w).cast("long").alias("cx"), F.when(over, F.floor(h * most / w)).otherwise(h).cast("long").alias("cy"))


def title(text: Column) -> Column:
    """A title without blanks around it; null if it says no more than a placeholder."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    low = F.lower(t)
    return F.when(~((t == "") | low.isin(*PLACEHOLDER_TITLES) | low.startswith("microsoft word - ")), t)


def font_family(font: Column) -> Column:
    """The font and the generic family behind it."""
    low = F.lower(font)
    has = lambda words: F.expr("false") if not words else low.rlike("|".join(words))
    generic = F.when(has(MONOSPACE), "monospace").when(has(SERIF) & ~F.contains(low, F.lit("sans")), "serif").otherwise("sans-serif")
    return F.concat_ws(",", font, generic)


def paper(locale: Column) -> Column:
    """letter or a4 for a locale such as en_US.UTF-8; letter if it names no country."""
    plain = F.regexp_extract(locale, "^([^.@]*)", 1)
    country = F.when(F.contains(plain, F.lit("_")), F.upper(F.regexp_extract(plain, "^[^_]*_(.*)$", 1)))
    return F.when(country.isNull() | country.isin(*LETTER_COUNTRIES), "letter").otherwise("a4")


def resolve_path(folder: Column, target: Column) -> Column:
    """A relationship's target as a part name: relative to a folder, with ``.`` and ``..`` taken out."""
    step = lambda parts, s: F.when(s == "..", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).when(s.isin(".", ""), parts).otherwise(F.array_append(parts, s))
    base = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.when(target.startswith("/"), F.substring(target, 2, 2147483647)).otherwise(F.array_join(F.aggregate(F.split(target, "/"), base, step), "/"))


def rels_path(part: Column) -> Column:
    """Where a part's relationships are."""
    return F.regexp_replace(part, r"^(.*?)([^/]*)$", r"$1_rels/$2.rels")


def style_kind(style_id: Column, outline: Column) -> Column:
    """(kind, level) of a paragraph by its style's id, else by its outline level."""
    low = F.lower(F.coalesce(style_id, F.lit("")))
    n = F.coalesce(F.regexp_extract(low, r"^heading\s*(\d{1,3})\s*$", 1).try_cast("int"), F.lit(1))
    lit = lambda kind, level: F.struct(F.lit(kind).alias("kind"), level.cast("int").alias("level"))
    none = F.lit(0)
    return (
        F.when(low == "title", lit("title", none))
        .when(low.startswith("heading"), lit("heading", F.least(F.greatest(n, F.lit(1)), F.lit(6))))
        .when(F.contains(low, F.lit("quote")), lit("quote", none))
        .when(F.contains(low, F.lit("list")), lit("list", none))
        .when(outline.between(0, 8), lit("heading", F.least(outline + 1, F.lit(6))))
        .otherwise(lit("normal", none))
    )


def list_level(num: Column, level: Column) -> Column:
    """A paragraph's level in its list; list 0 is no list."""
    return F.when(num == 0, F.lit(None).cast("int")).when(num.isNotNull(), F.coalesce(level, F.lit(0))).otherwise(level)


def style_id(kind: Column, level: Column) -> Column:
    """The built-in style of a kind; null for normal paragraphs."""
    heading = F.concat(F.lit("Heading"), F.least(level, F.lit(6)).cast("string"))
    return F.when(kind == "title", "Title").when(kind == "heading", heading).when(kind == "list", "ListParagraph").when(kind == "quote", "Quote")


def style_tag(kind: Column, level: Column) -> Column:
    """The editor's name of a kind of paragraph; lists go five levels down."""
    return (
        F.when(kind == "heading", F.concat(F.lit("h"), F.least(F.greatest(level, F.lit(1)), F.lit(6)).cast("string")))
        .when(kind == "list", F.concat(F.lit("list"), F.least(level, F.lit(5)).cast("string")))
        .when(kind.isin("title", "quote"), kind)
        .otherwise("body")
    )


def style_of_tag(tag: Column) -> Column:
    """(kind, level) of an editor's name; null if it is none."""
    number = lambda head: F.regexp_extract(tag, f"^{head}([0-9]{{1,3}})$", 1).try_cast("int")
    lit = lambda kind, level: F.struct(F.lit(kind).alias("kind"), level.cast("int").alias("level"))
    zero = F.lit(0)
    return (
        F.when(tag == "body", lit("normal", zero))
        .when(tag == "title", lit("title", zero))
        .when(tag == "quote", lit("quote", zero))
        .when(number("list").isNotNull(), lit("list", number("list")))
        .when(number("h").isNotNull(), lit("heading", number("h")))
    )


def run_prop(props: Column, name: str) -> Column:
    """The value of a run property in XML; empty for one that is just on, null for none or one that is off."""
    tag = F.regexp_extract(props, rf"<w:{name}((?:\s[^>]*)?)/?>", 1)
    has = props.rlike(rf"<w:{name}(?:\s[^>]*)?/?>")
    value = F.regexp_extract(tag, r'w:val="([^"]*)"', 1)
    on = F.when(tag.rlike(r'w:val="'), F.when(~value.isin("false", "0", "none", "auto"), value)).otherwise("")
    return F.when(has, on)


def run_font(props: Column) -> Column:
    """The font that a run's XML names, for plain or else for other Latin letters."""
    tag = F.regexp_extract(props, r"<w:rFonts([^>]*)>", 1)
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, rf'w:{a}="([^"]*)"', 1), F.lit("")) for a in ("ascii", "hAnsi")])


def high_bytes(samples: Column) -> Column:
    """16-bit samples as 8-bit ones."""
    return F.transform(samples, lambda s: F.shiftright(s, 8))


def on_white(samples: Column, colours: int) -> Column:
    """Pixels of ``colours`` samples and an alpha, laid on white."""
    pixels = F.sequence(F.lit(0), F.floor(F.size(samples) / (colours + 1)).cast("int") - 1)
    at = lambda p, k: F.element_at(samples, p * (colours + 1) + k + 1)
    one = lambda p: F.array(*[F.floor((at(p, k) * at(p, colours) + 255 * (255 - at(p, colours))) / 255).cast("int") for k in range(colours)])
    return F.when(F.size(samples) > colours, F.flatten(F.transform(pixels, one))).otherwise(F.array().cast("array<int>"))


def rgb_of_ycbcr(y: Column, cb: Column, cr: Column) -> Column:
    """(r, g, b) of a sample of luma and two chromas."""
    byte = lambda v: F.least(F.greatest(F.round(v), F.lit(0.0)), F.lit(255.0)).cast("int")
    b, r = cb - 128.0, cr - 128.0
    return F.struct(byte(y + 1.402 * r).alias("r"), byte(y - 0.344136 * b - 0.714136 * r).alias("g"), byte(y + 1.772 * b).alias("b"))


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright((77 * r + 150 * g + 29 * b).cast("int"), 8)


@F.pandas_udf(BinaryType())
def _picture_id(content: pd.Series) -> pd.Series:
    mask = (1 << 64) - 1

    def one(data: bytes | None) -> bytes | None:
        if data is None:
            return None
        both = []
        for h in ID_SEEDS:
            for b in data:
                h = ((h ^ b) * ID_PRIME) & mask
            both.append(h.to_bytes(8, "little"))
        return b"".join(both)

    return content.map(one)


def picture_id(content: Column) -> Column:
    """The 16-byte id of a picture: two 64-bit FNV-1a hashes of its bytes."""
    return _picture_id(content)


def colour(text: Column) -> Column:
    """RRGGBB as a number; null for anything else, such as auto."""
    return F.when(text.rlike("^[0-9A-Fa-f]{6}$"), F.conv(text, 16, 10).cast("int"))


def highlight(name: Column) -> Column:
    """RRGGBB of a named highlight."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in HIGHLIGHTS.items() for x in pair]), name)


def indexed_colour(i: Column) -> Column:
    """RRGGBB of an indexed colour; null for 0, automatic, and beyond the table."""
    return F.when(i.between(1, len(INDEXED)), F.element_at(F.array(*map(F.lit, INDEXED)), i.cast("int")))


def nearest_indexed(r: Column, g: Column, b: Column) -> Column:
    """The indexed colour with the least squared distance, the first of equals."""
    part = lambda i: [int(INDEXED[i][k : k + 2], 16) for k in (0, 2, 4)]
    far = [F.struct(sum(((v - F.lit(w)) * (v - F.lit(w)) for v, w in zip((r, g, b), part(i), strict=True)), F.lit(0)).alias("d"), F.lit(i + 1).alias("i")) for i in range(len(INDEXED))]
    return F.array_min(F.array(*far))["i"]


def toggle(value: Column, off: tuple[str, ...] = ("false", "0", "none")) -> Column:
    """On unless the value says otherwise; no value is on."""
    return F.coalesce(~value.isin(*off), F.lit(True))


def css_length_emu(text: Column) -> Column:
    """A CSS length in English Metric Units; null if it is none."""
    n = F.trim(F.regexp_extract(text, r"^([^A-Za-z]*)(.*)$", 1)).try_cast("double")
    unit = F.regexp_extract(text, r"^([^A-Za-z]*)(.*)$", 2)
    per = F.element_at(F.create_map(*[F.lit(x) for u, v in EMU_BY_UNIT.items() for x in (u, float(v))]), unit)
    return (n * per).cast("long")


def twips(text: Column) -> Column:
    """Twentieths of a point as points."""
    return text.try_cast("double") / 20


def field_kind(instruction: Column) -> Column:
    """page or pages for a field that shows them, by its first word."""
    word = F.upper(F.regexp_extract(instruction, r"(?U)^\s*(\S*)", 1))
    return F.when(word == "PAGE", "page").when(word.isin("NUMPAGES", "SECTIONPAGES"), "pages")


def pdf_date(ts: Column) -> Column:
    """An instant as PDF writes it, in UTC."""
    return F.date_format(ts, "'D:'yyyyMMddHHmmss'Z'")


def shown_kind(subtype: Column) -> Column:
    """An annotation's kind as readers call it."""
    return F.when(subtype == "FreeText", "Text").when(subtype == "Text", "Note").when(subtype == "StrikeOut", "Strike-Out").when(subtype == "Ink", "Drawing").otherwise(subtype)
