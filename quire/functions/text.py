"""Text functions: tolerant comparison, matches and their places, decoding."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
PLAIN = {"‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "–": "-", "—": "-"}
#: Characters that are several when normalised, and which letters those have.
LONGER, LONGER_LETTERS = "".join(LIGATURES) + "İ", frozenset("".join(LIGATURES.values()) + "i")
# A class of them; ranges are told faster than single characters.
_LONGER = r"[\x{fb00}-\x{fb06}\x{130}]"
#: What Windows-1252 has at 0x80 to 0x9F.
CP1252_HIGH = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
#: White space and the soft hyphen.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\xad"
#: What PDF's own encoding has where Latin-1 has control characters.
PDF_DOC = dict(zip([*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0], "˘ˇˆ˙˝˛˚˜•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž€", strict=True))
WIN_ANSI = {"€": 0x80, "…": 0x85, "‘": 0x91, "’": 0x92, "“": 0x93, "”": 0x94, "•": 0x95, "–": 0x96, "—": 0x97}


def normalize(text: Column) -> Column:
    """Text as search compares it: no white space or soft hyphens, ligatures spelt out, plain quotes and dashes, lower case.

    Lower case is taken character by character, so a final sigma is an ordinary one.
    """
    out = F.regexp_replace(text, "(?U)[\\s­]", "")
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    out = F.translate(out, "".join(PLAIN) + "Σ", "".join(PLAIN.values()) + "σ")
    return F.lower(out)


def count_matches(text: Column, query: Column) -> Column:
    """Occurrences of ``query`` in ``text``, both compared normalised, that do not overlap; an empty query matches nothing."""
    return count_in_normalized(normalize(text), normalize(query))


def count_in_normalized(t: Column, q: Column) -> Column:
    """``count_matches`` of texts that are normalised already, for several queries over one text."""
    return F.when(F.length(q) > 0, (F.length(t) - F.length(F.replace(t, q, F.lit("")))) / F.length(q)).otherwise(0).cast("int")


def holds(text: Column, query: str) -> Column:
    """Whether a text holds ``query``, both compared normalised; none holds an empty query.

    One pattern goes over the text as it is; only what has ligatures is normalised.
    """
    q = normalize_literal(query)
    if not q:
        return F.lit(False)
    whole = F.contains(normalize(text), F.lit(q))
    if (pattern := _tolerant(q)) is None:
        return whole
    if not set(q) & LONGER_LETTERS:
        return text.rlike(pattern)
    return text.rlike(f"{pattern}|{_LONGER}") & (~text.rlike(_LONGER) | whole)


def match_ranges(text: Column, query: str) -> Column:
    """Array of (from, to) character ranges of ``text`` that match, in order; what is hit within a ligature is all of it."""
    q = normalize_literal(query)
    if not q:
        return F.array().cast("array<struct<from:int,to:int>>")
    if (pattern := _tolerant(q)) is None:
        return _owned_ranges(text, q)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # What follows the last hit has none beside it.
    pairs = F.filter(F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n"))), lambda x: x["n"].isNotNull())
    none = F.array().cast("array<struct<from:int,to:int>>")
    step = lambda s, x: F.struct((s["end"] + x["gap"] + x["n"]).alias("end"), F.array_append(s["at"], F.struct((s["end"] + x["gap"]).alias("from"), (s["end"] + x["gap"] + x["n"]).alias("to"))).alias("at"))
    ranges = F.aggregate(pairs, F.struct(F.lit(0).alias("end"), none.alias("at")), step, lambda s: s["at"])
    if not set(q) & LONGER_LETTERS:
        return ranges
    return F.when(text.rlike(_LONGER), _owned_ranges(text, q)).otherwise(ranges)


def _tolerant(q: str) -> str | None:
    """A pattern of what normalises to ``q`` in text without LONGER; None of queries beyond Latin Extended-A, where versions of Unicode differ."""
    if max(q) >= "\u0180":
        return None
    one_of = lambda chars: "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"
    return f"{one_of(BLANKS)}*+".join(one_of(_raw().get(c, c)) for c in q)


@cache
def _raw() -> dict[str, list[str]]:
    """By normalised character the others that become it."""
    found: dict[str, list[str]] = {}
    for c in map(chr, range(0x2200)):
        if c not in BLANKS and c not in LONGER:
            found.setdefault(PLAIN.get(c, c.lower()), []).append(c)
    return found


def _owned_ranges(text: Column, q: str) -> Column:
    """The ranges that match a normalised query, by the character that owns each normalised one."""
    length = lambda c: F.when(F.instr(F.lit(BLANKS), c) > 0, 0).when(F.instr(F.lit("ﬀﬁﬂﬅﬆİ"), c) > 0, 2).when(F.instr(F.lit("ﬃﬄ"), c) > 0, 3).otherwise(1)
    owner = F.flatten(F.transform(F.split(text, ""), lambda c, i: F.array_repeat(i, length(c))))
    pieces = F.transform(F.split(normalize(text), _quoted(q), -1), lambda p: F.length(p))
    at = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at")),
        lambda s, n: F.struct((s["end"] + n + len(q)).alias("end"), F.array_append(s["at"], s["end"] + n).alias("at")),
        lambda s: s["at"],
    )
    # One struct holds the owners, so that they are not made again for each match.
    held = F.array(F.struct(owner.alias("owner"), at.alias("at")))
    ranges = lambda h: F.transform(h["at"], lambda a: F.struct(F.element_at(h["owner"], a + 1).alias("from"), (F.element_at(h["owner"], a + len(q)) + 1).alias("to")))
    return F.element_at(F.transform(held, ranges), 1)


def _quoted(q: str) -> str:
    return re.sub(r"([^0-9A-Za-z\u0080-\U0010ffff])", r"\\\1", q)


def normalize_literal(text: str) -> str:
    """``normalize`` of a constant."""
    out = "".join(LIGATURES.get(c, PLAIN.get(c, c)) for c in text if not (c.isspace() and c not in "\x1c\x1d\x1e\x1f") and c != "­")
    return "".join(c.lower() for c in out)


def decode_text(content: Column) -> Column:
    """A text file's bytes as text: by byte order mark UTF-8 or UTF-16, else UTF-8 if valid, else Windows-1252."""
    two, three = F.hex(F.substring(content, 1, 2)), F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, n + 1, 2147483647)
    even = lambda c: F.substring(c, F.lit(1), (F.floor(F.octet_length(c) / 2) * 2).cast("int"))
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), CP1252_HIGH)
    return (
        F.when(three == "EFBBBF", F.make_valid_utf8(rest(3).cast("string")))
        .when(two == "FFFE", F.decode(even(rest(2)), "UTF-16LE"))
        .when(two == "FEFF", F.decode(even(rest(2)), "UTF-16BE"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(latin)
    )


def win_ansi(text: Column) -> Column:
    """Bytes (as hex) of a line in the encoding of a standard font; what it lacks is a question mark."""
    code = lambda c: F.when(F.ascii(c).between(0x20, 0x7E) | F.ascii(c).between(0xA0, 0xFF), F.ascii(c))
    special = lambda c: F.element_at(F.create_map(*[F.lit(x) for pair in WIN_ANSI.items() for x in pair]), c)
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.lpad(F.hex(F.coalesce(code(c), special(c), F.lit(0x3F))), 2, "0")), "")


def one_line(text: Column) -> Column:
    """Runs of white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_set(text: Column) -> Column:
    """Lower-case words of more than two bytes, split at what is no letter or digit."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: F.octet_length(w) > 2)


def utf16_units(text: Column) -> Column:
    """Text as a Word 97 stream holds it: line breaks as 0x0B, tabs kept, other controls and object marks left out."""
    kept = F.regexp_replace(F.translate(text, "\n ", "\x0b\x0b"), "[\x00-\x08\x0c-\x1f￼]", "")
    return F.encode(kept, "UTF-16LE")


def pdf_string(value: Column) -> Column:
    """A PDF literal string in the encoding of a standard font: brackets and backslashes escaped, what is not ASCII in octal."""
    codes = F.transform(F.regexp_extract_all(win_ansi(value), F.lit("(..)"), 1), lambda h: F.conv(h, 16, 10).cast("int"))
    escape = lambda c: F.when(c.isin(*map(ord, "()\\")), F.concat(F.lit("\\"), F.char(c.cast("long"))))
    octal = lambda c: F.concat(F.lit("\\"), F.lpad(F.conv(c.cast("string"), 10, 8), 3, "0"))
    shown = F.transform(codes, lambda c: F.coalesce(escape(c), F.when(c.between(32, 126), F.char(c.cast("long"))), octal(c)))
    return F.concat(F.lit("("), F.array_join(shown, ""), F.lit(")"))


def pdf_text(content: Column) -> Column:
    """A PDF text string's bytes as one line: UTF-16 by its mark, else the format's own encoding."""
    even = lambda c: F.substring(c, F.lit(1), (F.floor(F.octet_length(c) / 2) * 2).cast("int"))
    own = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, PDF_DOC)), "".join(PDF_DOC.values()))
    text = F.when(F.hex(F.substring(content, 1, 2)) == "FEFF", F.decode(even(F.substring(content, 3, 2147483647)), "UTF-16BE")).otherwise(own)
    return one_line(F.regexp_replace(text, "^\ufeff+", ""))
