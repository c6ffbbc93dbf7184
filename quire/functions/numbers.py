"""How lists count: number formats, bullets and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of Roman numerals by place.
ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]
# Bullets of symbol fonts, by code point.
BULLETS = {
    "•": [0xF0B7, 0xF0A8, 0xF06C, 0xF09F],
    "▪": [0xF0A7, 0xF06E, 0xF0FA, 0xF0A2],
    "➢": [0xF0D8, 0xF0E0, 0xF0E8],
    "✓": [0xF0FC, 0xF0FE],
    "❖": [0xF076],
    "°": [0xF0B0],
}


def letters(n: Column) -> Column:
    """a to z, then aa to zz, aaa ...; empty for 0."""
    letter = F.char((F.lit(97) + F.pmod(n - 1, F.lit(26))).cast("long"))
    return F.when(n > 0, F.repeat(letter, (F.floor((n - 1) / 26) + 1).cast("int"))).otherwise("")


def roman(n: Column) -> Column:
    """Upper-case Roman numeral; thousands are as many Ms."""
    digit = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.floor(n / at), F.lit(10)) + 1).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(HUNDREDS, 100), digit(TENS, 10), digit(ONES, 1))


def ordinal(n: Column) -> Column:
    last = F.pmod(n, F.lit(10))
    teen = F.pmod(n, F.lit(100)).isin(11, 12, 13)
    ending = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def number(n: Column, fmt: Column) -> Column:
    """A count as a list of format ``fmt`` shows it; formats not known are decimal."""
    n = n.cast("long")
    return (
        F.when(fmt == "lowerLetter", letters(n))
        .when(fmt == "upperLetter", F.upper(letters(n)))
        .when(fmt == "lowerRoman", F.lower(roman(n)))
        .when(fmt == "upperRoman", roman(n))
        .when(fmt == "decimalZero", F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")))
        .when(fmt == "ordinal", ordinal(n))
        .when(fmt.isin("none", "bullet"), "")
        .otherwise(n.cast("string"))
    )


def bullets(text: Column) -> Column:
    """A bullet's characters as ones that any font has."""
    known = {chr(c): b for b, codes in BULLETS.items() for c in codes}
    out = F.translate(text, "".join(known) + "o", "".join(known.values()) + "◦")
    return F.regexp_replace(out, "[-]", "•")


def label(template: Column, fmt: Column, counts: Column, formats: Column) -> Column:
    """A list label: ``%k`` in the template is count k in format k; bullets and ``none`` have no counts.

    ``counts`` and ``formats`` are arrays of nine, level by level.
    """
    first = F.replace(template, F.lit("%0"), F.lit("%1"))
    at = lambda k: number(F.element_at(counts, k), F.element_at(formats, k))
    text = F.aggregate(F.sequence(F.lit(1), F.lit(9)), first, lambda t, k: F.replace(t, F.concat(F.lit("%"), k.cast("string")), at(k)))
    return F.when(fmt == "bullet", bullets(template)).when(fmt == "none", "").otherwise(text)
