"""Equations of word-processor packages as one line of text, plain and with markup.

An equation's elements are read to flat rows (name, parent, attributes, text). From the last row to the
first, so from the inside out, each element fills the template of its name with what its children became.
"""

from __future__ import annotations

from collections import defaultdict
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions.xml import escape, walk

# Letters and signs that have a form below or above the line.
LOW = dict(zip("0123456789+-−=()aeoxhklmnpstijruv", "₀₁₂₃₄₅₆₇₈₉₊₋₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜᵢⱼᵣᵤᵥ", strict=True))
HIGH = dict(zip("0123456789+-−=()niT", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁻⁼⁽⁾ⁿⁱᵀ", strict=True))
# What an element becomes. Words are children: name, name/look for the first of a name, name*separator for all;
# $property:usual is what a property says or, if it says nothing, the usual sign; anything in quotes stands for itself.
TEMPLATES = {
    "f": "num/group '/' den/group",
    "rad": "deg/high '√' e/group",
    "sSub": "e sub/low",
    "sSup": "e sup/high",
    "sSubSup": "e sub/low sup/high",
    "sPre": "sub/low sup/high e",
    "limLow": "e lim/low",
    "limUpp": "e lim/high",
    "nary": "$chr:∫ sub/low sup/high ' ' e",
    "d": "$begChr:( e*$sepChr:| $endChr:)",
    "func": "fName/upright ' ' e",
    "acc": "e $chr:̂",
    "bar": "e/over",
    "r": "t*/letters",
    "m": "mr*'; '",
    "mr": "e*'  '",
    "eqArr": "e*';  '",
    "oMathPara": "oMath*'    '",
}
Line = tuple[str, str]


def _sub(table: dict[str, str], mark: str, tag: str):
    """A script: signs of their own where all of them have one, else the mark and brackets."""

    def look(line: Line, _: dict) -> Line:
        plain, markup = line
        signs = [table.get(c) for c in plain]
        return ("".join(signs) if None not in signs else f"{mark}({plain})", f"<{tag}>{markup}</{tag}>") if plain else ("", "")

    return look


#: Looks that a template gives to what a child became; the properties are those of the element itself.
LOOKS = {
    "low": _sub(LOW, "_", "sub"),
    "high": _sub(HIGH, "^", "sup"),
    "group": lambda line, _: line if len(line[0]) < 2 else (f"({line[0]})", f"({line[1]})"),
    "upright": lambda line, _: (line[0], line[1].replace("<i>", "").replace("</i>", "")),
    "over": lambda line, _: (line[0], f'<span overline="single">{line[1]}</span>'),
    "letters": lambda line, said: line if "nor" in said or said.get("sty") == "p" else (line[0], "".join(f"<i>{escape(c)}</i>" if c.isalpha() else escape(c) for c in line[0])),
}


def _tokens(template: str) -> list[str]:
    """A template's words; spaces in quotes do not part them."""
    out, quoted = [""], False
    for c in template:
        quoted ^= c == "'"
        if c == " " and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


_PARTS = {name: _tokens(template) for name, template in TEMPLATES.items()}


def _sign(word: str, said: dict) -> str:
    """A quoted sign, or what a property says: nothing said is the usual sign, and so is an operator without one."""
    if word[:1] != "$":
        return word.strip("'")
    name, usual = word[1:].split(":", 1)
    value = said.get(name)
    return usual if value is None or (value == "" and usual == "∫") else value


def _filled(word: str, kids: dict[str, list[Line]], said: dict) -> Line:
    if word[0] in "$'":
        sign = _sign(word, said)
        return sign, escape(sign)
    word, _, look = word.partition("/")
    name, every, between = word.partition("*")
    found = kids[name] if every else kids[name][:1]
    if said.get(f"{name}Hide") in ("1", "on", "true"):
        found = []
    sign = _sign(between, said) if between else ""
    line = sign.join(x[0] for x in found), escape(sign).join(x[1] for x in found)
    return LOOKS[look](line, said) if look else line


def flat(xml: str) -> list[tuple[str, int, dict, str]]:
    """(name, parent, attributes, text) of each element in order; what is left open at an error ends there."""
    rows, open_ = [["", -1, {}, ""]], [0]

    def start(name: str, attrs: dict, _: int) -> None:
        rows.append([name, open_[-1], attrs, ""])
        open_.append(len(rows) - 1)

    def chars(data: str) -> None:
        rows[open_[-1]][3] += data

    try:
        walk(xml.encode(), start, lambda _: open_.pop(), chars)
    except expat.ExpatError:
        pass
    return [tuple(r) for r in rows]


def linear(xml: str) -> Line:
    """(plain, markup) of an equation. Properties are nothing by themselves; elements without a template are what is in them."""
    rows = flat(xml)
    kids: list[list[tuple[str, Line]]] = [[] for _ in rows]
    values: list[dict] = [{} for _ in rows]
    said: list[dict] = [{} for _ in rows]
    line = ("", "")
    for i in range(len(rows) - 1, -1, -1):
        name, parent, attrs, text = rows[i]
        if name == "t":
            line = text, escape(text)
        elif name in _PARTS:
            by_name = defaultdict(list)
            for kid, made in reversed(kids[i]):
                by_name[kid].append(made)
            pieces = [_filled(word, by_name, said[i]) for word in _PARTS[name]]
            line = "".join(p[0] for p in pieces), "".join(p[1] for p in pieces)
        else:
            inner = [] if name.endswith("Pr") else [made for _, made in reversed(kids[i])]
            line = "".join(p[0] for p in inner), "".join(p[1] for p in inner)
        if parent >= 0:
            kids[parent].append((name, line))
            values[parent][name] = attrs.get("val")
            if name == f"{rows[parent][0]}Pr":
                said[parent] = values[i]
    return line


@F.pandas_udf(StructType([StructField("plain", StringType()), StructField("markup", StringType())]))
def _linear(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if x is None else linear(x) for x in xml], columns=["plain", "markup"])


def equation_text(xml: Column) -> Column:
    """(plain, markup) of an equation's XML."""
    return _linear(xml)
