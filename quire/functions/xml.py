"""XML of document parts as byte spans, so that what is not changed stays as it was, byte for byte."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from html import escape as _html_escape
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tag, from its first to its last byte; quoted values may hold a closing bracket.
TAG = re.compile(rb"""<[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")


@lru_cache(4096)
def local(name: str) -> str:
    return name.rpartition(":")[2]


def tag_end(content: bytes, at: int, first: int) -> int:
    """The byte after an element that a parser ends at ``at``; ``first`` is where it begins if nothing is in it, else -1."""
    # A tag that closes itself: the parser is then already behind it.
    if first >= 0 and content[at - 2 : at] == b"/>" and (tag := TAG.match(content, first)) and tag.end() == at:
        return at
    return content.find(b">", at) + 1 or at


def parse(parser, content: bytes) -> None:
    """Parse to the end and let go of the handlers: parser and handlers hold each other, and many small files would leave much to collect."""
    try:
        parser.Parse(content, True)
    finally:
        parser.StartElementHandler = parser.EndElementHandler = parser.CharacterDataHandler = None


def walk(content: bytes, start, end, chars=None) -> None:
    """Call ``start(name, attrs, first)``, ``end(end)`` (the byte after the element) and ``chars(data)`` in order; prefixes are taken off."""
    parser = expat.ParserCreate()
    parser.buffer_text = True
    last = [-1]

    def on_start(name: str, attrs: dict) -> None:
        last[0] = first = parser.CurrentByteIndex
        start(local(name), {local(k): v for k, v in attrs.items() if not k.startswith("xmlns")}, first)

    def on_end(_: str) -> None:
        first, last[0] = last[0], -1
        end(tag_end(content, parser.CurrentByteIndex, first))

    parser.StartElementHandler, parser.EndElementHandler = on_start, on_end
    if chars is not None:
        parser.CharacterDataHandler = chars
    parse(parser, content)


def fragment_spans(xml: str) -> tuple[bytes, list[tuple[str, dict, int, int, int]]]:
    """(bytes, elements in order as (name, attrs, first, end, depth)) of a piece of XML, which may have several roots."""
    body = xml.encode()
    whole = b"<_>" + body + b"</_>"
    found: list[list] = []
    open_: list[int] = []

    def start(name: str, attrs: dict, first: int) -> None:
        open_.append(len(found))
        found.append([name, attrs, first - 3, None, len(open_) - 2])

    def end(at: int) -> None:
        found[open_.pop()][3] = at - 3

    walk(whole, start, end)
    return body, [tuple(f) for f in found[1:]]


def splice(content: bytes, edits: Iterable[tuple[int, int, bytes]]) -> bytes:
    """Bytes with the ranges of ``edits`` replaced; ranges in order, not overlapping."""
    out, at = [], 0
    for first, end, new in sorted(edits, key=lambda e: e[:2]):
        if first >= at:
            out += [content[at:first], new]
            at = end
    return b"".join([*out, content[at:]])


def stripped(xml: str, names: Iterable[str]) -> str:
    """XML without elements of some names and all that is in them, also where they nest."""
    wanted = set(names)
    try:
        body, found = fragment_spans(xml)
    except expat.ExpatError:
        return xml
    return splice(body, [(first, end, b"") for name, _, first, end, _ in found if name in wanted]).decode()


def children(xml: str) -> list[tuple[str, str]]:
    """(name, XML) of the outermost elements of a piece of XML."""
    try:
        body, found = fragment_spans(xml)
    except expat.ExpatError:
        return []
    return [(name, body[first:end].decode()) for name, _, first, end, depth in found if depth == 0]


def inner(xml: str, name: str) -> str | None:
    """What is in the first element of a name; null if there is none."""
    try:
        body, found = fragment_spans(xml)
    except expat.ExpatError:
        return None
    for n, _, first, end, _ in found:
        if n == name:
            whole = body[first:end]
            head = TAG.match(whole).end()
            return "" if head == len(whole) else whole[head : whole.rindex(b"</")].decode()
    return None


def attribute(xml: str, name: str) -> str | None:
    """An attribute of the first element, whatever its prefix."""
    try:
        _, found = fragment_spans(xml)
    except expat.ExpatError:
        return None
    return found[0][1].get(name) if found else None


def escape(text: str) -> str:
    return _html_escape(text, quote=False)


def declared(head: str, namespaces: dict[str, str]) -> str:
    """A document's first tags with prefixes declared on the root that it lacks."""
    root = re.search(r"<[A-Za-z_][^>]*?(?=/?>)", head)
    if root is None:
        return head
    lacking = "".join(f' xmlns:{p}="{uri}"' for p, uri in namespaces.items() if f"xmlns:{p}=" not in root.group())
    return head[: root.end()] + lacking + head[root.end() :]


def without_elements(xml: Column, *names: str) -> Column:
    """``stripped`` over a column."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else stripped(v, names))

    return run(xml)


def inner_of(xml: Column, name: str) -> Column:
    """``inner`` over a column."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else inner(v, name))

    return run(xml)


def children_of(xml: Column) -> Column:
    """``children`` over a column: array of (name, xml)."""

    @F.pandas_udf("array<struct<name:string,xml:string>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else [{"name": n, "xml": x} for n, x in children(v)])

    return run(xml)


def children_of_each(xml: Column) -> Column:
    """``children`` of each element of an array of XML."""

    @F.pandas_udf("array<array<struct<name:string,xml:string>>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else [[{"name": n, "xml": x} for n, x in children(each or "")] for each in v])

    return run(xml)
