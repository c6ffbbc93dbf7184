"""Glyphs to lines, words and text. Characters of a page are one ordered array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G


def dominant_turn(chars: DataFrame, keys: list[str], turn: str) -> DataFrame:
    """(keys, turn): the most common quarter turn, the smallest of equals."""
    votes = chars.groupBy(*keys, F.pmod(F.col(turn), F.lit(4)).alias("turn")).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(*keys).agg(F.max_by("turn", F.struct("n", -F.col("turn"))).alias("turn"))


def lines(boxes: Column) -> Column:
    """Array of (first, end, x0, y0, x1, y1) of the lines of an ordered array of boxes.

    A box is on the last line while more than half of its height is within the line's band and
    it has not gone back left of the line's start.
    """
    kind = "array<struct<first:int,end:int,x0:double,y0:double,x1:double,y1:double>>"

    def step(done: Column, item: Column) -> Column:
        b, i = item["b"], item["i"]
        last = F.try_element_at(done, F.lit(-1))
        height = b["y1"] - b["y0"]
        overlap = F.least(last["y1"], b["y1"]) - F.greatest(last["y0"], b["y0"])
        same = (F.size(done) > 0) & (overlap > height * 0.5) & (b["x0"] > last["x0"] - height * 0.5)
        line = lambda first, x0, y0, x1, y1: F.struct(first.alias("first"), (i + 1).alias("end"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
        grown = line(last["first"], F.least(last["x0"], b["x0"]), F.least(last["y0"], b["y0"]), F.greatest(last["x1"], b["x1"]), F.greatest(last["y1"], b["y1"]))
        new = line(i, b["x0"], b["y0"], b["x1"], b["y1"])
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(new))).cast(kind)

    return F.aggregate(F.transform(boxes, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), F.array().cast(kind), step)


def text(chars: Column, line_array: Column) -> Column:
    """Text of an ordered array of (text, x0, y0, x1, y1) with the spaces and line breaks that gaps imply."""

    def line_text(line: Column) -> Column:
        part = F.slice(chars, line["first"] + 1, line["end"] - line["first"])

        def piece(c: Column, i: Column) -> Column:
            before = F.try_element_at(part, F.greatest(i, F.lit(1)))
            height = F.greatest(c["y1"] - c["y0"], before["y1"] - before["y0"])
            gap = (i > 0) & (c["x0"] - before["x1"] > height * G.GAP_SHARE) & (before["text"] != " ") & (c["text"] != " ")
            return F.concat(F.when(gap, " ").otherwise(""), c["text"])

        return F.rtrim(F.array_join(F.transform(part, piece), ""))

    return F.array_join(F.transform(line_array, line_text), "\n")


def nearest_line(line_array: Column, x: Column, y: Column) -> Column:
    """Index of the line under a point, or of the nearest: by height, then across, then the first."""
    zero = F.lit(0.0)
    far = F.transform(
        line_array, lambda b, i: F.struct(F.greatest(b["y0"] - y, y - b["y1"], zero).alias("dy"), F.greatest(b["x0"] - x, x - b["x1"], zero).alias("dx"), i.alias("i"))
    )
    return F.array_min(far)["i"]


def caret_at(boxes: Column, x: Column) -> Column:
    """Characters of a line whose middle is left of or at x, up to the first that is not."""
    first = F.array_position(F.transform(boxes, lambda b: x < (b["x0"] + b["x1"]) / 2), F.lit(True))
    return F.when(first > 0, first - 1).otherwise(F.size(boxes)).cast("int")


def bounding_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x0, y0, x1, y1) around boxes; zeros for a group without any."""
    side = lambda f, c: F.coalesce(f(c), F.lit(0.0)).alias(c)
    return boxes.groupBy(*keys).agg(side(F.min, "x0"), side(F.min, "y0"), side(F.max, "x1"), side(F.max, "y1"))


def text_width(line: Column, widths: dict[str, int], size: float, other: int = 556) -> Column:
    """Width of a line in a font whose character widths, in thousandths of its size, are given."""
    known = F.create_map(*[F.lit(x) for pair in widths.items() for x in pair]) if widths else None
    one = lambda c: F.coalesce(F.try_element_at(known, c), F.lit(other)) if widths else F.lit(other)
    return F.aggregate(F.transform(F.split(line, ""), one), F.lit(0), lambda a, b: a + b) * size / 1000


def _alphanumeric(c: Column) -> Column:
    return c["text"].rlike(r"[\p{L}\p{N}]")


def _apart(a: Column, b: Column) -> Column:
    """Whether two neighbours on a line have a space between them, drawn or left."""
    height = F.greatest(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return (b["x0"] - a["x1"] > height * G.GAP_SHARE) | (a["text"] == " ") | (b["text"] == " ")


def word_at(chars: Column, line_array: Column, caret: Column) -> Column:
    """(from, to) of the word at a caret: letters and digits without a gap; one character if it is none of them.

    A caret on no line is an empty range.
    """
    on = F.try_element_at(F.filter(line_array, lambda b: (b["first"] <= caret) & (caret < b["end"])), F.lit(1))
    inside = F.when(on.isNotNull(), F.sequence(on["first"], on["end"] - 1))
    char = lambda i: F.try_element_at(chars, i + 1)
    # Places where a word cannot go on from the character before.
    breaks = F.filter(inside, lambda i: (i == on["first"]) | ~_alphanumeric(char(i)) | ~_alphanumeric(char(i - F.when(i > 0, 1).otherwise(0))) | _apart(char(i - F.when(i > 0, 1).otherwise(0)), char(i)))
    start = F.array_max(F.filter(breaks, lambda i: i <= caret))
    end = F.coalesce(F.array_min(F.filter(breaks, lambda i: i > caret)), on["end"])
    word = F.struct(start.alias("from"), end.alias("to"))
    return F.when(on.isNull(), F.struct(caret.alias("from"), caret.alias("to"))).when(_alphanumeric(char(caret)), word).otherwise(F.struct(caret.alias("from"), (caret + 1).alias("to")))


def line_around(line_array: Column, caret: Column) -> Column:
    """(from, to) of the line at a caret, or of the last one if the caret is past the end."""
    on = F.try_element_at(F.filter(line_array, lambda b: (b["first"] <= caret) & (caret < b["end"])), F.lit(1))
    last = F.try_element_at(line_array, F.lit(-1))
    line = F.coalesce(on, F.when(caret >= last["end"], last))
    return F.struct(F.coalesce(line["first"], caret).alias("from"), F.coalesce(line["end"], caret).alias("to"))


def pieces(chars: Column, line_array: Column, start: Column, end: Column) -> Column:
    """Array of (from, to): the part of each line within a range, without blanks at its ends; lines without any go."""
    a, z = F.least(start, end), F.least(F.greatest(start, end), F.size(chars))

    def piece(line: Column) -> Column:
        s, e = F.greatest(line["first"], a), F.least(line["end"], z)
        solid = F.filter(F.when(s < e, F.sequence(s, e - 1)), lambda i: F.trim(F.try_element_at(chars, i + 1)["text"]) != "")
        return F.struct(F.array_min(solid).alias("from"), (F.array_max(solid) + 1).alias("to"))

    return F.filter(F.transform(line_array, piece), lambda p: p["from"].isNotNull())


def tiles_wanted(grid: Column, on_screen: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Array of (col, row) that a page needs besides its backing: those over the viewport if it is tiled and on screen."""
    none = F.array().cast("array<struct<col:int,row:int>>")
    tiled = (grid["cols"] > 1) | (grid["rows"] > 1)
    return F.when(tiled & on_screen, G.tiles_over(grid, x0, x1, y0, y1)).otherwise(none)
