"""Page geometry: scales, tiles, spreads, boxes, turns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MARGIN = 24
PAGE_GAP = 18
SPREAD_GAP = 6
TILE = 1024
MAX_EDGE = 16_384.0
WHOLE_PAGE_PIXELS = 24_000_000.0
TEXTURE_BUDGET = 384 << 20
MIN_ZOOM, MAX_ZOOM = 0.1, 8.0
TAP_EDGE = 1.0 / 3.0
GAP_SHARE = 0.12
SCAN_SHARE = 0.3


def fit_scale(width: Column, height: Column, pixels: Column) -> Column:
    """The largest scale at which a page fits into so many pixels and an edge limit."""
    w, h = F.greatest(width, F.lit(1.0)), F.greatest(height, F.lit(1.0))
    return F.greatest(F.least(F.sqrt(pixels / (w * h)), MAX_EDGE / w, MAX_EDGE / h), F.lit(0.001))


def grid(width: Column, height: Column, scale: Column) -> Column:
    """(width, height, cols, rows, tile_w, tile_h) of a page in pixels; one tile while it fits."""
    s = F.greatest(scale, F.lit(0.001))
    px = lambda v: F.greatest(F.floor(F.greatest(v, F.lit(1.0)) * s), F.lit(1)).cast("long")
    w, h = px(width), px(height)
    fits = (w.cast("double") * h <= WHOLE_PAGE_PIXELS) & (w <= MAX_EDGE) & (h <= MAX_EDGE)
    count = lambda v: F.when(fits, F.lit(1)).otherwise(F.ceil(v / TILE)).cast("int")
    side = lambda v: F.when(fits, v).otherwise(F.lit(TILE))
    return F.struct(w.alias("width"), h.alias("height"), count(w).alias("cols"), count(h).alias("rows"), side(w).alias("tile_w"), side(h).alias("tile_h"))


def tile_rect(g: Column, col: Column, row: Column) -> Column:
    """(x, y, width, height) of a tile; the last of a line is what is left."""
    x, y = F.least(col, g["cols"] - 1) * g["tile_w"], F.least(row, g["rows"] - 1) * g["tile_h"]
    return F.struct(x.alias("x"), y.alias("y"), F.least(g["tile_w"], g["width"] - x).alias("width"), F.least(g["tile_h"], g["height"] - y).alias("height"))


def tile_span(start: Column, end: Column, extent: Column, tile: Column, count: Column) -> Column:
    """First and last tile over a stretch given as fractions of a page."""
    at = lambda f: F.least(F.floor(F.floor(F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0)) * extent) / tile), count - 1).cast("int")
    return F.struct(at(F.least(start, end)).alias("first"), at(F.greatest(start, end)).alias("last"))


def tiles_over(g: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Array of (col, row) that cover a viewport, row by row."""
    c, r = tile_span(x0, x1, g["width"], g["tile_w"], g["cols"]), tile_span(y0, y1, g["height"], g["tile_h"], g["rows"])
    return F.flatten(F.transform(F.sequence(r["first"], r["last"]), lambda row: F.transform(F.sequence(c["first"], c["last"]), lambda col: F.struct(col.alias("col"), row.alias("row")))))


def spread_of(per: int, cover: bool, page: Column, pages: Column) -> Column:
    """[start, end) of the pages shown with a page; the cover may stand alone."""
    p = F.least(page, F.greatest(pages - 1, F.lit(0)))
    first = int(cover and per > 1)
    start = F.lit(first) + (F.floor((p - first) / per) * per).cast("int")
    alone = p < first
    return F.struct(F.when(alone, F.lit(0)).otherwise(start).cast("int").alias("start"), F.when(alone, F.least(F.lit(1), pages)).otherwise(F.least(start + per, pages)).cast("int").alias("end"))


def tap_turn(x: Column, width: Column) -> Column:
    """previous or next for a tap in the outer thirds; else null."""
    inside = (width > 0) & x.between(F.lit(0.0), width)
    return F.when(inside & (x < width * TAP_EDGE), "previous").when(inside & (x > width * (1 - TAP_EDGE)), "next")


def turned(angle: Column, by: Column) -> Column:
    """A page's rotation after a turn, from 0 to 359."""
    return F.pmod(angle + by, F.lit(360))


def flow_point(turn: Column, x: Column, y: Column) -> Column:
    """A point in the frame where text of so many quarter turns runs from left to right."""
    t = F.pmod(turn, F.lit(4))
    return F.struct(F.when(t == 0, x).when(t == 1, y).when(t == 2, 1.0 - x).otherwise(1.0 - y).alias("x"), F.when(t == 0, y).when(t == 1, 1.0 - x).when(t == 2, 1.0 - y).otherwise(x).alias("y"))


def flow_box(turn: Column, box: Column) -> Column:
    """A box (x0, y0, x1, y1) in the flow frame."""
    a, b = flow_point(turn, box["x0"], box["y0"]), flow_point(turn, box["x1"], box["y1"])
    return F.struct(F.least(a["x"], b["x"]).alias("x0"), F.least(a["y"], b["y"]).alias("y0"), F.greatest(a["x"], b["x"]).alias("x1"), F.greatest(a["y"], b["y"]).alias("y1"))


def user_point(m: Column, fx: Column, fy: Column) -> Column:
    """Fractions of a displayed page in user space, by an affine map of six numbers."""
    at = lambda k: F.element_at(m, k + 1)
    return F.struct((at(0) * fx + at(2) * fy + at(4)).alias("x"), (at(1) * fx + at(3) * fy + at(5)).alias("y"))


def in_box(x: Column, y: Column, box: Column) -> Column:
    """Whether a point lies in a box, its edges included."""
    return x.between(box["x0"], box["x1"]) & y.between(box["y0"], box["y1"])


def y_fraction(height: Column, top: Column) -> Column:
    """How far down a page something is, from 0 to 1."""
    return F.least(F.greatest((height - top) / height, F.lit(0.0)), F.lit(1.0))


def is_scan(has_text: Column, picture_area: Column, page_area: Column) -> Column:
    """A page without text whose pictures cover enough of it."""
    return ~has_text & (picture_area >= SCAN_SHARE * page_area)


def aligned(align: Column, x: Column, left: Column, right: Column, width: Column, w: Column) -> Column:
    """Where something of width ``w`` goes across a box, within its paragraph's indents."""
    room = F.greatest(width - left - right, w)
    return x + left + F.when(align == "center", (room - w) / 2).when(align == "end", room - w).otherwise(0.0)


def picture_fit(w: Column, h: Column, width: Column, height: Column) -> Column:
    """A picture's size shrunk to a box, never enlarged."""
    k = F.least(F.lit(1.0), width / w, height / h)
    return F.struct((w * k).alias("width"), (h * k).alias("height"))


def fit_zoom(width: Column, widest: Column) -> Column:
    """The zoom at which the widest page fits across a viewport, between MIN_ZOOM and MAX_ZOOM; 1 where there is no room."""
    room = width - 2.0 * MARGIN
    return F.when(room <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(room / F.greatest(widest, F.lit(1.0)), F.lit(MIN_ZOOM)), F.lit(MAX_ZOOM)))


def fit_spread(width: Column, height: Column, sizes: Column, across: Column) -> Column:
    """The zoom at which the pages on show (width, height) fit; places without a page count as one like the last."""
    last = F.element_at(sizes, -1)["width"]
    total = F.aggregate(sizes, F.lit(0.0), lambda t, s: t + s["width"]) + (across - F.size(sizes)) * last
    tallest = F.aggregate(sizes, F.lit(1.0), lambda t, s: F.greatest(t, s["height"]))
    w, h = width - 2.0 * MARGIN - (across - 1) * float(SPREAD_GAP), height - 2.0 * MARGIN
    zoom = F.least(w / F.greatest(total, F.lit(1.0)), h / tallest)
    return F.when((F.size(sizes) == 0) | (w <= 0) | (h <= 0), F.lit(1.0)).otherwise(F.least(F.greatest(zoom, F.lit(MIN_ZOOM)), F.lit(MAX_ZOOM)))


def row_height(content: Column, asked: Column, exact: Column) -> Column:
    """A table row's height: as asked if exact, at least as asked, else as its content, 12 points at least."""
    return F.when(exact & asked.isNotNull(), asked).otherwise(F.greatest(content, F.coalesce(asked, F.lit(12.0))))


def line_height(natural: Column, rule: Column, value: Column) -> Column:
    """A line's height by a spacing rule: auto (a multiple, a half at least), exact, or at least."""
    return F.when(rule == "exact", value).when(rule == "atLeast", F.greatest(value, natural)).otherwise(natural * F.greatest(value, F.lit(0.5)))
