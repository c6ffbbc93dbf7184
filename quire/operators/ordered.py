"""Operators whose result depends on order: offsets, counters, runs, outlines.

Each works within one document (``keys``): windows are partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import numbers

LEVELS = 9
#: Levels of an outline that count.
OUTLINE_DEPTH = 32


def _upto(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def page_offsets(pages: DataFrame, keys: list[str], page: str, height: str, zoom: float) -> DataFrame:
    """Adds top: where each page begins when pages stand below each other with a gap."""
    w = Window.partitionBy(*keys).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("top", F.lit(float(G.MARGIN)) + F.coalesce(F.sum(F.round(F.col(height) * zoom) + G.PAGE_GAP).over(w), F.lit(0.0)))


def page_at(offsets: DataFrame, lookups: DataFrame, keys: list[str], page: str, y: str) -> DataFrame:
    """Adds to each lookup the page that covers y, or the one above a gap; ends are clamped.

    An as-of lookup: tops and lookups are put in one order and each lookup takes the last page
    before it, so neither side is joined by a range.
    """
    own = [c for c in lookups.columns if c not in keys]
    tops = offsets.select(*keys, F.col("top").alias("_at"), F.lit(0).alias("_kind"), F.col(page).alias("_page"), F.lit(None).alias("_row"))
    asked = lookups.select(*keys, F.col(y).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).alias("_page"), F.struct(*own).alias("_row"))
    both = tops.unionByName(asked)
    found = F.last("_page", ignorenulls=True).over(_upto(keys, "_at", "_kind", F.col("_page")))
    lowest = F.min("_page").over(Window.partitionBy(*keys))
    return both.withColumn("page", F.coalesce(found, lowest)).where("_kind = 1").select(*keys, "_row.*", "page")


def list_labels(items: DataFrame, levels: DataFrame, keys: list[str], pos: str, level_keys: list[str] | None = None) -> DataFrame:
    """Adds label to list paragraphs (num, level): hierarchical counts of their list.

    ``levels`` has (num, level, format, template, start), and ``level_keys`` where documents have
    lists of their own. A level's count starts anew when a
    shallower item of its list comes; a level that was not seen counts as start - 1. List 0 and
    unknown lists have no label.
    """
    by = [*(level_keys or []), "num"]
    defs = levels.groupBy(*by).agg(
        *[F.max(F.when(F.col("level") == k, F.struct("format", "template", "start"))).alias(f"_d{k}") for k in range(LEVELS)]
    )
    level = F.least(F.coalesce(F.col("level"), F.lit(0)), F.lit(LEVELS - 1))
    known = items.withColumn("_level", level).join(defs.where("num <> 0"), by, "left")
    part = [*keys, "num"]
    resets = known.withColumns({f"_g{k}": F.sum((F.col("_level") < k).cast("int")).over(_upto(part, pos)) for k in range(LEVELS)})
    counted = resets.withColumns(
        {f"_c{k}": F.greatest(F.col(f"_d{k}.start") - 1, F.lit(0)) + F.sum((F.col("_level") == k).cast("int")).over(_upto([*part, f"_g{k}"], pos)) for k in range(LEVELS)}
    )
    counts = F.array(*[F.coalesce(F.col(f"_c{k}"), F.lit(0)) for k in range(LEVELS)])
    formats = F.array(*[F.coalesce(F.col(f"_d{k}.format"), F.lit("decimal")) for k in range(LEVELS)])
    mine = F.element_at(F.array(*[F.col(f"_d{k}") for k in range(LEVELS)]), F.col("_level") + 1)
    text = numbers.label(mine["template"], mine["format"], counts, formats)
    return counted.withColumn("label", F.when(text != "", text)).drop("_level", *[f"_{a}{k}" for a in "dgc" for k in range(LEVELS)])


def note_numbers(refs: DataFrame, keys: list[str], pos: str, foot: Column, custom: Column | None = None) -> DataFrame:
    """Adds mark: footnotes counted 1, 2, ... and endnotes i, ii, ... in order of their references; custom marks are empty and not counted."""
    own = F.coalesce(custom, F.lit(False)) if custom is not None else F.lit(False)
    n = F.row_number().over(Window.partitionBy(*keys, "_foot", "_own").orderBy(pos))
    mark = F.when(F.col("_own"), "").otherwise(numbers.number(n, F.when(F.col("_foot"), "decimal").otherwise("lowerRoman")))
    return refs.withColumns({"_foot": foot, "_own": own}).withColumn("mark", mark).drop("_foot", "_own")


def contextual_spacing(paragraphs: DataFrame, keys: list[str], pos: str, style: str, before: str, contextual: str) -> DataFrame:
    """Adds space_before: none between paragraphs of one style that ask for it."""
    last = F.lag(style).over(Window.partitionBy(*keys).orderBy(pos))
    return paragraphs.withColumn("space_before", F.when(F.col(contextual) & last.eqNullSafe(F.col(style)) & F.col(style).isNotNull(), F.lit(0.0)).otherwise(F.col(before)))


def coalesce_runs(runs: DataFrame, keys: list[str], pos: str, fmt: str, text: str, sep: str = "") -> DataFrame:
    """(keys, run, format, text): neighbours of one format merged; empty runs go first."""
    full = runs.where(F.length(text) > 0)
    w = Window.partitionBy(*keys).orderBy(pos)
    new = F.when(F.lag(fmt).over(w).eqNullSafe(F.col(fmt)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = full.withColumn("_new", new).withColumn("run", F.sum("_new").over(_upto(keys, pos)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda r: r[text]), sep)
    return numbered.groupBy(*keys, "run", F.col(fmt).alias("format")).agg(joined.alias("text"))


def undo_groups(ops: DataFrame, keys: list[str], seq: str, at: str, typed: str, keep: int = 500) -> DataFrame:
    """Adds step: typing that goes on where the last character was, within a word, is one step; the latest ``keep`` steps stay."""
    w = Window.partitionBy(*keys).orderBy(seq)
    follows = (F.lag(at).over(w) + 1 == F.col(at)) & F.lag(typed).over(w).isNotNull() & F.col(typed).isNotNull() & ~F.col(typed).rlike(r"(?U)\s")
    stepped = ops.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("step", F.sum("_new").over(_upto(keys, seq)))
    last = F.max("step").over(Window.partitionBy(*keys))
    return stepped.withColumn("_last", last).where(F.col("step") > F.col("_last") - keep).drop("_new", "_last")


def heading_parents(headings: DataFrame, keys: list[str], pos: str, level: str, deepest: int = 6) -> DataFrame:
    """Adds parent: the nearest earlier heading of a smaller level, or null."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.max(F.when(F.col(level) == k, F.col(pos))).over(w) for k in range(1, deepest)]
    return headings.withColumn("parent", F.greatest(F.lit(None).cast("long"), *[F.when(F.col(level) > k + 1, v) for k, v in enumerate(latest)]))


def outline_pages(outline: DataFrame, keys: list[str], pos: str, level: str, page: str) -> DataFrame:
    """Entries in order, page-less ones with the page of the first entry below them that has one; those without any go.

    An entry's part of the outline ends before the next entry of its level or a higher one.
    Entries OUTLINE_DEPTH or more below the top go first.
    """
    kept = outline.where(F.col(level) - F.lit(1) < OUTLINE_DEPTH)
    after = Window.partitionBy(*keys).orderBy(pos).rowsBetween(1, Window.unboundedFollowing)
    next_page = F.first(F.when(F.col(page).isNotNull(), F.struct(F.col(pos).alias("pos"), F.col(page).alias("page"))), ignorenulls=True).over(after)
    known = kept.withColumn("_next", next_page)
    nearer = known.withColumns({f"_e{k}": F.first(F.when(F.col(level) <= k, F.col(pos)), ignorenulls=True).over(after) for k in range(1, OUTLINE_DEPTH + 1)})
    end = F.element_at(F.array(*[F.col(f"_e{k}") for k in range(1, OUTLINE_DEPTH + 1)]), F.col(level).cast("int"))
    own = F.coalesce(F.col(page), F.when(end.isNull() | (F.col("_next.pos") < end), F.col("_next.page")))
    return nearer.withColumn(page, own).where(F.col(page).isNotNull()).select(outline.columns)


def line_tops(lines: DataFrame, keys: list[str], pos: str, natural: str, rule: str, value: str) -> DataFrame:
    """Adds height and top of the lines of a paragraph (keys), by its spacing rule."""
    tall = lines.withColumn("height", G.line_height(F.col(natural), F.col(rule), F.col(value)))
    before = F.sum("height").over(Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    return tall.withColumn("top", F.coalesce(before, F.lit(0.0)))


def evict(held: DataFrame, keys: list[str], page: str, size: str, first: str, last: str, ahead: int, budget: int = G.TEXTURE_BUDGET) -> DataFrame:
    """Pages that stay: those near the screen, furthest ones dropped while the sum is over the budget.

    Pages on screen stay. Equally far pages go in order of their number.
    """
    near = held.where(F.col(page).between(F.greatest(F.col(first) - ahead, F.lit(0)), F.col(last) + ahead))
    shown = F.col(page).between(F.col(first), F.col(last))
    far = F.abs(F.col(page) - F.floor((F.col(first) + F.col(last)) / 2))
    total = F.sum(size).over(Window.partitionBy(*keys))
    gone = F.sum(F.when(F.col("_shown"), 0).otherwise(F.col(size))).over(Window.partitionBy(*keys).orderBy(F.desc("_far"), page).rowsBetween(Window.unboundedPreceding, -1))
    ranked = near.withColumn("_shown", shown).withColumn("_far", far).withColumn("_over", total - F.coalesce(gone, F.lit(0)) > budget)
    return ranked.where(F.col("_shown") | ~F.col("_over")).drop("_shown", "_far", "_over")


def place_row(items: DataFrame, keys: list[str], pos: str, width: str, height: str, gap: float = G.SPREAD_GAP) -> DataFrame:
    """Adds x and y of items side by side, centred on the tallest."""
    before = F.sum(F.col(width) + gap).over(Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    tallest = F.max(height).over(Window.partitionBy(*keys))
    return items.withColumns({"x": F.coalesce(before, F.lit(0.0)), "y": (tallest - F.col(height)) / 2})


def columns(widths: DataFrame, keys: list[str], pos: str, width: str, avail: float) -> DataFrame:
    """Adds x and column_width: the grid's shares of its own total, which is no wider than there is room for."""
    grid = F.sum(width).over(Window.partitionBy(*keys))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    total = F.greatest(F.least(F.when(grid > 1.0, grid).otherwise(F.lit(avail)), F.lit(avail)), F.lit(12.0))
    own = widths.withColumn("column_width", F.when(grid > 1.0, F.col(width) * total / grid).otherwise(total / n))
    before = F.sum("column_width").over(Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn("x", F.coalesce(before, F.lit(0.0)))


def draw_order(pages: DataFrame, keys: list[str], page: str, current: str, first: str, last: str, ahead: int) -> DataFrame:
    """Adds turn: the page being read, the rest of the screen, then outwards by turns after and before."""
    p, f, z = F.col(page), F.col(first), F.col(last)
    step = F.greatest(p - z, f - p)
    kind = F.when(p == F.col(current), 0).when(p.between(f, z), 1).otherwise(2)
    wanted = pages.withColumn("_kind", kind).withColumn("_step", F.when(F.col("_kind") == 2, step).otherwise(F.lit(0))).where((F.col("_kind") < 2) | (F.col("_step") <= ahead))
    order = Window.partitionBy(*keys).orderBy("_kind", "_step", F.when(p > z, 0).otherwise(1), page)
    return wanted.withColumn("turn", F.row_number().over(order)).drop("_kind", "_step")


def inherit_section(sections: DataFrame, keys: list[str], pos: str, columns_: list[str]) -> DataFrame:
    """Headers and footers that a section does not have are those of the section before it."""
    return sections.withColumns({c: F.last(c, ignorenulls=True).over(_upto(keys, pos)) for c in columns_})


def owner_of_hidden(items: DataFrame, keys: list[str], pos: str, visible: Column) -> DataFrame:
    """Adds owner: the next visible item, for items that are not; null after the last."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
    return items.withColumn("owner", F.first(F.when(visible, F.col(pos)), ignorenulls=True).over(w))
