"""Combining, comparing and editing documents as sets of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def combine(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Rows of several files with file_no (from 0): their order is (file_no, *order)."""
    if len(parts) < 2:
        raise ValueError("combining takes two files at least")
    out = parts[0].withColumn("file_no", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("file_no", F.lit(k)))
    return out


def combined_format(formats: DataFrame, fmt: str) -> DataFrame:
    """pdf if any file is one, else docx."""
    return formats.agg(F.when(F.bool_or(F.col(fmt) == "pdf"), "pdf").otherwise("docx").alias("format"))


def rebase_ids(rows: DataFrame, file: str, ident: str, keys: list[str] | None = None) -> DataFrame:
    """Adds new_id: ids of each file moved behind the largest ids of the files before it.

    Bases come from one row a file; only those are put in one order, within ``keys``.
    """
    keys = keys or []
    tops = rows.groupBy(*keys, file).agg(F.max(ident).alias("_top"))
    w = Window.partitionBy(*keys).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    bases = tops.withColumn("_base", F.coalesce(F.sum(F.col("_top") + 1).over(w), F.lit(0))).drop("_top")
    return rows.join(bases, [*keys, file]).withColumn("new_id", F.col(ident) + F.col("_base")).drop("_base")


def first_wins(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The base and what it lacks of the other."""
    return base.unionByName(other.join(base, key, "left_anti"))


def fingerprints(files: DataFrame, ident: str, content: Column) -> DataFrame:
    """(id, fingerprint, read_at): each file and the first file of equal content, which is the one to read."""
    marked = files.select(F.col(ident), F.md5(content.cast("binary")).alias("fingerprint"))
    first = marked.groupBy("fingerprint").agg(F.min(ident).alias("read_at"))
    return marked.join(first, "fingerprint", "left").select(ident, "fingerprint", F.coalesce("read_at", F.col(ident)).alias("read_at"))


def save_diff(old: DataFrame, new: DataFrame, keys: list[str], pos: str, text: str) -> DataFrame:
    """(keys, pos, action): keep, para (rewritten), block (inserted) or gone, by a paragraph's origin."""
    a, b = old.select(*keys, F.col(pos).alias("pos"), F.col(text).alias("_old")), new.select(*keys, F.col(pos).alias("pos"), F.col(text).alias("_new"))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), [*keys, "pos"], "full")
    action = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "block").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("para")
    return both.select(*keys, "pos", action.alias("action"))


def editor_lines(lines: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, action, item): what each line of an editor (origins, locked_item, kind, level, look) is saved as, from a document's paragraphs (item, kind, level, look).

    Origins are the items that left their mark on a line; ``look`` compares runs. A locked item is kept
    once, however many lines it takes. A line like one of its origins keeps it. A line that is not, above
    an unmarked line that is like its last origin, came of Enter at a paragraph's start: it is new, and
    the next line keeps that item. Other lines are made anew (para) from their last origin; a list item
    without one carries on from the list item before it.
    """
    w = Window.partitionBy(*keys).orderBy("line")
    kind = lambda p="": F.struct(*[F.col(p + c) for c in ("kind", "level", "look")])
    known = items.select(*keys, "item", kind().alias("_like"))
    marks = lines.select(*keys, "line", kind().alias("_own"), F.posexplode("origins").alias("_at", "item")).join(known, [*keys, "item"])
    same = F.min_by("item", F.when(F.col("_like").eqNullSafe(F.col("_own")), F.col("_at")))
    of_line = marks.groupBy(*keys, "line").agg(same.alias("_same"), F.max_by(F.struct("item", "_like"), "_at").alias("_last"))
    free = F.col("locked_item").isNull()
    known_lines = lines.withColumn("_own", kind()).join(of_line, [*keys, "line"], "left")
    unmarked = F.coalesce(F.size("origins"), F.lit(0)) <= 0
    enters = free & F.col("_same").isNull() & F.col("_last").isNotNull() & F.lead(unmarked & free).over(w) & F.lead("_own").over(w).eqNullSafe(F.col("_last._like"))
    entered = known_lines.withColumn("_enters", F.coalesce(enters, F.lit(False)))
    claimed = entered.withColumn("_claimed", F.when(F.lag("_enters").over(w), F.lag("_last.item").over(w)))
    own = F.when(~F.col("_enters"), F.coalesce("_claimed", "_same", "_last.item"))
    in_list = F.coalesce(F.col("kind") == "list", F.lit(False)) & free
    run = F.sum(F.when(in_list | F.col("_enters"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = claimed.withColumns({"_base": own, "_run": run, "_list": in_list})
    carried = F.last(F.when(F.col("_list"), F.col("_base")), ignorenulls=True).over(Window.partitionBy(*keys, "_run").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    again = F.coalesce(F.lag("locked_item").over(w) == F.col("locked_item"), F.lit(False))
    decided = runs.withColumns({"_carried": carried, "_again": again}).where(free | ~F.col("_again"))
    kept = F.coalesce("locked_item", "_claimed", F.when(~F.col("_enters"), F.col("_same")))
    base = F.when(~F.col("_enters"), F.coalesce("_base", F.when(F.col("_list"), F.col("_carried"))))
    return decided.select(*keys, "line", F.when(kept.isNotNull(), "keep").otherwise("para").alias("action"), F.coalesce(kept, base).alias("item"))


def fold_page_edits(edits: DataFrame, keys: list[str], seq: str, n_pages: Column) -> DataFrame:
    """(keys, pages): page numbers and turns after a log of move, delete and rotate, in order.

    ``edits`` has op, page, arg (where to, or degrees). The last page is never deleted; edits of
    pages that are not there do nothing.
    """
    log = F.array_sort(F.collect_list(F.struct(seq, "op", "page", "arg")))
    start = F.transform(F.sequence(F.lit(0), n_pages - 1), lambda i: F.struct(i.alias("page"), F.lit(0).alias("turn")))

    def without(pages: Column, i: Column) -> Column:
        return F.concat(F.slice(pages, F.lit(1), i), F.slice(pages, i + 2, F.greatest(F.size(pages) - i - 1, F.lit(0))))

    def step(pages: Column, e: Column) -> Column:
        n, i, to = F.size(pages), e["page"], e["arg"]
        there = (i >= 0) & (i < n)
        safe, target = F.when(there, i).otherwise(F.lit(0)), F.least(F.greatest(to, F.lit(0)), n - 1)
        one, rest = F.element_at(pages, safe + 1), without(pages, safe)
        moved = F.concat(F.slice(rest, F.lit(1), target), F.array(one), F.slice(rest, target + 1, F.greatest(n - 1 - target, F.lit(0))))
        turned = F.transform(pages, lambda p, k: F.struct(p["page"].alias("page"), F.when(k == i, F.pmod(p["turn"] + e["arg"], F.lit(360))).otherwise(p["turn"]).alias("turn")))
        return (
            F.when((e["op"] == "delete") & there & (n > 1), rest)
            .when((e["op"] == "move") & there & (to >= 0) & (to < n), moved)
            .when((e["op"] == "rotate") & there, turned)
            .otherwise(pages)
        )

    return edits.groupBy(*keys).agg(log.alias("_log")).select(*keys, F.aggregate("_log", start, step).alias("pages"))


def annotations(annots: DataFrame, height: str) -> DataFrame:
    """What readers list: no links, form fields or pop-ups; contents trimmed, corners in order, place down the page."""
    from quire.functions import formats, geometry

    shown = annots.where(~F.coalesce(F.col("subtype"), F.lit("")).isin(*formats.ANNOTATION_MACHINERY))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    ordered = shown.withColumns({"x0": F.least(x0, x1), "y0": F.least(y0, y1), "x1": F.greatest(x0, x1), "y1": F.greatest(y0, y1), "contents": F.trim("contents"), "kind": formats.shown_kind(F.col("subtype"))})
    return ordered.withColumn("y_fraction", geometry.y_fraction(F.col(height), F.coalesce("y1", F.col(height))))


def remove_annotations(annots: DataFrame, gone: DataFrame, ident: str = "annot_id", parent: str = "parent_id") -> DataFrame:
    """Annotations but for those of ``gone`` and their pop-ups."""
    left = annots.join(gone.select(ident), ident, "left_anti")
    return left.join(gone.select(F.col(ident).alias(parent)), parent, "left_anti").select(annots.columns)
