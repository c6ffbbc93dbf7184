"""Edits of texts, what they touch, and small predicates over paragraphs and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a floating picture's place is measured from.
PAGE_FRAMES = ["page", "margin", "topMargin", "bottomMargin", "insideMargin", "outsideMargin"]
FORMAT_FLAGS = ["bold", "italic", "underline", "highlight"]


def replay(texts: DataFrame, log: DataFrame, keys: list[str], text: str, seq: str, backwards: bool = False) -> DataFrame:
    """``texts`` after their log of edits (op insert or delete, at, content), in order or taken back from the last.

    A text and its log are one row's work; texts without a log stay.
    """
    ops = log.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(seq, "op", "at", "content"))).alias("_log"))
    held = F.coalesce("_log", F.array().cast(ops.schema["_log"].dataType))
    adds = F.lit("delete" if backwards else "insert")

    def step(t: Column, e: Column) -> Column:
        before, rest = t.substr(F.lit(1), e["at"]), e["at"] + 1
        inserted = F.concat(before, e["content"], t.substr(rest, F.length(t)))
        deleted = F.concat(before, t.substr(rest + F.length(e["content"]), F.length(t)))
        return F.when(e["op"] == adds, inserted).otherwise(deleted)

    ordered = F.reverse(held) if backwards else held
    return texts.join(ops, keys, "left").withColumn(text, F.aggregate(ordered, F.col(text), step)).drop("_log")


def inherit_props(new_runs: DataFrame, old_runs: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """New runs with the props of the first old run of their four flags, else of the first old run, else their own."""
    like = old_runs.groupBy(*keys, *FORMAT_FLAGS).agg(F.min_by("props", pos).alias("_like"))
    first = old_runs.groupBy(*keys).agg(F.min_by(F.struct("props"), pos).alias("_first"))
    near = like.withColumn("_hit", F.lit(1))
    joined = new_runs.join(near, [*keys, *FORMAT_FLAGS], "left").join(first, keys, "left")
    props = F.when(F.col("_hit").isNotNull(), F.col("_like")).when(F.col("_first").isNotNull(), F.col("_first.props")).otherwise(F.col("props"))
    return joined.withColumn("props", props).select(new_runs.columns)


def toggled_ranges(chars: DataFrame, keys: list[str], pos: str, on: str, applied: bool) -> DataFrame:
    """(keys, start, end) of the stretches of characters whose flag changes when it is set to ``applied``."""
    w = Window.partitionBy(*keys).orderBy(pos)
    changing = chars.where(F.coalesce(F.col(on), F.lit(False)) != F.lit(applied)).withColumn("_run", F.col(pos) - F.row_number().over(w))
    return changing.groupBy(*keys, "_run").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("_run")


def all_covered(flags: Column) -> Column:
    """Whether every character of a range has a flag; an empty range has not."""
    return (F.size(flags) > 0) & F.forall(flags, lambda f: F.coalesce(f, F.lit(False)))


def page_header(first: Column, own: Column, first_header: Column, first_footer: Column) -> Column:
    """A page's header: a section's first page has its own only where a footer of its own is there too."""
    return F.when(first & first_header.isNotNull() & first_footer.isNotNull(), first_header).otherwise(own)


def floats(behind: Column, wrap: Column, vertical_from: Column) -> Column:
    """Whether a picture is drawn apart from the text."""
    return behind | ~wrap | vertical_from.isin(*PAGE_FRAMES)


def has_borders(edges: Column) -> Column:
    """Whether any edge of a map of edges is set."""
    return F.exists(F.map_values(edges), lambda e: e.isNotNull())


def visible_items(items: DataFrame) -> DataFrame:
    """Children of a body that show: those with blocks, and paragraphs, locked ones and tables."""
    return items.where((F.col("n_blocks") > 0) | F.col("kind").isin("paragraph", "locked", "table"))


def column_count(cells: DataFrame, keys: list[str], n_widths: Column | None = None) -> DataFrame:
    """(keys, n_columns) of tables of cells (row, span): the widest row's spans, or the widths given if they are more."""
    rows = cells.groupBy(*keys, "row").agg(F.sum(F.greatest(F.coalesce("span", F.lit(1)), F.lit(1))).alias("_n"), F.max(n_widths if n_widths is not None else F.lit(0)).alias("_w"))
    return rows.groupBy(*keys).agg(F.greatest(F.max("_n"), F.max("_w")).cast("int").alias("n_columns"))


def counts_pages(runs: DataFrame, keys: list[str], field: Column) -> DataFrame:
    """(keys, counts_pages): whether any run of headers and footers, in tables too, shows the number of pages."""
    return runs.groupBy(*keys).agg(F.bool_or(F.coalesce(field == "pages", F.lit(False))).alias("counts_pages"))


def annotation_ids(annots: DataFrame, keys: list[str], pos: str, ident: str) -> DataFrame:
    """(keys, ids): the annotations of each page in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(ident).alias("id"))))
    return annots.groupBy(*keys).agg(F.transform(ordered, lambda a: a["id"]).alias("ids"))


def line_runs(chars: DataFrame, keys: list[str], pos: str, text: str, skip: Column) -> DataFrame:
    """(keys, run, flags, text): an editor line's characters as runs of equal flags; bullets and placeholders (``skip``) are left out."""
    kept = chars.where(~F.coalesce(skip, F.lit(False)))
    flags = F.struct(*[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in FORMAT_FLAGS])
    w = Window.partitionBy(*keys).orderBy(pos)
    marked = kept.withColumn("_flags", flags).withColumn("_new", F.when(F.lag("_flags").over(w) == F.col("_flags"), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))), lambda c: c["t"]), "")
    return runs.groupBy(*keys, "run", "_flags").agg(joined.alias("text")).select(*keys, "run", "_flags.*", "text")


def reloads(old: DataFrame, new: DataFrame, keys: list[str], epoch: str) -> DataFrame:
    """(keys, action, epoch): swap a document in place where its pages (page, width, height) are as before, else rebuild it.

    ``old`` has the epoch of its texts; a swap begins the next one, and a rebuild begins at 0.
    """
    sizes = F.array_sort(F.collect_list(F.struct("page", "width", "height"))).alias("_sizes")
    a, b = old.groupBy(*keys).agg(sizes, F.max(epoch).alias("_epoch")), new.groupBy(*keys).agg(sizes).withColumnRenamed("_sizes", "_new")
    same = F.col("_sizes") == F.col("_new")
    return b.join(a, keys, "left").select(*keys, F.when(same, "swap").otherwise("rebuild").alias("action"), F.when(same, F.col("_epoch") + 1).otherwise(0).alias("epoch"))


def of_epoch(texts: DataFrame, epochs: DataFrame, keys: list[str], epoch: str) -> DataFrame:
    """Texts that were read in their document's epoch; others come too late."""
    return texts.join(epochs.select(*keys, epoch), [*keys, epoch], "left_semi")


def serial_edits(edits: DataFrame, keys: list[str], seq: str, n_pages: Column) -> DataFrame:
    """(keys, seq, ok, n_pages): one edit (op, page) at a time; one that cannot be done changes nothing and says so.

    Inserting puts a page at a place up to the end; deleting and rotating need the page, and the last page stays.
    """
    log = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), "op", "page")))
    kind = "array<struct<seq:bigint,ok:boolean,n_pages:int>>"

    def step(done: Column, e: Column) -> Column:
        n = F.coalesce(F.try_element_at(done, F.lit(-1))["n_pages"], n_pages)
        there = (e["page"] >= 0) & (e["page"] < n)
        ok = F.when(e["op"] == "insert", (e["page"] >= 0) & (e["page"] <= n)).when(e["op"] == "delete", there & (n > 1)).otherwise(there)
        change = F.when(ok & (e["op"] == "insert"), 1).when(ok & (e["op"] == "delete"), -1).otherwise(0)
        return F.concat(done, F.array(F.struct(e["seq"].cast("long").alias("seq"), ok.alias("ok"), (n + change).cast("int").alias("n_pages")))).cast(kind)

    folded = edits.groupBy(*keys).agg(log.alias("_log")).select(*keys, F.explode(F.aggregate("_log", F.array().cast(kind), step)).alias("_e"))
    return folded.select(*keys, "_e.*")


def version_history(log: DataFrame, keys: list[str], seq: str, keep: int = 500) -> DataFrame:
    """(keys, version, n_undo, n_redo) after a log of edit (version), undo and redo; a new edit clears what could be redone."""
    ops = F.array_sort(F.collect_list(F.struct(seq, "op", "version")))
    texts = "array<string>"
    start = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast(texts).alias("undo"), F.array().cast(texts).alias("redo"))
    state = lambda now, undo, redo: F.struct(now.cast("string").alias("now"), undo.cast(texts).alias("undo"), redo.cast(texts).alias("redo"))
    cut = lambda a: F.slice(a, F.lit(1), F.size(a) - 1)

    def step(s: Column, e: Column) -> Column:
        back = (e["op"] == "undo") & (F.size(s["undo"]) > 0)
        forth = (e["op"] == "redo") & (F.size(s["redo"]) > 0)
        pushed = F.array_append(s["undo"], s["now"])
        latest = F.slice(pushed, F.greatest(F.size(pushed) - keep + 1, F.lit(1)), F.lit(keep))
        return (
            F.when(e["op"] == "edit", state(e["version"], latest, F.array()))
            .when(back, state(F.try_element_at(s["undo"], F.lit(-1)), cut(F.when(back, s["undo"]).otherwise(F.array(F.lit("")))), F.array_append(s["redo"], s["now"])))
            .when(forth, state(F.try_element_at(s["redo"], F.lit(-1)), F.array_append(s["undo"], s["now"]), cut(F.when(forth, s["redo"]).otherwise(F.array(F.lit(""))))))
            .otherwise(s)
        )

    after = log.groupBy(*keys).agg(ops.alias("_log")).select(*keys, F.aggregate("_log", start, step).alias("_s"))
    return after.select(*keys, F.col("_s.now").alias("version"), F.size("_s.undo").alias("n_undo"), F.size("_s.redo").alias("n_redo"))


def over_text(lines: Column, x: Column, y: Column) -> Column:
    """Whether a point is over any line of text."""
    return F.exists(lines, lambda b: x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"]))


def topmost(annots: DataFrame, keys: list[str], pos: str, x: float, y: float) -> DataFrame:
    """(keys, pos) of the last annotation that holds a point."""
    held = annots.where(F.lit(x).between(F.col("x0"), F.col("x1")) & F.lit(y).between(F.col("y0"), F.col("y1")))
    return held.groupBy(*keys).agg(F.max(pos).alias(pos))


def selection(pages: DataFrame, page: str, n_chars: str, start: tuple[int | Column, int | Column], end: tuple[int | Column, int | Column], text: str | None = None) -> DataFrame:
    """Adds from and to (and selected, the part of ``text``): the part of each page between two (page, caret) places, in either order; pages with nothing of it go."""
    place = lambda p: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("long").alias(n) for n, v in zip(("page", "caret"), p, strict=True)])
    a, z = place(start), place(end)
    both = pages.withColumns({"_first": F.least(a, z), "_last": F.greatest(a, z)})
    begin = F.when(F.col(page) == F.col("_first.page"), F.col("_first.caret")).otherwise(0)
    stop = F.when(F.col(page) == F.col("_last.page"), F.least(F.col("_last.caret"), F.col(n_chars))).otherwise(F.col(n_chars))
    held = both.where(F.col(page).between(F.col("_first.page"), F.col("_last.page"))).withColumns({"from": begin.cast("int"), "to": stop.cast("int")}).where(F.col("from") < F.col("to"))
    if text is not None:
        held = held.withColumn("selected", F.substring(F.col(text), F.col("from") + 1, F.col("to") - F.col("from")))
    return held.drop("_first", "_last")


def selected_text(selected: DataFrame, keys: list[str], page: str) -> DataFrame:
    """(keys, text): the selected parts of the pages, a line end between any two."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col("selected").alias("t"))))
    return selected.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda s: s["t"]), "\n").alias("text"))


def reading_fraction(y: Column, top: Column, height: Column) -> Column:
    """How far into its page a place is, 0 or more."""
    return F.when(height > 0, F.greatest((y - top) / height, F.lit(0.0))).otherwise(0.0)
