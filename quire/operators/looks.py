"""How paragraphs, runs and tables look: what they set themselves over their styles, and what an edit changes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import lookup

# Where nothing says.
RUN_DEFAULTS = {"font": "Calibri", "size": 10.0, "bold": False, "italic": False, "underline": False, "strike": False, "caps": False, "hidden": False}
CELL_PADDING = {"top": 0.0, "right": 5.4, "bottom": 0.0, "left": 5.4}
BUILTIN_COLOUR = 0x1F3864
MARKED = 0xFFFF00
BULLETS = ["•", "◦", "▪"]


def run_looks(runs: DataFrame, styles: DataFrame, keys: list[str], default_style: str | None = None) -> DataFrame:
    """Runs (style_id of the paragraph, run_style, and properties, null where not set) with every property decided.

    A run's own comes first, then its character style and what that is based on, then the paragraph's style, then RUN_DEFAULTS.
    """
    props = [p for p in RUN_DEFAULTS if p in styles.columns]
    named = lambda df, by: df.select(*keys, F.col("style_id").alias(by), F.struct(*props).alias(f"_{by}"))
    of_paragraph = named(lookup.cascade(styles, props, None, keys), "style_id")
    of_run = named(lookup.cascade(styles, props, None, keys, F.col("kind") == "character"), "run_style")
    chosen = runs.withColumn("run_style", F.coalesce("run_style", F.lit(default_style)))
    joined = chosen.join(of_run, [*keys, "run_style"], "left").join(of_paragraph, [*keys, "style_id"], "left")
    layers = lambda p: [*([F.col(p)] if p in runs.columns else []), F.col(f"_run_style.{p}"), F.col(f"_style_id.{p}"), F.lit(RUN_DEFAULTS[p])]
    rest = [c for c in runs.columns if c not in RUN_DEFAULTS]
    return joined.select(*rest, *[F.coalesce(*layers(p)).alias(p) for p in props])


def table_edges(tables: DataFrame, style_edges: DataFrame, own_edges: DataFrame, styles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table, edge, colour, width): a table's lines, its own over its style's and those that is based on.

    ``tables`` has table and style_id; edges have edge, colour and width, by style_id or table. A line that is
    explicitly none (null width) hides what is below it and is not returned.
    """
    line = F.struct("colour", "width")
    of_style = lookup.style_chain(styles, keys).join(style_edges.select(*keys, F.col("style_id").alias("ancestor"), "edge", line.alias("line")), [*keys, "ancestor"])
    inherited = tables.select(*keys, "table", "style_id").join(of_style, [*keys, "style_id"]).select(*keys, "table", "edge", "depth", "line")
    own = own_edges.select(*keys, "table", "edge", F.lit(-1).alias("depth"), line.alias("line"))
    nearest = inherited.unionByName(own).groupBy(*keys, "table", "edge").agg(F.min_by("line", "depth").alias("line"))
    return nearest.where("line.width is not null").select(*keys, "table", "edge", "line.*")


def table_padding(tables: DataFrame, style_padding: DataFrame, styles: DataFrame, keys: list[str]) -> DataFrame:
    """``tables`` (table, style_id, and top, right, bottom, left, null where not set) with all four margins: own, of the style chain, usual."""
    sides = list(CELL_PADDING)
    of_style = lookup.style_chain(styles, keys).join(style_padding.select(*keys, F.col("style_id").alias("ancestor"), *sides), [*keys, "ancestor"])
    found = of_style.groupBy(*keys, "style_id").agg(*[F.min_by(s, F.when(F.col(s).isNotNull(), F.col("depth"))).alias(f"_{s}") for s in sides])
    joined = tables.join(found, [*keys, "style_id"], "left")
    return joined.select(*[c for c in tables.columns if c not in sides], *[F.coalesce(s, f"_{s}", F.lit(CELL_PADDING[s])).alias(s) for s in sides])


def cell_edge(own: Column, table: Column, side: Column, row: Column, col: Column, span: Column, n_rows: Column, n_columns: Column) -> Column:
    """The line on a side of a cell: the cell's own if it says (maps of edges, null for none), else the table's outer or inner one."""
    inner = (
        F.when(side == "top", F.when(row == 0, "top").otherwise("insideH"))
        .when(side == "bottom", F.when(row + 1 == n_rows, "bottom").otherwise("insideH"))
        .when(side == "left", F.when(col == 0, "left").otherwise("insideV"))
        .when(side == "right", F.when(col + span >= n_columns, "right").otherwise("insideV"))
    )
    return F.when(F.map_contains_key(own, side), F.try_element_at(own, side)).otherwise(F.try_element_at(table, inner))


def builtin(look: DataFrame, kind: str, level: str, styled: Column) -> DataFrame:
    """Looks (size, bold, italic, colour, before, after, left) of kinds that a document has no style for: titles, headings and quotes."""
    is_title, is_heading, is_quote = (~styled & (F.col(kind) == k) for k in ("title", "heading", "quote"))
    n = F.col(level)
    size = F.when(is_title, F.lit(28.0)).when(is_heading, F.when(n == 1, 16.0).when(n == 2, 13.0).otherwise(12.0)).otherwise(F.col("size"))
    after = F.when(is_title, F.greatest("after", F.lit(8.0))).when(is_heading, F.greatest("after", F.lit(4.0))).otherwise(F.col("after"))
    return look.withColumns(
        {
            "size": size,
            "after": after,
            "bold": is_heading | F.col("bold"),
            "italic": is_quote | F.col("italic"),
            "colour": F.when(is_heading, F.coalesce("colour", F.lit(BUILTIN_COLOUR))).otherwise(F.col("colour")),
            "before": F.when(is_heading, F.greatest("before", F.when(n == 1, 18.0).otherwise(10.0))).otherwise(F.col("before")),
            "left": F.when(is_quote, F.greatest("left", F.lit(36.0))).otherwise(F.col("left")),
        }
    )


def fallback(paragraphs: DataFrame, kind: str, level: str, font: Column, size: Column, after: Column) -> DataFrame:
    """Paragraphs whose look nobody decided: the page's defaults, bullets and indents for lists, and what ``builtin`` says."""
    in_list = F.col(kind) == "list"
    mark = F.element_at(F.array(*map(F.lit, BULLETS)), F.pmod(F.col(level), F.lit(len(BULLETS))).cast("int") + 1)
    zero = F.lit(0.0)
    plain = paragraphs.withColumns(
        {
            "font": font, "size": size, "bold": F.lit(False), "italic": F.lit(False), "colour": F.lit(None).cast("int"), "before": zero,
            "after": F.when(in_list, zero).otherwise(after), "left": F.when(in_list, 18.0 * (F.col(level) + 1)).otherwise(zero), "first": F.when(in_list, F.lit(-14.0)).otherwise(zero), "label": F.when(in_list, mark),
        }
    )
    return builtin(plain, kind, level, F.lit(False))


def corrected_kind(kind: Column, level: Column, label: Column, direct_level: Column) -> Column:
    """(kind, level): a normal paragraph with a list label is a list item, and a list item without one is normal."""
    struct = lambda k, n: F.struct(k.alias("kind"), n.cast("int").alias("level"))
    return F.when((kind == "normal") & label.isNotNull(), struct(F.lit("list"), F.coalesce(direct_level, F.lit(0)))).when((kind == "list") & label.isNull(), struct(F.lit("normal"), F.lit(0))).otherwise(struct(kind, level))


def restyle(paragraphs: DataFrame, styles: DataFrame, keys: list[str], props: list[str], defaults: dict) -> DataFrame:
    """Paragraphs (kind, level, style_id, label, direct_level, and ``props`` set directly) with their looks and kinds worked out anew.

    Style chain under what is set directly, then ``builtin`` for kinds without a style, then ``corrected_kind``.
    """
    sheet = lookup.cascade(styles, props, defaults, keys).select(*keys, "style_id", F.struct(*props).alias("_style"), F.lit(True).alias("_styled"))
    joined = paragraphs.join(sheet, [*keys, "style_id"], "left")
    looks = joined.withColumns({p: F.coalesce(F.col(p), F.col(f"_style.{p}"), F.lit(defaults[p])) for p in props})
    built = builtin(looks, "kind", "level", F.coalesce("_styled", F.lit(False)))
    right = corrected_kind(F.col("kind"), F.col("level"), F.col("label"), F.col("direct_level"))
    return built.withColumn("_right", right).withColumns({"kind": F.col("_right.kind"), "level": F.col("_right.level")}).select(paragraphs.columns)


def marked_run(look_flag: Column, own_flag: Column) -> Column:
    """A flag of a run's look or of the run itself."""
    return F.coalesce(look_flag, F.lit(False)) | F.coalesce(own_flag, F.lit(False))


def relooked(edited: DataFrame, originals: DataFrame, styles: DataFrame, bullet: Column, keys: list[str]) -> DataFrame:
    """(keys, seq, kind, style_id, num, level): the look of edited paragraphs (seq, base, kind, level).

    Of the kind of the paragraph it was edited from, a paragraph keeps that one's style and list; else it
    takes its kind's style if the document has it, and a list item the document's bulleted list.
    """
    base = originals.select(*keys, F.col("pos").alias("base"), F.struct("kind", "level", "style_id", "num").alias("_base"))
    style = F.when(F.col("kind") == "title", "Title").when(F.col("kind") == "heading", F.concat(F.lit("Heading"), F.least("level", F.lit(6)).cast("string"))).when(F.col("kind") == "list", "ListParagraph").when(F.col("kind") == "quote", "Quote")
    have = styles.select(*keys, F.col("style_id").alias("_own"), F.lit(True).alias("_have"))
    joined = edited.join(base, [*keys, "base"], "left").withColumn("_own", style).join(have, [*keys, "_own"], "left")
    same = F.coalesce((F.col("_base.kind") == F.col("kind")) & (F.col("_base.level") == F.col("level")), F.lit(False))
    return joined.select(
        *keys, "seq", "kind",
        F.when(same, F.col("_base.style_id")).otherwise(F.when(F.col("_have"), F.col("_own"))).alias("style_id"),
        F.when(same, F.col("_base.num")).otherwise(F.when(F.col("kind") == "list", bullet)).cast("int").alias("num"),
        F.when(F.col("kind") == "list", F.col("level")).cast("int").alias("level"),
    )


def flatten(blocks: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Paragraphs of nested blocks (an array of places from the outside in) in reading order, with pos counted from 0."""
    from pyspark.sql import Window

    return blocks.where("kind = 'paragraph'").withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(path)) - 1)
