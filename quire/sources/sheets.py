"""Whole style sheets of packages: property sets of styles, document defaults and themes, and what each style comes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import formats
from quire.operators import lookup

# What says that a property is off; fonts and size where neither sheet nor theme says; spacing that is left to the reader.
OFF = ("false", "0", "none", "off")
MAJOR, MINOR, SIZE, AUTO_SPACING = "Calibri Light", "Calibri", 10.0, 14.0
#: A colour that is set to none.
AUTO = "auto"
#: Marks the document's defaults where a property names the style that it is from.
DEFAULTS = "(defaults)"


def _attr(name: str) -> Column:
    return F.element_at("attrs", name)


def _last(where: Column, value: Column) -> Column:
    """The value of the last element that has one."""
    return F.max_by(value, F.when(where & value.isNotNull(), F.col("pos")))


def _of(name: str, value: Column) -> Column:
    return _last(F.col("name").isin(*name.split()), value)


def _run_properties() -> dict[str, Column]:
    val = _attr("val")
    on = formats.toggle(val, OFF)
    named = F.coalesce(_attr("ascii"), _attr("hAnsi"))
    theme = F.coalesce(_attr("asciiTheme"), _attr("hAnsiTheme"))
    font = F.when(named.isNotNull() | theme.isNotNull(), F.struct(named.alias("name"), F.when(named.isNull(), theme.startswith("major")).alias("major")))
    colour = F.when(val.isNotNull(), F.when(formats.colour(val).isNotNull(), F.upper(val)).otherwise(AUTO))
    mark = F.when(val.isNotNull(), F.coalesce(formats.highlight(val), F.lit(AUTO)))
    raised = F.when(val == "superscript", "super").when(val == "subscript", "sub").otherwise("baseline")
    return {
        "font": _of("rFonts", font), "size": _of("sz", val.try_cast("double") / 2), "bold": _of("b", on), "italic": _of("i", on), "underline": _of("u", F.coalesce(val != "none", F.lit(False))), "strike": _of("strike dstrike", on),
        "caps": _of("caps", on), "small_caps": _of("smallCaps", on), "hidden": _of("vanish", on), "colour": _of("color", colour), "highlight": _of("highlight", mark), "vertical": _of("vertAlign", raised),
    }


def _paragraph_properties() -> dict[str, Column]:
    val = _attr("val")
    on = formats.toggle(val, OFF)
    points = lambda *names: F.coalesce(*[formats.twips(_attr(n)) for n in names])
    auto = lambda side: F.when(_attr(f"{side}Autospacing").isin("1", "true"), F.lit(AUTO_SPACING))
    rule, height = _attr("lineRule"), _attr("line").try_cast("double")
    line = F.when(height.isNotNull(), F.struct(F.when(rule.isin("exact", "atLeast"), rule).otherwise("auto").alias("rule"), (height / F.when(rule.isin("exact", "atLeast"), 20.0).otherwise(240.0)).alias("value")))
    align = F.when(val.isNotNull(), F.when(val == "center", "center").when(val.isin("right", "end"), "end").when(val.isin("both", "distribute"), "justify").otherwise("start"))
    tab = F.when(val.isin("center", "decimal"), val).when(val.isin("right", "end"), "right").otherwise("left")
    stop = F.when((F.col("name") == "tab") & ~F.coalesce(val.isin("clear", "bar"), F.lit(False)) & points("pos").isNotNull(), F.struct(points("pos").alias("pos"), tab.alias("align")))
    tabs = F.when(F.bool_or(F.col("name") == "tabs"), F.array_sort(F.collect_list(stop)))
    return {
        "before": _of("spacing", F.coalesce(auto("before"), points("before"))), "after": _of("spacing", F.coalesce(auto("after"), points("after"))), "line": _of("spacing", line),
        "left": _of("ind", points("left", "start")), "right": _of("ind", points("right", "end")), "first": _of("ind", F.coalesce(F.lit(0.0) - points("hanging"), points("firstLine"))),
        "align": _of("jc", align), "keep_next": _of("keepNext", on), "page_break_before": _of("pageBreakBefore", on), "contextual": _of("contextualSpacing", on),
        "num": _of("numId", val.try_cast("int")), "level": _of("ilvl", val.try_cast("int")), "shading": _of("shd", F.when(formats.colour(_attr("fill")).isNotNull(), F.upper(_attr("fill")))), "tabs": tabs,
    }


RUN = ["font", "size", "bold", "italic", "underline", "strike", "caps", "small_caps", "hidden", "colour", "highlight", "vertical"]
PARAGRAPH = ["before", "after", "line", "left", "right", "first", "align", "keep_next", "page_break_before", "contextual", "num", "level", "shading", "tabs"]


def property_sets(shredded: DataFrame, part: str = "word/styles.xml") -> DataFrame:
    """(path, owner, owner_name, owner_attrs, run, paragraph): the sets that elements of a part hold themselves.

    An owner is the parent of a set of properties. What a tracked change replaced has an owner of its own (the
    change), so has what a table style says of some of its cells, and the mark of a paragraph. A property that
    a set does not name is null; of one named twice the last counts.
    """
    own = shredded.where((F.col("part") == part) & F.col("error").isNull())
    boxes = own.where("name in ('pPr', 'rPr')").select("path", F.col("pos").alias("box"), F.col("parent").alias("owner"), F.col("name").alias("kind"))
    owners = own.select("path", F.col("pos").alias("owner"), F.col("name").alias("owner_name"), F.col("attrs").alias("owner_attrs"))
    inner = own.where("(pPr is not null or rPr is not null) and name not in ('pPr', 'rPr')").withColumn("box", F.greatest("pPr", "rPr"))
    held = inner.join(boxes, ["path", "box"])
    run = held.where("kind = 'rPr'").groupBy("path", "owner").agg(*[c.alias(n) for n, c in _run_properties().items()]).select("path", "owner", F.struct(*RUN).alias("run"))
    paragraph = held.where("kind = 'pPr'").groupBy("path", "owner").agg(*[c.alias(n) for n, c in _paragraph_properties().items()]).select("path", "owner", F.struct(*PARAGRAPH).alias("paragraph"))
    return run.join(paragraph, ["path", "owner"], "full").join(owners, ["path", "owner"]).select("path", "owner", "owner_name", "owner_attrs", "run", "paragraph")


def sheet(shredded: DataFrame) -> DataFrame:
    """(path, style_id, kind, based_on, is_default, run, paragraph): styles with what they say themselves, and a row of kind defaults a document that has any.

    Styles without an id are left out; of styles of one id the last counts.
    """
    own = shredded.where("part = 'word/styles.xml' and error is null")
    sets = property_sets(shredded)
    heads = own.where("name = 'style'").select("path", F.col("pos").alias("owner"), _attr("styleId").alias("style_id"), _attr("type").alias("type"), F.coalesce(_attr("default").isin("1", "true"), F.lit(False)).alias("is_default")).where("style_id is not null")
    based = own.where("name = 'basedOn'").groupBy("path", F.col("parent").alias("owner")).agg(F.max_by(_attr("val"), -F.col("pos")).alias("based_on"))
    kind = F.when(F.col("type").isin("paragraph", "character", "table"), F.col("type")).otherwise("other")
    full = heads.join(based, ["path", "owner"], "left").join(sets.select("path", "owner", "run", "paragraph"), ["path", "owner"], "left").withColumn("kind", kind)
    names = ["owner", "kind", "based_on", "is_default", "run", "paragraph"]
    styles = full.groupBy("path", "style_id").agg(F.max_by(F.struct(*names), "owner").alias("s")).select("path", "style_id", *[f"s.{n}" for n in names[1:]])
    said = sets.where("owner_name in ('rPrDefault', 'pPrDefault')")
    defaults = said.groupBy("path").agg(F.any_value(F.when(F.col("owner_name") == "rPrDefault", F.col("run")), ignoreNulls=True).alias("run"), F.any_value(F.when(F.col("owner_name") == "pPrDefault", F.col("paragraph")), ignoreNulls=True).alias("paragraph"))
    nothing = F.lit(None).cast("string")
    return styles.unionByName(defaults.select("path", F.lit(DEFAULTS).alias("style_id"), F.lit("defaults").alias("kind"), nothing.alias("based_on"), F.lit(False).alias("is_default"), "run", "paragraph"))


def themes(shredded: DataFrame) -> DataFrame:
    """(path, major, minor): the fonts of themes, null where one names none."""
    own = shredded.where("part like 'word/theme/theme%.xml' and error is null")
    fonts = own.where("name in ('majorFont', 'minorFont')").select("path", "part", F.col("pos").alias("parent"), F.col("name").alias("which"))
    latin = own.where("name = 'latin'").select("path", "part", "parent", "pos", F.nullif(_attr("typeface"), F.lit("")).alias("font"))
    first = lambda which: F.min_by("font", F.when(F.col("which") == which, F.struct("part", "pos")))
    return latin.join(fonts, ["path", "part", "parent"]).groupBy("path").agg(first("majorFont").alias("major"), first("minorFont").alias("minor"))


def resolved(sheets: DataFrame, theme: DataFrame) -> DataFrame:
    """(path, style_id, kind, run, paragraph, origin): each style with what it takes from those it is based on and from the document's defaults.

    ``sheets`` is read in several places: pass a written table (``tables.saved``) of ``sheet``.
    ``origin`` names the style (or DEFAULTS) that each property is from. Nothing but a character style's own
    kind counts along its chain, and it takes no defaults. A font of the theme has the theme's name. Properties
    that nothing sets stay null (``decided`` fills them).
    """
    styles, defaults = sheets.where("kind <> 'defaults'"), sheets.where("kind = 'defaults'")
    chain = lookup.style_chain(styles.select("path", "style_id", "based_on"), ["path"])
    says = styles.select("path", F.col("style_id").alias("ancestor"), F.col("kind").alias("_kind"), "run", "paragraph")
    along = chain.join(says, ["path", "ancestor"]).join(styles.select("path", "style_id", "kind"), ["path", "style_id"]).where("kind <> 'character' or _kind = 'character'").drop("_kind")
    last = styles.where("kind <> 'character'").select("path", "style_id", "kind").join(defaults.select("path", "run", "paragraph"), "path").withColumns({"ancestor": F.lit(DEFAULTS), "depth": F.lit(lookup.CHAIN)})
    every = along.unionByName(last)
    fields = [("run", n) for n in RUN] + [("paragraph", n) for n in PARAGRAPH]
    near = lambda s, n: F.min_by(F.struct(F.col(s)[n].alias("v"), F.col("ancestor").alias("o")), F.when(F.col(s)[n].isNotNull(), F.col("depth"))).alias(n)
    found = every.groupBy("path", "style_id", "kind").agg(*[near(s, n) for s, n in fields]).join(theme, "path", "left")
    of_theme = F.when(F.col("font.v.major"), F.coalesce("major", F.lit(MAJOR))).when(F.col("font.v").isNotNull(), F.coalesce("minor", F.lit(MINOR)))
    value = lambda n: (F.coalesce(F.col("font.v.name"), of_theme) if n == "font" else F.col(n)["v"]).alias(n)
    origin = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for _, n in fields]), F.array(*[F.col(n)["o"] for _, n in fields])), lambda k, v: v.isNotNull())
    return found.select("path", "style_id", "kind", F.struct(*[value(n) for n in RUN]).alias("run"), F.struct(*[value(n) for n in PARAGRAPH]).alias("paragraph"), origin.alias("origin"), F.coalesce("minor", F.lit(MINOR)).alias("_minor"))


def decided(found: DataFrame) -> DataFrame:
    """``resolved`` with the run's look decided: the theme's minor font, ten points, no flags where nothing says; no colour where it is set to none."""
    r = lambda n: F.col("run")[n]
    off = lambda n: F.coalesce(r(n), F.lit(False)).alias(n)
    shown = lambda n: F.when(r(n) != AUTO, r(n)).alias(n)
    look = F.struct(F.coalesce(r("font"), "_minor").alias("font"), F.coalesce(r("size"), F.lit(SIZE)).alias("size"), *[off(n) for n in ("bold", "italic", "underline", "strike", "caps", "small_caps", "hidden")], shown("colour"), shown("highlight"), F.coalesce(r("vertical"), F.lit("baseline")).alias("vertical"))
    return found.withColumn("run", look)
