"""Lookups: inheritance, references, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources import tables

#: Styles of a chain that count, the style itself included.
CHAIN = 17


def style_chain(styles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, style_id, ancestor, depth): each style and what it is based on, nearest first, at most CHAIN long.

    A style based on itself or on one that is not there is based on nothing; a cycle ends with the
    chain. Each round doubles the ways and is written: a row holds its own way, never a sheet.
    """
    keys = keys or []
    base = F.when(F.col("based_on") != F.col("style_id"), F.col("based_on"))
    named = styles.select(*keys, "style_id", base.alias("_up"))
    # What is based on a style that is not there ends here, so that every _up below is one that is there.
    there = styles.select(*keys, F.col("style_id").alias("_up")).distinct().withColumn("_there", F.lit(True))
    linked = named.distinct().join(there, [*keys, "_up"], "left").select(*keys, "style_id", F.when(F.col("_there"), F.col("_up")).alias("_up"), F.array("style_id").alias("_way"))
    state, way = tables.saved(linked, "chains"), 1
    while way < CHAIN and state.where("_up is not null").limit(1).count():
        going, done = state.where("_up is not null"), state.where("_up is null")
        above = state.select(*keys, F.col("style_id").alias("_up"), F.col("_up").alias("_next"), F.col("_way").alias("_far"))
        further = going.join(above, [*keys, "_up"]).select(*keys, "style_id", F.col("_next").alias("_up"), F.slice(F.concat("_way", "_far"), 1, CHAIN).alias("_way"))
        before, state = state, tables.saved(done.unionByName(further), "chains")
        tables.release(before)
        way *= 2
    return state.select(*keys, "style_id", F.posexplode("_way").alias("depth", "ancestor")).select(*keys, "style_id", "ancestor", "depth")


def nearest_value(nodes: DataFrame, keys: list[str], node: str, up: str, value: str, most: int) -> DataFrame:
    """(keys, node, value, hops): the value of the nearest of each node and those above it that has one, ``most`` of them at most.

    Each round doubles the way that is looked up and is written, so a plan holds one round; at most
    log2(most) rounds run, and none once every way has found a value or come to its end. Loops end with
    the way. The result is a written table (``tables.release``).
    """
    state = nodes.select(*keys, F.col(node).alias(node), F.col(up).alias("_up"), F.col(value).alias("value"), F.when(F.col(value).isNotNull(), 0).alias("hops"))
    way = 1
    state = tables.saved(state, "ways")
    while way < most and state.where("value is null and _up is not null").limit(1).count():
        # Only ways that go on look further up.
        going, done = state.where("value is null and _up is not null"), state.where("value is not null or _up is null")
        above = state.select(*keys, F.col(node).alias("_up"), F.col("_up").alias("_next"), F.col("value").alias("_value"), F.col("hops").alias("_hops"))
        further = going.join(above, [*keys, "_up"], "left").select(*keys, node, F.col("_next").alias("_up"), F.col("_value").alias("value"), (F.col("_hops") + way).alias("hops"))
        before, state = state, tables.saved(done.unionByName(further), "ways")
        tables.release(before)
        way *= 2
    near = F.col("hops") < most
    return state.select(*keys, node, F.when(near, F.col("value")).alias("value"), F.when(near, F.col("hops")).alias("hops"))


def inherited_attribute(nodes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, node, value): what a page (node, parent) has or takes from those above it, itself and 63 more."""
    return nearest_value(nodes, keys, "node", "parent", value, 64).drop("hops")


def destinations(objects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, page): where each object leads: a page, or by a name, dictionary or reference (target) to another, eight steps at most."""
    return nearest_value(objects, keys, "node", "target", "page", 9).select(*keys, "node", F.col("value").alias("page"))


def referenced(rels: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """Relationships whose id stands quoted in their document's body (keys, xml); quoted words are joined, no text is searched for each id."""
    quoted = bodies.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all("xml", F.lit('"([^"]*)"'), 1))).alias("rel_id"))
    return rels.join(quoted, [*keys, "rel_id"], "left_semi")


def cascade(styles: DataFrame, props: list[str], defaults: dict | None = None, keys: list[str] | None = None, only: Column | None = None) -> DataFrame:
    """(keys, style_id, props): each property as the nearest style of the chain (those that ``only`` allows) sets it, else the default."""
    keys = keys or []
    allowed = styles.where(only) if only is not None else styles
    values = style_chain(styles, keys).join(allowed.select(*keys, F.col("style_id").alias("ancestor"), *props), [*keys, "ancestor"])
    nearest = [F.min_by(p, F.when(F.col(p).isNotNull(), F.col("depth"))).alias(p) for p in props]
    found = values.groupBy(*keys, "style_id").agg(*nearest)
    return found.select(*keys, "style_id", *[F.coalesce(F.col(p), F.lit((defaults or {}).get(p))).alias(p) for p in props])


def overlay(*layers) -> list:
    """Field by field the first value that is set, of layers nearest first (dicts of columns)."""
    names = dict.fromkeys(n for layer in layers for n in layer)
    return [F.coalesce(*[layer[n] for layer in layers if n in layer]).alias(n) for n in names]


def notes_of(refs: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """References with their notes' text; separators are no notes, a missing note is empty."""
    bodies = notes.where(F.coalesce("type", F.lit("normal")) == "normal").select(*keys, "note_id", F.col("text").alias("body"))
    return refs.join(bodies, [*keys, "note_id"], "left").withColumn("body", F.coalesce("body", F.lit("")))


def content_type(parts: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """Parts (name) with their type: by name, else by extension."""
    ext = F.lower(F.regexp_extract("name", r"\.([^./]*)$", 1))
    by_name = overrides.select("name", F.col("type").alias("_o"))
    by_ext = defaults.select(F.lower("ext").alias("_ext"), F.col("type").alias("_d"))
    return parts.withColumn("_ext", ext).join(by_name, "name", "left").join(by_ext, "_ext", "left").select(*parts.columns, F.coalesce("_o", "_d").alias("type"))


def interval_lookup(spans: DataFrame, at: DataFrame, keys: list[str], offset: str) -> DataFrame:
    """Adds value to each offset: of the half-open span (start, end, value) that holds it, spans not overlapping.

    Starts and offsets share one order, so that no range is joined.
    """
    own = [c for c in at.columns if c not in keys]
    a = spans.select(*keys, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct("end", "value").alias("_span"), F.lit(None).alias("_row"))
    b = at.select(*keys, F.col(offset).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).alias("_span"), F.struct(*own).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_found", F.last("_span", ignorenulls=True).over(w)).where("_kind = 1")
    return found.select(*keys, "_row.*", F.when(F.col("_at") < F.col("_found.end"), F.col("_found.value")).alias("value"))


def subtract_spans(whole: DataFrame, locked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): what is left of [start, end) ranges without the locked ranges, which do not overlap."""
    ends = whole.select(*keys, F.col("start").alias("_from"), F.col("end").alias("_to"))
    inner = locked.join(ends, keys).where((F.col("end") > F.col("_from")) & (F.col("start") < F.col("_to")))
    cuts = inner.select(*keys, "_from", "_to", F.greatest("start", "_from").alias("s"), F.least("end", "_to").alias("e"))
    bounds = cuts.unionByName(ends.select(*keys, "_from", "_to", F.col("_from").alias("s"), F.col("_from").alias("e")))
    w = Window.partitionBy(*keys, "_from").orderBy("s", "e")
    gaps = bounds.withColumn("next", F.coalesce(F.lead("s").over(w), F.col("_to")))
    return gaps.where("next > e").select(*keys, F.col("e").alias("start"), F.col("next").alias("end"))


def default_bullet_list(levels: DataFrame) -> DataFrame:
    """The first list (num) whose first level is a bullet."""
    return levels.where((F.col("level") == 0) & (F.col("format") == "bullet")).agg(F.min("num").alias("num"))
