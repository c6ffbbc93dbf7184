"""Objects of paged files as a table: trees in order, what their nodes inherit, and several files' objects as one file's.

An object is (node, parent, place among its siblings, kind); kinds are tree, page, outline, and any others
that pages lead to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources import tables

#: Nodes of a way from a root, itself included; deeper ones count as part of a loop.
DEPTH = 64


def paths(nodes: DataFrame, keys: list[str], most: int = DEPTH) -> DataFrame:
    """(keys, node, path): the places on the way from a root down to each node (node, parent, place).

    Nodes whose way up does not end within ``most``, as in a loop, are left out; a parent that is not there
    ends it. Each round doubles the ways that go on and writes them, until all have ended or no other one ends.
    """
    found = tables.saved(nodes.select(*keys, "node", "parent", "place"), "nodes")
    return _ways(found, keys, most).select(*keys, "node", "path")


def _ways(nodes: DataFrame, keys: list[str], most: int = DEPTH, values: tuple[str, ...] = (), carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, carried, path, values): ``paths`` of a written table, with the value of the nearest node on each way that has one."""
    state = nodes.select(*keys, "node", *carried, F.col("parent").alias("_up"), F.array(F.col("place").cast("long")).alias("path"), *values)
    done, going, way = state.where("_up is null"), state.where("_up is not null"), 1
    while way < most and going.limit(1).count():
        above = done.unionByName(going).select(*keys, F.col("node").alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_path"), *[F.col(v).alias(f"_{v}") for v in values])
        nearest = [F.coalesce(v, f"_{v}").alias(v) for v in values]
        further = going.join(above, [*keys, "_up"], "left").select(*keys, "node", *carried, F.col("_next").alias("_up"), F.concat(F.coalesce("_path", F.array().cast("array<bigint>")), "path").alias("path"), *nearest)
        further = tables.saved(further, "ways")
        ended = further.where("_up is null")
        # A longer way passes by one of every shorter length: where none ends in a round, the rest are loops.
        if not ended.limit(1).count():
            tables.release(further)
            break
        done, going, way = done.unionByName(ended), further.where("_up is not null"), way * 2
    return done.drop("_up")


def reached(start: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node): all that ``start`` leads to by references (node, to), however far and in circles. A round takes a step from what is new."""
    seen = tables.saved(start.select(*keys, "node").distinct(), "reached")
    new = seen
    while True:
        steps = new.join(refs, [*keys, "node"]).select(*keys, F.col("to").alias("node")).distinct()
        new = tables.saved(steps.join(seen, [*keys, "node"], "left_anti"), "reached")
        if not new.limit(1).count():
            return seen
        seen = seen.unionByName(new)


def merged(files: DataFrame, objects: DataFrame, refs: DataFrame, values: list[str]) -> DataFrame:
    """(job, new_id, kind, parent, place, title, target, values, folded): the objects of each job's files as those of one file.

    ``files`` has job, file_no, title and encrypted; ``objects`` job, file_no, node, kind, parent, place, title,
    target (of outlines) and ``values``; ``refs`` job, file_no, node, to. Ids of a file move behind those of
    the files before it. Pages come under one new root (0) in order of files, with what they inherited;
    what no page leads to goes. Each file has an outline entry, its own entries under it and folded; entries
    in a loop go, and those that lead to no page of the file lead nowhere. A job with an encrypted file is left out.
    """
    keys = ["job", "file_no"]
    refused = files.groupBy("job").agg(F.bool_or("encrypted").alias("no")).where("no").select("job")
    files = tables.saved(files.join(refused, "job", "left_anti"), "files")
    objects = tables.saved(objects.join(files.select(*keys), keys), "objects")
    tops = files.select(*keys, "title").join(objects.groupBy(*keys).agg(F.max("node").alias("top")), keys, "left")
    before = Window.partitionBy("job").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    room = F.coalesce("top", F.lit(-1)) + 2
    bases = tables.saved(tops.withColumns({"base": F.coalesce(F.sum(room).over(before), F.lit(0)) + 1, "entry": F.coalesce(F.sum(room).over(before), F.lit(0)) + room}), "bases")
    moved = lambda c: F.col("base") + F.col(c)
    none = lambda kind: F.lit(None).cast(kind)
    types = {v: objects.schema[v].dataType for v in values}

    def shaped(df: DataFrame, new_id, kind, parent, place, title, target, folded, own: bool) -> DataFrame:
        columns = {"new_id": new_id, "kind": kind, "parent": parent, "place": place, "title": title, "target": target}
        return df.select("job", *(c.cast("string" if k in ("kind", "title") else "long").alias(k) for k, c in columns.items()), *(F.col(v) if own else none(types[v]).alias(v) for v in values), folded.alias("folded"))

    # Page trees and outlines go up their ways together, a class apart, and what nodes inherit comes along.
    classed = objects.where("kind in ('tree', 'page', 'outline')").withColumns({"outline": F.col("kind") == "outline", "up": F.col("parent")})
    ways = _ways(classed, [*keys, "outline"], values=tuple(values), carried=("kind", "place", "title", "target", "up"))
    flat = ways.where("kind = 'page'")
    number = F.row_number().over(Window.partitionBy("job").orderBy("file_no", "path", "node")) - 1
    of_pages = shaped(flat.drop("title").join(bases, keys).withColumn("number", number), moved("node"), F.lit("page"), F.lit(0), F.col("number"), none("string"), none("long"), F.lit(False), True)
    # Every round reads the references; they are joined by merging, as the size of small files says little of their rows.
    refs = tables.saved(refs.select(*keys, "node", "to"), "refs")
    led = reached(flat, refs, keys).join(flat.select(*keys, "node"), [*keys, "node"], "left_anti")
    rest = objects.where("kind not in ('tree', 'page', 'outline')").join(led, [*keys, "node"]).join(bases.drop("title"), keys)
    of_rest = shaped(rest, moved("node"), F.col("kind"), F.when(F.col("parent").isNotNull(), moved("parent")), F.col("place"), F.col("title"), none("long"), F.lit(False), True)
    there = flat.select(*keys, F.col("node").alias("target"), F.lit(True).alias("there"))
    kept = ways.where("outline").join(there, [*keys, "target"], "left").join(bases.drop("title"), keys)
    of_outline = shaped(kept, moved("node"), F.lit("outline"), F.coalesce(moved("up"), F.col("entry")), F.col("place"), F.col("title"), F.when(F.col("there"), moved("target")), F.lit(False), False)
    entries = shaped(bases, F.col("entry"), F.lit("outline"), none("long"), F.col("file_no"), F.col("title"), none("long"), F.lit(True), False)
    root = shaped(files.select("job").distinct(), F.lit(0), F.lit("tree"), none("long"), F.lit(0), none("string"), none("long"), F.lit(False), False)
    return root.unionByName(of_pages).unionByName(of_rest).unionByName(of_outline).unionByName(entries)
