"""Tolerant search over pages, and the next match from a place."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quire.functions import text as T

#: Bytes of queries that one automaton takes; a task holds some fifty times as much.
SET_BYTES = 2 << 20


def search(pages: DataFrame, text: str, query: str) -> DataFrame:
    """Pages that hold the query, compared normalised; an empty query finds none."""
    return pages.where(T.holds(F.col(text), query))


def find_next(pages: DataFrame, keys: list[str], page: str, text: str, starts: DataFrame, query: str, forward: bool = True) -> DataFrame:
    """(keys, start, page): the next page with the query from each start, wrapping; the start itself comes last.

    ``starts`` has keys and start. Pages are numbered from 0 without holes.
    """
    hits = search(pages, text, query).select(*keys, F.col(page).alias("_at"), F.lit(False).alias("_start"))
    both = hits.unionByName(starts.select(*keys, F.col("start").alias("_at"), F.lit(True).alias("_start")).distinct())
    hit = F.when(~F.col("_start"), F.col("_at"))
    # Along the pages the other way, a start comes before a hit of its own page and after all hits beyond it.
    way = F.col("_at").desc() if forward else F.col("_at").asc()
    beyond = F.last(hit, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(way, F.col("_start").desc()).rowsBetween(Window.unboundedPreceding, -1))
    wrapped = (F.min if forward else F.max)(hit).over(Window.partitionBy(*keys))
    found = both.withColumn("page", F.coalesce(beyond, wrapped)).where(F.col("_start") & F.col("page").isNotNull())
    return found.select(*keys, F.col("_at").alias("start"), "page")


def next_in_page(matches: DataFrame, keys: list[str], page: str, index: str) -> DataFrame:
    """Adds next_page and next_index: the match after each one, wrapping to the first."""
    w = Window.partitionBy(*keys).orderBy(page, index)
    first = Window.partitionBy(*keys).orderBy(page, index).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first))
    return matches.withColumns({"next_page": at(page), "next_index": at(index)})


def next_outcome(starts: DataFrame, matches: DataFrame, keys: list[str], page: str, index: str) -> DataFrame:
    """Starts (keys, page) with outcome and, for a match, next_page: nothing without a match, only where the start is the one match, else match.

    ``here`` says whether the start's page has a match; next_page is then the page after it, wrapping.
    """
    n = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    after = next_in_page(matches, keys, page, index).select(*keys, page, "next_page")
    joined = starts.join(n, keys, "left").join(after, [*keys, page], "left")
    here = F.col("next_page").isNotNull()
    outcome = F.when(F.col("_n").isNull(), "nothing").when(here & (F.col("_n") == 1), "only").otherwise("match")
    return joined.select(*starts.columns, outcome.alias("outcome"), here.alias("here"), "next_page")


def containment(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str) -> DataFrame:
    """(doc id, query id) of every text that holds a query text, compared normalised.

    The queries make an automaton that finds all of them in one pass over each whole text. More than
    SET_BYTES of queries are dealt by hash to several automata, one pass over the texts each. Empty and
    null queries are held by none; queries of one text are found together.
    """
    asked = queries.select(F.col(query_id).alias("_id"), T.normalize(F.col(query)).alias("_q")).where(F.length("_q") > 0).distinct()
    passes = max(1, -(-int(asked.agg(F.sum(F.octet_length("_q"))).first()[0] or 0) // SET_BYTES))
    normal = docs.select(doc_id, T.normalize(F.col(text)).alias("_t"))
    schema = StructType([docs.schema[doc_id], StructField(query_id, queries.schema[query_id].dataType)])
    out = None
    for k in range(passes):
        listed = defaultdict(list)
        for row in asked.where(F.pmod(F.xxhash64("_q"), F.lit(passes)) == k).collect():
            listed[row["_q"]].append(row["_id"])
        held = normal.mapInArrow(_held(docs.sparkSession.sparkContext.broadcast(dict(listed)), to_arrow_schema(schema)), schema)
        out = held if out is None else out.unionByName(held)
    return out


def _held(shared: Broadcast, schema: pa.Schema):
    """For batches of (id, normalised text): (id, query id) of the queries that each text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for q, ids in shared.value.items():
            automaton.add_word(q, (q, ids))
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist() if shared.value else []):
                for ids in {q: ids for _, (q, ids) in automaton.iter(text or "")}.values():
                    at += [i] * len(ids)
                    found += ids
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())).cast(schema.field(0).type), pa.array(found, schema.field(1).type)], schema=schema)

    return run


def recall(expected: DataFrame, expected_text: str, got_text: str) -> DataFrame:
    """Adds n_expected and n_found: words of more than two bytes, and those of them that the other text has."""
    want, have = T.word_set(F.col(expected_text)), T.word_set(F.col(got_text))
    return expected.withColumns({"n_expected": F.size(want), "n_found": F.size(F.filter(want, lambda w: F.array_contains(have, w)))})
