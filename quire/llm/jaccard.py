"""N-gram Jaccard join: documents whose sets of word shingles are alike, and their groups.

A document's shingles are put in one order for all documents, rare ones first. Two sets that are
alike share a shingle among the first few of either (the prefix), so documents are joined on
prefix shingles. Candidates must pass a length filter, a positional filter (what is left after
the shared shingle must be enough) and a suffix filter (the sums of the smaller counts of hash
ranges bound the overlap); each pair that passes is verified once on the whole sets.

Rarity is taken from counts of hash ranges over all documents, of fixed size: any common order
is right, and in large groups of copies or of documents with a passage in common the counts are
far above their error. Equal sets are one node. For groups, each prefix shingle's documents are
first compared with the one that has it earliest; only documents that are then still in different
groups are joined with each other, so groups of near copies do not grow into all their pairs. That
join takes a pair only if the parities of the sets' hash cells allow it: two sets differ in at
least as many shingles as their parities do in cells, so documents that share a common passage but
no more are not paired, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.words import SMALL_BLOCK_BYTES, blocks, lower_ascii, mix, rolling, split, word_hashes
from quire.llm.work import discard, keeps_names, saved

#: Hash ranges that are counted; 32-bit counts of all are sent to every executor (4 MB).
RANGES = 1 << 20
#: Counts that travel in one row.
CHUNK = 1 << 12
#: Sets that a task writes at once.
SETS_BYTES = 1 << 22
#: Hash ranges of the suffix filter.
BINS = 64
#: Cells of hashes whose parities are compared, 64 in a number.
PARITY_CELLS = 256
PARITIES = [f"parity{k}" for k in range(PARITY_CELLS // 64)]
SALTS = 64


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row that has a word.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer than ``size`` are one shingle.
    """
    for b in blocks(column, SMALL_BLOCK_BYTES):
        b.data = lower_ascii(b.data)
        w = split(b)
        h = word_hashes(b.data, w)
        r = rolling(h, size)
        first = w.first.tolist()
        for i in range(len(first) - 1):
            a, z = first[i], first[i + 1]
            n = z - a
            if n >= size:
                s = np.sort(r[a : z - size + 1])
                yield b.lo + i, s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif n:
                yield b.lo + i, rolling(h[a:z], n) ^ np.uint64(n)


def signature(s: np.ndarray) -> int:
    """A 64-bit hash of a set of hashes and its size."""
    t = np.array([mix(s).sum() ^ np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64) + np.uint64(len(s))
    return int(mix(t).view(np.int64)[0])


def parities(s: np.ndarray) -> np.ndarray:
    """Whether each cell holds an odd number of the hashes, as bits of 64-bit numbers."""
    odd = np.bincount((s & np.uint64(PARITY_CELLS - 1)).astype(np.int64), minlength=PARITY_CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _facts(size: int):
    """Rows of each document (n, sig, parities), then the task's counts of hash ranges in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RANGES, np.int32)
        names = ["_q_id", "_q_key", "n", "sig", "chunk", "counts", *PARITIES]
        kind, any_row = None, False
        for batch in batches:
            kind = batch.schema.field(0).type
            n, sig = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            odd = np.zeros((len(PARITIES), batch.num_rows), np.int64)
            for row, s in shingle_sets(batch.column(2), size):
                n[row], sig[row], odd[:, row] = len(s), signature(s), parities(s)
                np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), 1)
                any_row = True
            nothing = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(sig), nothing, pa.nulls(batch.num_rows, pa.binary()), *map(pa.array, odd)], names)
        if any_row:
            parts = [c.tobytes() for c in counts.reshape(-1, CHUNK)]
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary()), *[pa.nulls(k, pa.int64())] * len(PARITIES)], names)

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of counts a chunk, whatever the number of rows: a task holds the sums of all chunks at most."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total.setdefault(chunk, np.zeros(CHUNK, np.int64))
            total[chunk] += np.frombuffer(c.as_buffer(), np.int32)
    if total:
        most = np.iinfo(np.int32).max
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(t, most).astype(np.int32).tobytes() for t in total.values()], pa.binary())], ["chunk", "counts"])


def range_counts(facts: DataFrame) -> np.ndarray:
    """Documents by hash range of their shingles, over all documents; its size is fixed."""
    parts = facts.where("chunk is not null").select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(SALTS)).alias("salt"))
    some = parts.repartition("chunk", "salt").select("chunk", "counts").mapInArrow(_add_counts, "chunk int, counts binary")
    rows = some.repartition("chunk").mapInArrow(_add_counts, "chunk int, counts binary").collect()
    out = np.zeros((RANGES // CHUNK, CHUNK), np.int32)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int32)
    return out.ravel()


def _prefixes(size: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            seen: set[int] = set()
            tokens, sigs, ns, lengths = [], [], [], []
            for _, s in shingle_sets(batch.column(0), size):
                sig, n = signature(s), len(s)
                if sig in seen:
                    continue
                seen.add(sig)
                order = np.argsort(counts[(s >> np.uint64(44)).astype(np.int64)], kind="stable")
                p = n + (-percent * n) // 100 + 1
                tokens.append(s[order[:p]])
                sigs.append(sig)
                ns.append(n)
                lengths.append(p)
            if tokens:
                k = np.array(lengths)
                at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(sigs, np.int64), k)), pa.array(np.repeat(np.array(ns, np.int32), k)), pa.array(at.astype(np.int32))], ["token", "sig", "n", "at"]
                )

    return run


def _set_rows(sig: pa.Array, rows: list[int], bins: list[np.ndarray], sets: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([sig.take(pa.array(rows)), pa.array(bins, pa.list_(pa.int32())), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["sig", "bins", "set"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows, bins, sets, held = [], [], [], 0
            batch = batch.filter(pa.array([sig not in seen for sig in batch.column(0).to_pylist()], pa.bool_()))
            expected = batch.column(0).to_pylist()
            for row, s in shingle_sets(batch.column(1), size):
                if expected[row] in seen or signature(s) != expected[row]:  # a row that repeats, or another text under the same key
                    continue
                seen.add(expected[row])
                rows.append(row)
                bins.append(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS).astype(np.int32))
                sets.append(s.tobytes())
                held += len(sets[-1])
                if held >= SETS_BYTES:
                    yield _set_rows(batch.column(0), rows, bins, sets)
                    rows, bins, sets, held = [], [], [], 0
            if rows:
                yield _set_rows(batch.column(0), rows, bins, sets)

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if (100 + percent) * both >= percent * (len(a) + len(b)):
                    links.append(k)
            at = pa.array(links, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return run


def _enough(x: str, y: str, percent: int) -> Column:
    """Length and positional filters of two prefix rows of one shingle."""
    nx, ny, ax, ay = (F.col(c).cast("long") for c in (f"{x}.n", f"{y}.n", f"{x}.at", f"{y}.at"))
    least = F.lit(percent) * (nx + ny)
    return (F.lit(100) * F.least(nx, ny) >= F.lit(percent) * F.greatest(nx, ny)) & (F.lit(100 + percent) * F.least(nx - ax, ny - ay) >= least)


def _may_match(x: str, y: str, percent: int) -> Column:
    """The bound of the parities: sets that differ in more cells than alike sets differ in shingles are not alike."""
    apart = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))).cast("long") for p in PARITIES), F.lit(0).cast("long"))
    return F.lit(100 + percent) * apart <= F.lit(100 - percent) * (F.col(f"{x}.n").cast("long") + F.col(f"{y}.n"))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified pairs (a, b) of candidate pairs; the suffix filter comes before whole sets are fetched."""
    thin = lambda s: sets.select(F.col("sig").alias(s), F.col("bins").alias(f"bins_{s}"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda t, v: t + v)
    overlap = total(F.zip_with("bins_a", "bins_b", lambda v, w: F.least(v, w)))
    left = pairs.join(thin("a"), "a").join(thin("b"), "b").where(F.lit(100 + percent) * overlap >= F.lit(percent) * (total("bins_a") + total("bins_b"))).select("a", "b")
    whole = lambda s: sets.select(F.col("sig").alias(s), F.col("set").alias(f"set_{s}"))
    fetched = left.join(whole("a"), "a").join(whole("b"), "b").select("a", "b", "set_a", "set_b")
    return fetched.mapInArrow(_verify(percent), "a long, b long")


def _key(doc_id: str, text: str) -> Column:
    """A hash of a row's id and text; never null, and rows that share it are one text under one id."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def _linked(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(_q_id, _q_key, n, sig of every row; node and label of each set that links with another one)."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("_q_id"), _key(doc_id, text).alias("_q_key"), F.col(text).alias("text"))
    facts = saved(rows.mapInArrow(_facts(size), f"_q_id {kind}, _q_key long, n int, sig long, chunk int, counts binary, {', '.join(f'{p} long' for p in PARITIES)}"), "facts")
    known = facts.where("chunk is null").select("_q_id", "_q_key", "n", "sig", *PARITIES)
    shared = spark.sparkContext.broadcast(range_counts(facts))

    prefix = saved(rows.select("text").mapInArrow(_prefixes(size, percent, shared), "token long, sig long, n int, at int"), "prefix")
    met = saved(prefix.groupBy("token").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("token"), "met")
    held = saved(prefix.join(met, "token", "left_semi").distinct(), "held")
    discard(prefix, met)

    repeated = known.where("n > 0").groupBy("_q_key").count().where("count > 1").limit(1).count() > 0

    def sets_of(pairs: DataFrame) -> DataFrame:
        """Whole sets of the signatures in candidate pairs, each from one row that has it."""
        sigs = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        first = known.groupBy("sig").agg(F.min("_q_key").alias("_q_key")).join(sigs, "sig", "left_semi")
        again = rows.join(first, "_q_key").select("sig", "text")
        sets = again.mapInArrow(_sets(size), "sig long, bins array<int>, set binary")
        return saved(sets.dropDuplicates(["sig"]) if repeated else sets, "sets")

    earliest = held.groupBy("token").agg(F.min(F.struct("at", "sig", "n")).alias("e")).select("token", F.col("e.sig").alias("sig"), F.col("e.n").alias("n"), F.col("e.at").alias("at"))
    ordered = (F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b"))
    star = held.alias("x").join(earliest.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.sig") != F.col("y.sig")) & _enough("x", "y", percent))
    tried = saved(star.select(*ordered).distinct(), "tried")
    sets = sets_of(tried)
    linked = saved(_links(tried, sets, percent), "links")
    discard(sets)

    group = components(linked)
    placed = saved(held.join(group, held["sig"] == group["node"], "left").select("token", "sig", "n", "at", F.coalesce("label", "sig").alias("group")), "placed")
    by_token = placed.groupBy("token", "group").agg(F.count(F.lit(1)).alias("size")).groupBy("token").agg(F.max_by("group", F.struct("size", "group")).alias("main"), F.count(F.lit(1)).alias("groups"))
    split_tokens = saved(by_token.where("groups > 1").select("token", "main"), "split")
    apart = placed.join(split_tokens, "token")
    odd = known.where("n > 0").select("sig", *PARITIES).dropDuplicates(["sig"])
    apart = saved(apart.join(odd, "sig"), "apart")
    cross = (
        apart.where(F.col("group") != F.col("main"))
        .alias("x")
        .join(
            apart.alias("y"),
            (F.col("x.token") == F.col("y.token"))
            & (F.col("x.group") != F.col("y.group"))
            & ((F.col("y.group") == F.col("y.main")) | (F.col("x.sig") < F.col("y.sig")))
            & _enough("x", "y", percent)
            & _may_match("x", "y", percent),
        )
    )
    rest = saved(cross.select(*ordered).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    sets = sets_of(rest)
    more = saved(_links(rest, sets, percent), "links")
    if more.limit(1).count():
        group = components(linked.union(more))
    discard(held, sets, tried, placed, split_tokens, apart, rest, linked, more)
    return known, group


def _best_of_sets(known: DataFrame, final: DataFrame, best: Column) -> DataFrame:
    """(sig, best): an aggregate (a least value) over all rows of the group of each set.

    Rows of equal sets meet as one row a set, so that callers' last join is of plain tables that Spark can split.
    """
    least = known.where("n > 0").groupBy("sig").agg(best.alias("least"))
    placed = saved(least.join(final, least["sig"] == final["node"], "left").select("sig", "least", F.coalesce("label", "sig").alias("group")), "placed")
    named = saved(placed.groupBy("group").agg(F.min("least").alias("best")), "named")
    of_sig = saved(placed.join(named, "group").select("sig", "best"), "of_sig")
    discard(placed, named)
    return of_sig


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id that it reaches by links.

    Two documents link if 100 * intersection >= ``percent`` * union of their shingle sets. A row
    without words has an empty set, links with nothing and is its own component. Rows that repeat
    are linked as equal sets. Shingles are compared by 64-bit hashes. Rows with null ids are kept
    and link as any other; a group of null ids only has a null component.
    """
    known, final = _linked(docs, size, percent, doc_id, text)
    of_sig = _best_of_sets(known, final, F.min("_q_id")).withColumnRenamed("best", "component_id")
    out = known.where("n > 0").join(of_sig, "sig", "left").select("_q_id", "n", "component_id").unionByName(known.where("n = 0").select("_q_id", "n", F.col("_q_id").alias("component_id")))
    return out.select(F.col("_q_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")


@keeps_names()
def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of ``docs``, all columns as they were.

    The row with the smallest id stays (nulls last), of several texts under that id the one with
    the smallest key, of rows that repeat both the one whose hash over all columns is smallest.
    A row without words is alone in its group, but rows that repeat its id and text go too.
    """
    known, final = _linked(docs, size, percent, doc_id, text)
    of_sig = _best_of_sets(known, final, F.min(F.struct(F.col("_q_id").isNull().alias("none"), "_q_id", "_q_key")))
    stays = F.col("_q_id").eqNullSafe(F.col("best._q_id")) & (F.col("_q_key") == F.col("best._q_key"))
    gone = saved(known.where("n > 0").join(of_sig, "sig").where(~stays).select(F.col("_q_id").alias("_q_gone"), F.col("_q_key").alias("_q_gone_key")).distinct(), "gone")
    left = docs.withColumn("_q_key", _key(doc_id, text)).join(gone, F.col(doc_id).eqNullSafe(F.col("_q_gone")) & (F.col("_q_key") == F.col("_q_gone_key")), "left_anti")
    alone = "n = 0 and _q_id is null"
    if not known.where(f"not ({alone})").groupBy("_q_id", "_q_key").count().where("count > 1").limit(1).count():
        return left.select(*docs.columns)
    left = saved(left, "left")
    wordless = F.col(doc_id).isNull() & ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    whole, order = F.struct(*docs.columns), F.xxhash64(*[c for c in docs.columns if not docs.schema[c].dataType.simpleString().count("map<")])
    one = left.where(~wordless).groupBy(F.col(doc_id).alias("_q_id"), "_q_key").agg(F.min_by(whole, order).alias("row")).select("row.*")
    return one.unionByName(left.where(wordless).select(*docs.columns))
