"""Benchmark decontamination by spaced-seed hashing.

A mask names the positions of a short run of tokens that count; the others may differ. Every run
of test tokens and of training tokens is hashed under every mask; equal hashes are hits, and each
hit is verified: some WINDOW aligned tokens around it must hold enough matching ones.

The masks follow from what is accepted, so that no accepted overlap is missed. A window of w
tokens with at most k substitutions is cut into g blocks; g - k of them at least are untouched,
so the masks of all choices of that many blocks, up to where they begin, find it.

A test set of up to BLOCK_BYTES is sent to the executors as sorted arrays of hashes and nothing
is shuffled. A larger one is joined on the hashes: a bitmap of fixed size over the test hashes
keeps those training hashes that may meet one, and only these are shuffled, with the tokens
around them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.words import SMALL_BLOCK_BYTES, Block, Words, blocks, mix, split, word_hashes
from quire.llm.work import free_name, saved

#: Of WINDOW aligned tokens four fifths must match (13 of 16), or four fifths of a shorter test item.
WINDOW = 16
#: By default items of fewer tokens overlap with nothing; ``least_item=1`` takes every item.
LEAST_ITEM = 5
#: Tokens that a mask compares, where the item is long enough.
WEIGHT = 6
#: A test set of up to this many bytes of text is broadcast; a larger one is joined.
BLOCK_BYTES = 8 << 20
#: Hits that are verified side by side.
LOT = 1 << 15
#: Bits of the map of test hashes that every executor holds for the join (16 MB).
MAP_BITS = 27

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def needed(n: int) -> int:
    """Matching tokens that an overlap with an item of ``n`` tokens must have."""
    return -(-4 * min(n, WINDOW) // 5)


def masks_for(n: int) -> list[str]:
    """Masks that find every accepted overlap with an item of ``n`` tokens."""
    w = min(n, WINDOW)
    k = w - needed(n)
    plans = [(min(w // b - k, -(-WEIGHT // b)) * b, b) for b in (3, 2, 1) if w // b > k]
    weight, b = max(plans)
    found = {tuple(i - chosen[0] for i in chosen) for chosen in combinations(range(w // b), weight // b)}
    return ["".join("01"[i in chosen] * b for i in range(chosen[-1] + 1)) for chosen in sorted(found)]


def _tokens(block: Block) -> Words:
    """Runs of letters and digits; each character of a script without spaces (U+3000 to U+9FFF, and beyond U+FFFF) is one.

    ASCII punctuation, the general punctuation block and CJK punctuation separate.
    """
    d = block.data
    ascii_word = (d >= 48) & (d <= 57) | (d >= 97) & (d <= 122) | (d >= 65) & (d <= 90)
    is_word = ascii_word | (d >= 128)
    cuts = None
    if len(d) > 2:
        at = np.flatnonzero((d[:-2] == 0xE2) & (d[1:-1] == 0x80) | (d[:-2] == 0xE3) & (d[1:-1] == 0x80))
        for k in range(3):
            is_word[at + k] = False
        is_word[np.flatnonzero((d[:-1] == 0xC2) & ((d[1:] == 0xA0) | (d[1:] == 0xAB) | (d[1:] == 0xBB)))[:, None] + [0, 1]] = False
        three, four = np.flatnonzero((d >= 0xE3) & (d <= 0xE9)), np.flatnonzero(d >= 0xF0)
        cuts = np.concatenate([three, three + 3, four, four + 4])
    return split(block, is_word, cuts)


def _masked(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every run under a mask, by the run's first token."""
    n = len(h) - len(mask) + 1
    out = np.full(max(n, 0), np.uint64(int("1" + mask, 2)), np.uint64)
    for k, c in enumerate(mask):
        if c == "1" and n > 0:
            out = out * _PRIME + h[k : k + n]
    return mix(out)


def _bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first token and end of the row) of each token."""
    n = np.diff(first)
    return np.repeat(np.arange(len(n)), n), np.repeat(first[:-1], n), np.repeat(first[1:], n)


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all rows, where each row begins)."""
    counts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for b in blocks(column):
        w = _tokens(b)
        counts.append(w.counts())
        hashes.append(word_hashes(b.data, w))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


@dataclass
class Seeds:
    """A test set: token hashes of all items, and where each masked hash occurs."""

    items: list
    hashes: np.ndarray
    item: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    masks: list[str]
    keys: list[np.ndarray]
    places: list[np.ndarray]
    bits: list[np.ndarray]


def seeds(items: list, texts: list[str | None], least_item: int = LEAST_ITEM) -> Seeds:
    """Hash a test set of lower-cased texts; each item under the masks of its length. Texts that share an id are one item."""
    h, first = _hashed(pa.array([t or "" for t in texts], pa.large_string()))
    item, begin, end = _bounds(first)
    same = {name: k for k, name in reversed(list(enumerate(items)))}
    item = np.array([same[name] for name in items], np.int64)[item]
    size = end - begin
    by_mask: dict[str, list[int]] = {}
    for n in {min(int(n), WINDOW) for n in np.unique(size) if n >= least_item}:
        for m in masks_for(n):
            by_mask.setdefault(m, []).append(n)
    keys, places, bits = [], [], []
    for m, sizes in by_mask.items():
        run = _masked(h, m)
        n = len(run)
        at = np.flatnonzero((end[:n] - np.arange(n) >= len(m)) & np.isin(np.minimum(size[:n], WINDOW), sizes))
        order = np.argsort(run[at], kind="stable")
        keys.append(run[at][order])
        places.append(at[order])
        table = np.zeros(1 << min(24, max(16, int(len(at) * 16).bit_length())), bool)
        table[(keys[-1] & np.uint64(len(table) - 1)).astype(np.int64)] = True
        bits.append(table)
    return Seeds(items, h, item, begin, end, list(by_mask), keys, places, bits)


def _around(at: np.ndarray, mask: str, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Token hashes of all windows around runs that begin at ``at``; 0 beyond the row."""
    index = at[:, None] + np.arange(len(mask) - WINDOW, WINDOW)
    inside = (index >= begin[at][:, None]) & (index < end[at][:, None])
    return np.where(inside, h[np.clip(index, 0, len(h) - 1)], np.uint64(0))


def _best_windows(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matches of the best window of each pair, its first match and the end of its last, from where the tokens begin)."""
    same = (x == y) & (x != 0)
    sums = np.zeros((len(x), x.shape[1] + 1), np.int16)
    np.cumsum(same, axis=1, out=sums[:, 1:])
    inside = sums[:, WINDOW:] - sums[:, :-WINDOW]
    best = inside.argmax(axis=1)
    window = np.take_along_axis(same, best[:, None] + np.arange(WINDOW), 1)
    return inside[np.arange(len(x)), best], best + window.argmax(axis=1), best + WINDOW - window[:, ::-1].argmax(axis=1)


def _overlaps(h: np.ndarray, first: np.ndarray, s: Seeds, any_item: bool = False) -> np.ndarray:
    """Rows of (row, item, matches, start and end in the row's tokens, item's tokens) of the overlaps in a block, the best of each row and item.

    With ``any_item`` a row that overlaps is not looked at again, and may give any one item.
    """
    row, begin, end = _bounds(first)
    found, done = [np.zeros((0, 6), np.int64)], np.zeros(len(first) - 1, bool)
    enough = np.array([needed(n) for n in range(WINDOW + 1)])
    for m, keys, places, bits in zip(s.masks, s.keys, s.places, s.bits, strict=True):
        run = _masked(h, m)
        at = np.flatnonzero(bits[(run & np.uint64(len(bits) - 1)).astype(np.int64)])
        at = at[end[at] - at >= len(m)]
        lo, hi = np.searchsorted(keys, run[at], "left"), np.searchsorted(keys, run[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        while len(at):
            if any_item:
                left = ~done[row[at]]
                at, lo, hi = at[left], lo[left], hi[left]
            # A lot of hits: of each run in turn as many places as fit.
            room = np.minimum(hi - lo, LOT)
            n = max(1, int(np.searchsorted(np.cumsum(room), LOT, "right")))
            size = room[:n]
            p = np.repeat(at[:n], size)
            q = places[np.repeat(lo[:n] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            matches, a, z = _best_windows(_around(p, m, h, begin, end), _around(q, m, s.hashes, s.begin, s.end))
            n_item = s.end[q] - s.begin[q]
            ok = matches >= enough[np.minimum(n_item, WINDOW)]
            start = p + len(m) - WINDOW - begin[p]
            found.append(np.stack([row[p], s.item[q], matches, start + a, start + z, n_item], axis=1)[ok])
            done[row[p[ok]]] = True
            lo = lo.copy()
            lo[:n] += size
            more = hi > lo
            at, lo, hi = at[more], lo[more], hi[more]
    all_found = np.concatenate(found)
    all_found = all_found[np.lexsort((all_found[:, 4], all_found[:, 3], -all_found[:, 2], all_found[:, 1], all_found[:, 0]))]
    new = np.ones(len(all_found), bool)
    new[1:] = (all_found[1:, :2] != all_found[:-1, :2]).any(axis=1)
    return all_found[new]


def _search(column: pa.Array, s: Seeds, any_item: bool = False) -> np.ndarray:
    found = [np.zeros((0, 6), np.int64)]
    for b in blocks(column, SMALL_BLOCK_BYTES):
        w = _tokens(b)
        if len(w.starts) and s.masks:
            found.append(_overlaps(word_hashes(b.data, w), w.first, s, any_item) + [b.lo, 0, 0, 0, 0, 0])
    return np.concatenate(found)


def _sent(benchmark: DataFrame, item_id: str, text: str, least_item: int):
    """The test set as a broadcast, or None if it is larger than BLOCK_BYTES."""
    if (benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0) > BLOCK_BYTES:
        return None
    rows = benchmark.select(item_id, F.lower(text)).where(F.length(text) > 0).collect()
    return benchmark.sparkSession.sparkContext.broadcast(seeds([r[0] for r in rows], [r[1] for r in rows], least_item))


def _text_key(text: Column) -> list[Column]:
    """128 bits of a text's hash."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2")]


def _runs(masks: dict[str, set[int] | None], bits):
    """Rows of (hash, position of the tokens around, token hashes around, tokens of the row) and the row's first columns, of every masked run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = range(batch.num_columns - 1)
            for b in blocks(batch.column(batch.num_columns - 1)):
                w = _tokens(b)
                h = word_hashes(b.data, w)
                row, begin, end = _bounds(w.first)
                for m, sizes in masks.items():
                    value = _masked(h, m)
                    n = len(value)
                    ok = end[:n] - np.arange(n) >= len(m)
                    if sizes is not None:
                        ok &= np.isin(np.minimum(end[:n] - begin[:n], WINDOW), sorted(sizes))
                    if bits is not None:
                        place = (value & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
                        ok &= (bits.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                    all_at = np.flatnonzero(ok)
                    for lot in range(0, len(all_at), LOT):
                        at = all_at[lot : lot + LOT]
                        tokens = _around(at, m, h, begin, end)
                        kept = [batch.column(k).take(pa.array(row[at] + b.lo)) for k in keys]
                        yield pa.RecordBatch.from_arrays(
                            [*kept, pa.array(value[at].view(np.int64)), pa.array((at + len(m) - WINDOW - begin[at]).astype(np.int32)), pa.array([t.tobytes() for t in tokens], pa.binary()), pa.array((end[at] - begin[at]).astype(np.int32))],
                            [*batch.schema.names[:-1], "hash", "start", "around", "size"],
                        )

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of runs (k1, k2, item, start, around, item_around, item_size) that overlap."""
    enough = np.array([needed(n) for n in range(WINDOW + 1)])
    for batch in batches:
        around, other = (batch.column(k).cast(pa.large_binary()) for k in (4, 5))
        length = np.asarray(pc.binary_length(around)) // 8
        for size in np.unique(length):
            rows = np.flatnonzero(length == size)
            x, y = (np.frombuffer(b"".join(c.take(pa.array(rows)).to_pylist()), np.uint64).reshape(-1, size) for c in (around, other))
            matches, a, z = _best_windows(x, y)
            n_item = np.asarray(batch.column(6))[rows]
            ok = matches >= enough[np.minimum(n_item, WINDOW)]
            at = pa.array(rows[ok])
            start = np.asarray(batch.column(3))[rows]
            numbers = [pa.array(v[ok].astype(np.int32)) for v in (matches, start + a, start + z, n_item)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), *numbers], ["k1", "k2", "item_id", "n_matched", "start_token", "end_token", "n_item_tokens"])


def _joined(docs: DataFrame, benchmark: DataFrame, item_id: str, text: str, least_item: int) -> DataFrame:
    """(k1, k2, item_id, n_matched, start_token, end_token, n_item_tokens) of every text, by its hash, by a join of hashes."""
    spark = docs.sparkSession
    kind = benchmark.schema[item_id].dataType.simpleString()
    masks: dict[str, set[int]] = {}
    for n in range(least_item, WINDOW + 1):
        for m in masks_for(n):
            masks.setdefault(m, set()).add(n)
    tail = "hash long, start int, around binary, size int"
    theirs = saved(benchmark.select(F.col(item_id).alias("item_id"), F.lower(text)).mapInArrow(_runs(masks, None), f"item_id {kind}, {tail}").withColumnsRenamed({"around": "item_around", "size": "item_size"}).drop("start"), "seeds")
    bit = F.pmod("hash", F.lit(1 << MAP_BITS)) + 1
    maps = theirs.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()
    bits = np.zeros((1 << MAP_BITS >> 15, 4096), np.uint8)
    for r in maps:
        bits[r["b"] - 1] = np.frombuffer(r["m"], np.uint8)
    shared = spark.sparkContext.broadcast(bits.ravel())
    runs = docs.select(*_text_key(F.lower(text)), F.lower(text)).mapInArrow(_runs(dict.fromkeys(masks), shared), f"k1 long, k2 long, {tail}")
    ours = runs.drop("size").dropDuplicates(["hash", "k1", "k2", "start"])
    pairs = ours.join(theirs, "hash").where(F.length("around") == F.length("item_around")).select("k1", "k2", "item_id", "start", "around", "item_around", "item_size")
    found = pairs.mapInArrow(_verify, f"k1 long, k2 long, item_id {kind}, n_matched int, start_token int, end_token int, n_item_tokens int")
    best = F.min_by(F.struct("n_matched", "start_token", "end_token", "n_item_tokens"), F.struct(-F.col("n_matched"), "start_token", "end_token"))
    return found.groupBy("k1", "k2", "item_id").agg(best.alias("best")).select("k1", "k2", "item_id", "best.*")


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least_item: int = LEAST_ITEM) -> DataFrame:
    """Verified overlaps: doc_id, item_id, n_matched, start_token, end_token (exclusive), n_item_tokens.

    A document and an item overlap if at least 13 of some 16 aligned tokens match, or four fifths
    of an item of fewer tokens; every such pair is found. It gives one row: the most matches of a
    window, and where the first of its tokens lie (ties: the earliest). Null and empty texts, and
    items of fewer than ``least_item`` tokens, overlap with nothing; with 1 every item takes part.
    Rows that repeat give their overlaps each. Tokens are lower-cased letters and digits.
    """
    kinds = [docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()]
    shared = _sent(benchmark, item_id, text, least_item)
    if shared is None:
        best = _joined(docs, benchmark, item_id, text, least_item)
        rows = docs.select(F.col(doc_id).alias("doc_id"), *_text_key(F.lower(text)))
        return rows.join(best, ["k1", "k2"]).drop("k1", "k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            found = _search(batch.column(1), s)
            if len(found):
                numbers = {n: pa.array(found[:, k + 2], pa.int32()) for k, n in enumerate(("n_matched", "start_token", "end_token", "n_item_tokens"))}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(found[:, 0])), "item_id": [s.items[i] for i in found[:, 1]]} | numbers)

    return docs.select(doc_id, F.lower(text).alias("text")).mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, n_matched int, start_token int, end_token int, n_item_tokens int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", least_item: int = LEAST_ITEM) -> DataFrame:
    """The rows of ``docs`` that overlap with no test item, all columns as they were; with a broadcast test set nothing is shuffled.

    Then the rows stay in the JVM: only lower-cased texts go to Python, and a flag a row comes back.
    """
    shared = _sent(benchmark, item_id, text, least_item)
    if shared is None:
        names = [free_name(docs, x) for x in ("_q_k1", "_q_k2")]
        gone = _joined(docs, benchmark, item_id, text, least_item).select("k1", "k2").distinct().toDF(*names)
        return docs.withColumns(dict(zip(names, _text_key(F.lower(text)), strict=True))).join(gone, names, "left_anti").select(docs.columns)

    @F.arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        keep = np.ones(len(column), bool)
        keep[_search(column, shared.value, any_item=True)[:, 0]] = False
        return pa.array(keep)

    return docs.where(clean(F.lower(text)))
