"""Substring dedup: windows of words that occur more than once are removed.

Every window of a fixed number of words has a Rabin-Karp hash; hashes are counted in Spark and
windows that repeat merge into maximal removal intervals. Only windows that can repeat are sent
to be counted: a window's smallest hash of ``GRAM`` consecutive words is the same wherever the
window is, so a window whose smallest one stands at one place only is counted as one where it is.
Windows are compared by two hashes of 64 and 32 bits: that any two of 10^13 different windows
share both has a chance below 10^-3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import Words, blocks, inside, mix, rolling, rows_of, split, word_hashes
from quire.llm.work import discard, saved

GRAM = 12

_OTHER = np.uint64(0x2545F4914F6CDD1D)


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive entries."""
    if len(x) < size:
        return x[:0]
    have, n = x, 1
    while 2 * n <= size:
        have, n = np.minimum(have[:-n], have[n:]), 2 * n
    rest = size - n
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def window_runs(hashes: np.ndarray, words: Words, window: int) -> tuple[np.ndarray, ...]:
    """(least gram hash, row, first and last window start in the row, places of the gram) of runs of windows with one least gram."""
    gram = min(GRAM, window)
    grams = rolling(hashes, gram)
    least = sliding_least(grams, window - gram + 1)
    ok = np.flatnonzero(inside(words.first, window, len(least)))
    if not len(ok):
        return (np.zeros(0, np.int64),) * 5
    row = rows_of(words.first)[ok]
    value = least[ok]
    new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([new[1:], [len(ok)]]) - 1
    base = words.first[row[new]]
    tail = grams[ok[last][:, None] + np.arange(1, window - gram + 1)] == value[new][:, None]
    places = np.add.reduceat((grams[ok] == value).astype(np.int64), new) + tail.sum(axis=1)
    return value[new].view(np.int64), row[new], ok[new] - base, ok[last] - base, places


def _runs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                w = split(b)
                value, row, lo, hi, places = window_runs(word_hashes(b.data, w), w, window)
                at = pa.array(row + b.lo)
                yield pa.RecordBatch.from_arrays([pa.array(value), batch.column(0).take(at), batch.column(1).take(at), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(places, pa.int32())], ["least", "_q_id", "_q_text", "lo", "hi", "places"])

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(3)
            for b in blocks(batch.column(2)):
                w = split(b)
                words = word_hashes(b.data, w)
                h, check = rolling(words, window), rolling(mix(words ^ _OTHER), window)
                part = runs.slice(b.lo, b.hi - b.lo)
                n_runs = np.diff(np.asarray(part.offsets))
                lo, hi = (np.asarray(part.flatten().field(k)).astype(np.int64) for k in (0, 1))
                row = np.repeat(np.arange(len(n_runs)), n_runs)
                size = hi - lo + 1
                start = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                row = np.repeat(row, size)
                at = pa.array(row + b.lo)
                place = w.first[row] + start
                yield pa.RecordBatch.from_arrays([pa.array(h[place].view(np.int64)), pa.array((check[place] >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32))], ["hash", "check", "_q_id", "_q_text", "start"])

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, intervals = [], [], [], []
            for text, starts in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2), strict=True):
                words = text.split()
                n_words.append(len(words))
                if starts.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    s = np.asarray(starts.values)
                    np.add.at(change, s, 1)
                    np.add.at(change, s + window, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    intervals.append([{"from": int(a), "to": int(b)} for a, b in edge.reshape(-1, 2)])
                    n_removed.append(int(gone.sum()))
                    words = [words[i] for i in np.flatnonzero(~gone)]
                else:
                    intervals.append([])
                    n_removed.append(0)
                kept.append(b" ".join(words))
            spans = pa.array(intervals, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string()), spans], ["doc_id", "n_words", "n_removed", "text", "removed"])

    return run


def remove_repeats(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space) and removed (maximal intervals of words).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of ``window`` words that
    covers it also starts anywhere else, in this document or another; windows are those of the
    input. Null texts have no words. Rows are told apart by id and text: rows that repeat whole
    are repeats of each other and each gives a row. Other columns are not returned.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_q_id"), F.xxhash64(whole).alias("_q_text"), whole.alias("text"))
    key = lambda a, b: a["_q_text"].eqNullSafe(b["_q_text"]) & a["_q_id"].eqNullSafe(b["_q_id"])

    runs = saved(rows.mapInArrow(_runs(window), f"least long, _q_id {kind}, _q_text long, lo int, hi int, places int"), "runs")
    shared = saved(runs.groupBy("least").agg(F.sum("places").alias("n")).where("n > 1").select("least"), "shared")
    some = saved(runs.join(shared, "least", "left_semi").groupBy("_q_id", "_q_text").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "candidates")
    discard(runs, shared)

    met = rows.join(some, key(rows, some)).select(rows["_q_id"], rows["_q_text"], "text", "runs")
    windows = saved(met.mapInArrow(_windows(window), f"hash long, check int, _q_id {kind}, _q_text long, start int"), "windows")
    discard(some)
    twice = saved(windows.groupBy("hash", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "check"), "twice")
    gone = saved(windows.join(twice, ["hash", "check"], "left_semi").groupBy("_q_id", "_q_text").agg(F.collect_set("start").alias("starts")), "gone")
    discard(windows, twice)

    left = rows.join(gone, key(rows, gone), "left").select(rows["_q_id"], "text", "starts")
    return left.mapInArrow(_remove(window), f"doc_id {kind}, n_words long, n_removed long, text string, removed array<struct<from: long, to: long>>")
