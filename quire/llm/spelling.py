"""Spelling variants: words one edit apart, found by bands of letter-parity bitmasks.

A word's mask has a bit for each letter that it holds an odd number of times. One edit flips at most two
bits, so of three bands of the mask at least one stays; a letter more or less flips one bit, so of two
bands at least one stays. Words meet under an equal band, the length, and the two thirds of the word that
the edit left alone, which keep groups small however large the vocabulary. A pair is verified once, under
the first band and the first thirds that it shares.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.work import discard, saved

#: Letters share the bits of a long by code point; bit b belongs to band b % 3.
BITS = 63
BANDS = [sum(1 << b for b in range(i, BITS, 3)) for i in range(3)]
#: A word is cut into so many parts; an edit lies in one of them or between two.
PARTS = 3
#: One occurrence in so many loses a letter, by a checksum of document and word.
NOISE = 97

#: Texts are worked through in blocks of about so many bytes, for which a task holds some 70 times as much.
BLOCK_BYTES = 1 << 20

_CRC = np.zeros(256, np.uint32)
for _byte in range(256):
    _c = _byte
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_byte] = _c
_ALL = np.uint32(0xFFFFFFFF)


def _is_letter(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0-U+00FF, whose first byte is 0xC3 and whose second follows it."""
    low = data | 32
    first = data == 0xC3
    is_letter = (low >= 97) & (low <= 122) & (data < 128) | first
    is_letter[1:] |= first[:-1]
    return is_letter


def _checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> np.ndarray:
    """crc32 of each word's bytes, carried on from the state after what stands before it."""
    order = np.argsort(-lengths, kind="stable")
    at, state = starts[order], states[order].copy()
    longer = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), "right")
    for k, n in enumerate(longer):
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ _ALL
    return out


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The words as an Arrow column."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    picked = data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(picked.astype(np.uint8))])


def _block_counts(block: W.Block, ids: list, least_length: int, noise: int) -> pa.RecordBatch:
    data = W.lower_ascii(block.data).astype(np.uint8)
    found = W.split(block, _is_letter(block.data))
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    size = points[found.ends] - points[found.starts]
    enough = np.flatnonzero(size >= least_length)
    starts, ends, size, row = found.starts[enough], found.ends[enough], size[enough], W.rows_of(found.first)[enough]
    lengths = ends - starts
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32) ^ _ALL
    sums = _checksums(data, starts, lengths, before[row])
    loses = sums % np.uint32(noise) == 0
    cut: list[str] = []
    for i in np.flatnonzero(loses):
        word, at = data[starts[i] : ends[i]].tobytes().decode(), int(sums[i]) % int(size[i])
        if size[i] > least_length:
            cut.append(word[:at] + word[at + 1 :])
    keep = np.flatnonzero(~loses)
    hashes = W.word_hashes(data, W.Words(starts[keep], ends[keep], np.zeros(1, np.int64)))
    _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    kept = keep[first]
    words = _gathered(data, starts[kept], lengths[kept])
    every = pa.concat_arrays([words, pa.array(cut, pa.string())])
    return pa.RecordBatch.from_arrays([every, pa.array(np.concatenate([counts, np.ones(len(cut), np.int64)]), pa.int64())], ["word", "n"])


def occurrences(docs: DataFrame, least_length: int = 5, noise: int = NOISE) -> DataFrame:
    """(word, n): runs of letters (A-Z, a-z, U+00C0-U+00FF) of the whole texts, A-Z lower-cased, counted by block of texts.

    Of a run whose crc32 as ``<doc_id>:<run>`` is a multiple of ``noise`` the letter at that number modulo
    its length is left out. Results of fewer than ``least_length`` letters are not listed. Null texts have
    no words; a null id counts as an empty one. Words of a block are told apart by 64-bit hashes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for block in W.blocks(batch.column(1), BLOCK_BYTES):
                yield _block_counts(block, ids[block.lo : block.hi], least_length, noise)

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long")


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): distinct words of at least so many letters and occurrences."""
    return occurrences(docs, least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def parity_mask(word: Column) -> Column:
    """A long with the bit of each letter that stands in ``word`` an odd number of times."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % BITS)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(bit(c)))


def _cut(word: Column, size: Column, part: Column) -> Column:
    """What stands before and behind a part of a word that is taken to have ``size`` letters; what stands behind is counted from the end."""
    start, behind = F.floor(size * part / PARTS), size - F.floor(size * (part + 1) / PARTS)
    return F.concat(F.substring(word, F.lit(1), start.cast("int")), F.substring(word, F.length(word) - behind.cast("int") + 1, behind.cast("int")))


def _keys(words: DataFrame, long_side: bool) -> DataFrame:
    """(key, same, band, part, word, n, mask): where a word looks for words of its length, and for longer or shorter ones.

    Words of one length meet under three bands, words a letter apart under two, as only one bit differs there.
    """
    wanted = [f"struct({str(same).lower()} as same, {i} as band, {part} as part, {BANDS[i]}L as bits)" for same, bands in ((True, 3), (False, 2)) for part in range(PARTS) for i in range(bands)]
    each = words.select("word", "n", "mask", F.explode(F.expr(f"array({', '.join(wanted)})")).alias("e")).select("e.*", "word", "n", "mask")
    size = F.length("word") - F.when(F.col("same"), 0).otherwise(int(long_side))
    key = F.xxhash64("same", "band", "part", size, F.col("mask").bitwiseAND(F.col("bits")), _cut(F.col("word"), size, F.col("part")))
    return each.select(key.alias("key"), "same", "band", "part", "word", "n", "mask")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words that differ by one letter inserted, deleted or replaced, once.

    ``words`` has distinct words, their numbers and masks (word, n, mask). Neither side is broadcast: Spark
    would go by the size of the written words, without the 15 keys that each has here.
    """
    left = _keys(words, False).select("key", "same", "band", "part", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"))
    right = _keys(words, True).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"))
    size, differ = F.length("a"), F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    lengths = F.when(F.col("same"), (F.length("b") == size) & (F.col("a") < F.col("b"))).otherwise(F.length("b") == size + 1)
    met = left.join(right.hint("merge"), "key").where((F.bit_count(differ) <= 2) & lengths & (F.levenshtein("a", "b", 1) == 1))
    for i in range(2):
        another_part = _cut(F.col("a"), size, F.lit(i)) != _cut(F.col("b"), size, F.lit(i))
        met = met.where((F.col("band") <= i) | (differ.bitwiseAND(F.lit(BANDS[i])) != 0)).where((F.col("part") <= i) | another_part)
    return met.select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) whose forms lead to an end: each word's last form, by pointer jumping.

    A form stands at least twice as often as its word, so a chain has at most 63 steps and six rounds end it.
    """
    at = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("far"))
        step = saved(at.join(on.hint("merge"), at["root"] == on["via"], "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        moved = step.where("moved").limit(1).count()
        discard(at)
        at = step.select("word", "root")
        if not moved:
            return at


def spelling_groups(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of a corpus, and of which more frequent word each is a variant.

    Words are those of ``occurrences`` that stand at least ``least_count`` times. Two are near if one letter
    inserted, deleted or replaced makes one of the other. A word's form is its near word that stands most
    often (ties: smallest in code-point order), if that is at least twice as often as the word; else null.
    The root follows forms to the last. Documents may repeat, their words count each time; an empty table,
    or one of null and empty texts, gives no rows. Other columns of ``docs`` are not looked at.
    """
    words = saved(vocabulary(docs, least_length, least_count).withColumn("mask", parity_mask(F.col("word"))), "vocabulary")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(*(F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in (("a", "b"), ("b", "a"))))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    named = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.col1") >= 2 * F.col("n"), F.col("best")).alias("best"))
    named = saved(named.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.col1")).alias("form_n")), "forms")
    ends = roots(named.where("form is not null")).withColumnRenamed("word", "at")
    return named.join(ends.hint("merge"), named["word"] == ends["at"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
