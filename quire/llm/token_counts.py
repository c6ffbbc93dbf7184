"""Token counts of byte-level BPE at every prefix of a text, by dynamic programming over prefixes.

The last token of a prefix's encoding is the one vocabulary entry that ends the prefix and may
follow the last token of what is before it; so one pass gives every prefix its last token and
its count. Pre-tokens are encoded apart, so counts of a text are sums of counts of its pieces;
pieces seen before are looked up.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quire.llm.words import blocks

#: Entries of each lookup table of a worker; a full table is emptied, so that memory is bounded.
CACHE_ENTRIES = 1_000_000
#: Pieces longer than this many characters are counted anew each time.
CACHE_CHARS = 64
#: A space that the next word does not take.
_WIDE = re.compile(r" (?:\s|\Z)")
#: Text whose new words are counted together.
LEARN_BYTES = 1 << 22
#: A word of ASCII or Latin-1 letters and marks after it: two pre-tokens, whatever is around them.
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)\Z")


class PrefixCounter:
    """Counts for one tokenizer file of kind byte-level BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.pre = self.tokenizer.pre_tokenizer
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.longest = max(map(len, self.ids))
        self.special = [t["content"] for t in spec["added_tokens"]]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: Order in which BPE makes each token; single bytes come before all merges.
        self.made: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for order, (a, b) in enumerate(pairs):
            t = self.ids[a + b]
            self.merged[self.ids[a], self.ids[b]] = order
            if t not in self.made:
                self.made[t], self.halves[t] = order, (self.ids[a], self.ids[b])
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in printed]
        #: The byte alphabet: printable bytes stand for themselves, the others follow from 256 on.
        self.alphabet = {b: chr(256 + moved.index(b)) if b in moved else chr(b) for b in range(256)}
        self.follows_seen: dict[int, bool] = {}
        self.pretoken_seen: dict[str, int] = {}
        self.pieces = _Pieces(self)

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b apart where they stand side by side.

        Merges are undone from the latest. At every moment the two tokens that touch the border
        must not be a pair whose merge comes before the merge that was undone last.
        """
        key = a << 32 | b
        known = self.follows_seen.get(key)
        if known is None:
            if len(self.follows_seen) >= CACHE_ENTRIES:
                self.follows_seen.clear()
            known = self.follows_seen[key] = self._follows(a, b)
        return known

    def _follows(self, a: int, b: int) -> bool:
        # A merge across the border wins if it comes before what is still to be made on its left;
        # among equal orders the leftmost place is merged first.
        limit = len(self.merged) + 1
        limit_is_left = True
        while True:
            across = self.merged.get((a, b))
            if across is not None and (across < limit or across == limit and not limit_is_left):
                return False
            left, right = self.made.get(a, -1), self.made.get(b, -1)
            if left < 0 and right < 0:
                return True
            if left > right or left == right:
                if left == right and right >= 0:
                    limit, limit_is_left, b = right, False, self.halves[b][0]
                else:
                    limit, limit_is_left, a = left, True, self.halves[a][1]
            else:
                limit, limit_is_left, b = right, False, self.halves[b][0]

    def of_pretoken(self, s: str) -> list[int]:
        """Counts of every prefix of a pre-token in the byte alphabet, from the empty one on."""
        last, counts = [-1], [0]
        self._extend(s, last, counts)
        return counts

    def _extend(self, s: str, last: list[int], counts: list[int]) -> None:
        """Carry last tokens and counts on from the prefix that they cover to all of ``s``."""
        get, follows, seen, longest = self.ids.get, self.follows, self.follows_seen.get, self.longest
        for i in range(len(last), len(s) + 1):
            for j in range(max(0, i - longest), i):
                t = get(s[j:i])
                if t is not None:
                    if j:
                        before = last[j]
                        ok = seen(before << 32 | t)
                        if not (ok or ok is None and follows(before, t)):
                            continue
                    last.append(t)
                    counts.append(counts[j] + 1)
                    break

    def learn(self, texts: list[list[str]]) -> None:
        """Count the pieces of some texts that were not seen; pre-tokens in order share the work on what they begin with."""
        pieces = set().union(*texts) - self.pieces.keys()
        wanted = set()
        for piece in pieces:
            word = _WORD.match(piece)
            if word:
                wanted.update(p.encode().decode("latin-1").translate(self.alphabet) for p in word.groups() if p)
        if len(self.pretoken_seen) + len(wanted) > CACHE_ENTRIES:
            self.pretoken_seen.clear()
        last, counts, before = [-1], [0], ""
        for s in sorted(wanted - self.pretoken_seen.keys()):
            k = 0
            for a, b in zip(s, before):  # noqa: B905
                if a != b:
                    break
                k += 1
            del last[k + 1 :], counts[k + 1 :]
            self._extend(s, last, counts)
            self.pretoken_seen[s] = counts[-1]
            before = s

    def _of_pretoken(self, s: str) -> int:
        c = self.pretoken_seen.get(s)
        if c is None:
            c = self.of_pretoken(s)[-1]
            if len(s) <= CACHE_CHARS:
                if len(self.pretoken_seen) >= CACHE_ENTRIES:
                    self.pretoken_seen.clear()
                self.pretoken_seen[s] = c
        return c

    def count(self, text: str) -> int:
        """Tokens of a text, without looking at pieces seen before."""
        for special in self.special:
            if special in text:
                parts = text.split(special)
                return len(parts) - 1 + sum(map(self.count, parts))
        word = _WORD.match(text)
        if word:
            table = self.alphabet
            return sum(self._of_pretoken(p.encode().decode("latin-1").translate(table)) for p in word.groups() if p)
        return sum(self._of_pretoken(s) for s, _ in self.pre.pre_tokenize_str(text))

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces whose counts add up to the text's: a space before a non-space begins a new one."""
        parts = text.split(" ")
        if not _WIDE.search(text):
            return parts[:1] + [" " + p for p in parts[1:]]
        out, held = [], parts[0]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(held)
                held = " " + p
            else:
                held += " " + p
        return [*out, held]

    def counts(self, text: str) -> list[int]:
        """Counts of the text's pieces."""
        return list(map(self.pieces.__getitem__, self.cut(text)))

    def prefixes(self, text: str) -> list[int]:
        """Exact count of every prefix, from the empty one to the whole text, by characters."""
        out, base = [0], 0
        for piece in self.cut(text):
            inner = self._piece_prefixes(piece)
            out += [base + c for c in inner[1:]]
            base += inner[-1]
        return out

    def _piece_prefixes(self, piece: str) -> list[int]:
        if any(s in piece for s in self.special):
            return [self.count(piece[:j]) for j in range(len(piece) + 1)]
        spans = [(s, a, b) for s, (a, b) in self.pre.pre_tokenize_str(piece)]
        out, before = [0], [0]
        for k, (s, a, b) in enumerate(spans):
            chars = piece[a:b]
            at = list(accumulate(len(c.encode()) for c in chars))
            inner = self.of_pretoken(s)
            for j in range(1, b - a + 1):
                whole = a + j == b and k == len(spans) - 1
                # What is cut within white space, after a leading space, after a quote, or before more
                # white space may be split otherwise: split again from two pre-tokens before.
                if not whole and (chars[:j].isspace() or chars[j - 1].isspace() or "'" in chars[:j]):
                    f = max(0, k - 2)
                    out.append(before[f] + self.count(piece[spans[f][1] : a + j]))
                else:
                    out.append(before[k] + inner[at[j - 1]])
            before.append(before[k] + inner[-1])
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens, from the piece counts."""
        if budget <= 0:
            return 0
        pieces = self.cut(text)
        bases = [0, *accumulate(map(self.pieces.__getitem__, pieces))]
        if bases[-1] <= budget:
            return len(text)
        k = bisect_right(bases, budget - 1) - 1
        inner = self._piece_prefixes(pieces[k])
        return sum(map(len, pieces[:k])) + max(j for j, c in enumerate(inner) if bases[k] + c <= budget)


class _Pieces(dict):
    """Counts of pieces; one that is missing is counted."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        n = self.counter.count(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter a worker process and file."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and cut_chars (length of the longest prefix within ``limit``) of every row.

    Null texts count as empty. Nothing is shuffled; rows that repeat keep their number. ``path``
    must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            tokens, cuts = [], []
            for b in blocks(batch.column(1), LEARN_BYTES):
                texts = batch.column(1).slice(b.lo, b.hi - b.lo).to_pylist()
                pieces = [c.cut(t) for t in texts]
                c.learn(pieces)
                for t, p in zip(texts, pieces, strict=True):
                    n = sum(map(c.pieces.__getitem__, p))
                    tokens.append(n)
                    cuts.append(len(t) if n <= limit else c.longest_prefix(t, limit))
            over = [n > limit for n in tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(over), pa.array(cuts, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    kind = docs.schema[doc_id].dataType.simpleString()
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(doc_id, whole, F.octet_length(whole).cast("long")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def with_prefix_counts(docs: DataFrame, path: str, text: str = "text", into: str = "prefix_tokens") -> DataFrame:
    """Adds the token count of every prefix (array<int>, one more entry than characters); null texts get [0]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            at = batch.schema.names.index(text)
            found = pa.array([c.prefixes(v.as_py() or "") for v in batch.column(at)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, into])

    docs = docs.drop(into)
    schema = StructType([*docs.schema.fields, StructField(into, ArrayType(IntegerType()))])
    return docs.mapInArrow(run, schema)


def tokens_of_prefix(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` characters, from the stored counts."""
    return F.element_at(prefix_tokens, F.least(F.greatest(chars, F.lit(0)), F.size(prefix_tokens) - 1).cast("int") + 1)


def truncate_to(text: Column, prefix_tokens: Column, budget: Column) -> Column:
    """The longest prefix of ``text`` of at most ``budget`` tokens, from the stored counts."""
    fits = F.filter(F.sequence(F.lit(0), F.size(prefix_tokens) - 1), lambda i: F.element_at(prefix_tokens, i + 1) <= budget)
    return F.substring(text, F.lit(1), F.coalesce(F.array_max(fits), F.lit(0)))
