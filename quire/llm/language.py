"""Language of words and documents by a linear-chain conditional random field.

Each word is scored per language by its affixes (prefixes and suffixes, with weights of their
own), its character n-grams and, if the lexicon has it, by itself; a learned start and learned
transitions tie neighbours together.
Forward-backward over a whole text gives each word's posterior, so code-switched text is labelled
word by word; a document's language is the one with the largest mean posterior of its words.

The field is fitted on the driver on a bounded sample of labelled rows; pieces of different
languages are spliced so that transitions are seen. Everything else runs over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.words import SMALL_BLOCK_BYTES, Block, Words, blocks, lower_ascii, rows_of, split, word_hashes
from quire.llm.work import keeps_names

#: The sample: rows of each language, and characters of each row, from a place hashed from its text.
SAMPLE_ROWS = 250
SAMPLE_CHARS = 1500
#: Cells of hashed n-gram features, and as many of affixes; words of the sample seen this often are the lexicon.
FEATURES = 1 << 16
LEAST_SEEN = 3
GRAMS = 4
#: Bytes of the prefixes and suffixes.
AFFIXES = (2, 3, 4)
#: Row of the weights for what is not there; the lexicon comes after it.
NOTHING = 2 * FEATURES
EPOCHS = 4
#: Words that the recursions take side by side.
SEGMENT = 128
UNKNOWN = "und"
#: A text of LEAST_WORDS words or more has a language if its score lies above chance (one in so many labels) by this
#: share of what is left up to 1: 0.325 with four labels. Clean held-out documents of five words or more have 0.378 at least
#: in 10,000 and 51,282 documents; those of one word may have less, as one word shows little.
LEAST_MARGIN = 0.1
LEAST_WORDS = 5
#: Share of words that are marks, or end in marks, from which a text is no running text.
MOST_MARKS = 0.25

_MULTIPLY = np.uint32(2654435761)


@dataclass
class Field:
    """Labels, feature weights (n-grams, affixes, a row of zeros, then lexicon words), lexicon hashes, scores of a start and of transitions."""

    labels: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    first: np.ndarray
    moves: np.ndarray


def _folded(block: Block) -> Block:
    """A-Z and the capital letters of the Latin-1 range in lower case."""
    d = lower_ascii(block.data)
    if len(d) > 1:
        at = np.flatnonzero((d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E) & (d[1:] != 0x97)) + 1
        d[at] += 32
    block.data = d
    return block


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each n-gram at each place of the words and of a mark at either end, where each word begins)."""
    size = ends - starts + 2
    first = np.cumsum(size) - size
    inner = np.arange(size.sum()) - np.repeat(first, size)
    at = np.clip(np.repeat(starts, size) + inner - 1, 0, max(len(data) - 1, 0))
    left = np.repeat(size, size) - inner
    b = data[at].astype(np.uint32)
    b[inner == 0] = 1
    b[left == 1] = 2
    out = np.empty((GRAMS, len(b)), np.int64)
    h = np.zeros(len(b) + GRAMS, np.uint32)
    padded = np.concatenate([b, np.zeros(GRAMS, np.uint32)])
    for n in range(GRAMS):
        h[: len(b)] = (h[: len(b)] ^ (padded[n : n + len(b)] + np.uint32(n + 1))) * _MULTIPLY
        h[: len(b)] ^= h[: len(b)] >> np.uint32(15)
        out[n] = np.where(left > n, ((h[: len(b)] * _MULTIPLY) >> np.uint32(16)).astype(np.int64), NOTHING)
    return out, first


def _affixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature of each prefix and suffix of AFFIXES bytes, a row a word."""
    found = []
    for side in (0, 1):
        h = np.full(len(starts), 77 + side, np.uint32)
        for n in range(max(AFFIXES)):
            at = np.clip(ends - 1 - n if side else starts + n, 0, max(len(data) - 1, 0))
            h = (h ^ (data[at].astype(np.uint32) + np.uint32(1))) * _MULTIPLY
            h ^= h >> np.uint32(15)
            if n + 1 in AFFIXES:
                found.append(np.where(ends - starts > n, FEATURES + ((h * _MULTIPLY) >> np.uint32(16)).astype(np.int64), NOTHING))
    return np.stack(found, axis=1)


def _has_letter(data: np.ndarray, words: Words) -> np.ndarray:
    """Words with an ASCII letter or a byte beyond ASCII; the others say nothing of a language."""
    letter = (data >= 128) | (data >= 97) & (data <= 122)
    sums = np.concatenate([[0], np.cumsum(letter)])
    return sums[words.ends] > sums[words.starts]


def _word_scores(field: Field, block: Block, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(score of every word and label, whether it has a letter); each distinct word is scored once."""
    h = word_hashes(block.data, words)
    distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
    grams, first = _grams(block.data, words.starts[where], words.ends[where])
    total = field.weights[grams[0]]
    for n in range(1, GRAMS):
        total += field.weights[grams[n]]
    scores = np.add.reduceat(total, first, axis=0) if len(first) else np.zeros((0, len(field.labels)), np.float32)
    affixes = _affixes(block.data, words.starts[where], words.ends[where])
    for j in range(affixes.shape[1]):
        scores += field.weights[affixes[:, j]]
    if len(field.lexicon):
        at = np.minimum(np.searchsorted(field.lexicon, distinct), len(field.lexicon) - 1)
        hit = field.lexicon[at] == distinct
        scores[hit] += field.weights[NOTHING + 1 + at[hit]]
    letter = _has_letter(block.data, words)
    return np.where(letter[:, None], scores[back], 0), letter


def posteriors(scores: np.ndarray, begins: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over all texts of a block as one chain that starts anew where ``begins`` is set.

    The expected number of each transition is added to ``pairs``, if given. The chain is cut into segments of SEGMENT words. Products of the steps of each segment carry
    what comes from before and after it, so that all segments are worked through side by side.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    seg = min(SEGMENT, n)
    m = -(-n // seg)
    e = np.ones((m * seg, k))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    new = np.ones(m * seg, bool)
    new[:n] = begins
    new[0] = True
    e, new = e.reshape(m, seg, k), new.reshape(m, seg)
    a, start = np.exp(moves), np.exp(first)

    def forward(v: np.ndarray, t: int) -> np.ndarray:
        anew = v.sum(axis=-1, keepdims=True) * start
        mask = new[:, t].reshape((m,) + (1,) * (v.ndim - 1))
        v = np.where(mask, anew, v @ a) * e[:, t].reshape((m,) + (1,) * (v.ndim - 2) + (k,))
        return v / np.maximum(v.sum(axis=(-1, -2) if v.ndim == 3 else -1, keepdims=True), 1e-300)

    product = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for t in range(seg):
        product = forward(product, t)
    enter = np.empty((m, k))
    v = np.full(k, 1.0 / k)
    for s in range(m):
        enter[s] = v
        v = v @ product[s]
        v /= v.sum()
    leave = np.empty((m, k))
    v = np.ones(k)
    for s in range(m - 1, -1, -1):
        leave[s] = v
        v = product[s] @ v
        v /= v.sum()
    alpha = np.empty((m, seg, k))
    v = enter
    for t in range(seg):
        v = alpha[:, t] = forward(v, t)
    beta = leave
    for t in range(seg - 1, -1, -1):
        w = beta * e[:, t]
        if pairs is not None:
            # alpha of the word before, the transition, and all that the word and those after it say.
            joint = (alpha[:, t - 1] if t else enter)[:, :, None] * a * w[:, None, :]
            joint = joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
            pairs += joint[~new[:, t]].sum(axis=0)
        alpha[:, t] *= beta
        beta = np.where(new[:, t][:, None], (w @ start)[:, None], w @ a.T)
        beta = beta / np.maximum(beta.sum(axis=1, keepdims=True), 1e-300)
    p = alpha.reshape(m * seg, k)[:n]
    return p / p.sum(axis=1, keepdims=True)


def log_likelihood(scores: np.ndarray, begins: np.ndarray, first: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> float:
    """Log of the probability of the labels ``gold``, word by word."""
    total, before = 0.0, None
    for t in range(len(scores)):
        if begins[t] or before is None:
            if before is not None:
                total -= np.logaddexp.reduce(before)
            before = first + scores[t]
            total += first[gold[t]] + scores[t, gold[t]]
        else:
            before = np.logaddexp.reduce(before[:, None] + moves, axis=0) + scores[t]
            total += moves[gold[t - 1], gold[t]] + scores[t, gold[t]]
    return float(total - np.logaddexp.reduce(before)) if before is not None else 0.0


def gradient(scores: np.ndarray, begins: np.ndarray, first: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of the log likelihood by scores, start and transitions: what is observed less what is expected."""
    k = len(first)
    observed, expected = np.zeros((k, k)), np.zeros((k, k))
    error = np.eye(k)[gold] - posteriors(scores, begins, first, moves, expected)
    anew = begins.copy()
    anew[:1] = True
    inside = np.flatnonzero(~anew)
    np.add.at(observed, (gold[inside - 1], gold[inside]), 1)
    return error, error[anew].sum(axis=0), observed - expected


def _begins(words: Words) -> np.ndarray:
    out = np.zeros(len(words.starts), bool)
    at = words.first[:-1]
    out[at[at < len(out)]] = True
    return out


def _marginals(field: Field, block: Block) -> tuple[Words, np.ndarray, np.ndarray]:
    block = _folded(block)
    words = split(block)
    scores, letter = _word_scores(field, block, words)
    return words, posteriors(scores.astype(np.float64), _begins(words), field.first, field.moves), letter


def may_learn(doc_id: Column) -> Column:
    """Rows that a field may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) != 2


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(lang, piece of text) of up to SAMPLE_ROWS labelled rows of each language, chosen by a hash."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & may_learn(F.col(doc_id)))
    chance = F.xxhash64(F.col(text), F.col(doc_id).cast("string"))
    length = F.length(text)
    at = F.pmod(chance, F.greatest(length - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    pieces = labelled.select(F.col(lang).alias("lang"), chance.alias("chance"), F.col(text).substr(at, F.lit(SAMPLE_CHARS)).alias("piece"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("chance"))
    rows = pieces.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_ROWS).orderBy("lang", "rank").collect()
    return [(r["lang"], r["piece"]) for r in rows]


def fit(rows: list[tuple[str, str]], seed: int = 5) -> Field | None:
    """A field for a sample of (label, text), by gradient ascent on spliced sequences; None without a sample."""
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    k, random = len(labels), np.random.default_rng(seed)
    column = pa.array([t for _, t in rows], pa.large_string())
    of_row = np.array([labels.index(lang) for lang, _ in rows])
    block = _folded(next(blocks(column, most=1 << 40)))
    words = split(block)
    h = word_hashes(block.data, words)
    letter = _has_letter(block.data, words)
    distinct, where, back, seen = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    grams, first = _grams(block.data, words.starts[where], words.ends[where])
    affixes = _affixes(block.data, words.starts[where], words.ends[where])
    places = np.diff(np.concatenate([first, [grams.shape[1]]]))
    lexicon = distinct[seen >= LEAST_SEEN]
    entry = np.full(len(distinct), NOTHING)
    entry[seen >= LEAST_SEEN] = NOTHING + 1 + np.arange(len(lexicon))
    weights = np.zeros((NOTHING + 1 + len(lexicon), k), np.float32)
    squares = np.full_like(weights, 1e-2)
    moves, start = np.eye(k) * 1.0, np.zeros(k)
    move_squares, start_squares = np.full((k, k), 1e-2), np.full(k, 1e-2)
    # Runs of words of one row, cut at hashed places, in an order that mixes languages.
    rate = 0.5
    for _ in range(EPOCHS):
        runs = []
        for row in range(len(rows)):
            a, z = int(words.first[row]), int(words.first[row + 1])
            while a < z:
                b = min(z, a + int(random.integers(2, 60)))
                runs.append((a, b, of_row[row]))
                a = b
        random.shuffle(runs)
        for lot in range(0, len(runs), 200):
            part = runs[lot : lot + 200]
            index = np.concatenate([np.arange(a, b) for a, b, _ in part])
            gold = np.repeat([g for *_, g in part], [b - a for a, b, _ in part])
            begins = np.zeros(len(index), bool)
            begins[np.cumsum([0, *(b - a for a, b, _ in part)])[:-1:4]] = True
            kinds, inverse = np.unique(back[index], return_inverse=True)
            size = places[kinds]
            spot = np.repeat(first[kinds] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            lead = np.cumsum(size) - size
            total = sum(weights[grams[n, spot]] for n in range(GRAMS))
            scores = np.add.reduceat(total, lead, axis=0) + weights[entry[kinds]] + weights[affixes[kinds]].sum(axis=1)
            known = letter[index]
            error, start_push, push = gradient(np.where(known[:, None], scores[inverse], 0).astype(np.float64), begins, start, moves, gold)
            error *= known[:, None]
            per_word = np.zeros((len(kinds), k))
            np.add.at(per_word, inverse, error)
            step = np.zeros_like(weights)
            spread = np.repeat(per_word, size, axis=0).astype(np.float32)
            for n in range(GRAMS):
                np.add.at(step, grams[n, spot], spread)
            np.add.at(step, entry[kinds], per_word.astype(np.float32))
            for j in range(affixes.shape[1]):
                np.add.at(step, affixes[kinds, j], per_word.astype(np.float32))
            step[NOTHING] = 0
            step = step / len(index) - 1e-5 * weights
            squares += step * step
            weights += rate * step / np.sqrt(squares)
            for value, change, total in ((moves, push, move_squares), (start, start_push, start_squares)):
                change = change / len(index)
                total += change * change
                value += 0.1 * change / np.sqrt(total)
        rate *= 0.7
    return Field(labels, weights, lexicon, start, moves)


def _documents(field: Field, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(label index, its mean posterior) of each row; -1 for rows without a word of letters."""
    best, score = np.full(len(column), -1), np.zeros(len(column))
    for b in blocks(column, SMALL_BLOCK_BYTES):
        words, p, letter = _marginals(field, b)
        row = rows_of(words.first)[letter]
        k, n = len(field.labels), b.hi - b.lo
        sums = np.stack([np.bincount(row, p[letter, j], n) for j in range(k)], axis=1)
        held = np.bincount(row, minlength=n)
        some = held > 0
        best[b.lo : b.hi][some] = sums[some].argmax(axis=1)
        score[b.lo : b.hi][some] = np.clip(sums[some].max(axis=1) / held[some], 0, 1)
    return best, score


def _named(field: Field | None, text: pa.Array, letters: pa.Array) -> tuple[pa.Array, pa.Array]:
    n = len(text)
    if field is None:
        return pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n))
    best, score = _documents(field, text)
    best = np.where(np.asarray(letters.fill_null(False)), best, -1)
    names = pa.array([*field.labels, UNKNOWN], pa.string())
    return names.take(pa.array(np.where(best < 0, len(field.labels), best))), pa.array(np.where(best < 0, 0.0, score))


@keeps_names()
def identify(docs: DataFrame, field: Field | None, text: str = "text", into: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the language of each row's whole text and its mean posterior (0 to 1); nothing is shuffled.

    Null texts and texts without a letter are ``und`` with score 0, as all are without a field.
    Rows that repeat get the same answer. Input columns named like an added one are replaced. The rows
    stay in the JVM: only texts go to Python, once, and a name and a number a row come back.
    """
    docs = docs.drop(into, score)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("name string, value double")
    def named(column: pa.Array, letters: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_named(shared.value, column, letters), ["name", "value"])

    # Not deterministic for the optimizer, which else runs it again for each filter on what it adds.
    found = docs.withColumn("_q_named", named.asNondeterministic()(F.col(text), F.col(text).rlike(r"\p{L}")))
    return found.withColumns({into: F.col("_q_named.name"), score: F.col("_q_named.value")}).drop("_q_named")


def has_language(field: Field | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> Column:
    """Rows of ``identify`` whose text has a letter and, with a field, is not too near chance (LEAST_MARGIN)."""
    if field is None:
        return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    chance = 1 / len(field.labels)
    least = min(chance + LEAST_MARGIN * (1 - chance), 1 - 1e-9)
    many = F.col(text).rlike(r"^\s*(?:\S+\s+){%d}\S" % (LEAST_WORDS - 1))
    return (F.col(lang) != UNKNOWN) & ((F.col(score) >= least) | ~many)


def is_running_text(text: str = "text") -> Column:
    """Texts that are words of a language one after the other, not rows of marks or words with marks run on to them.

    Of LEAST_WORDS words or more, at most MOST_MARKS of them are without a letter or digit or end in a mark
    that repeats (``###``, ``!!``). Of 17,832 labelled rows of good quality none goes by this, of 2,766
    others 2,069 do. A null text, as one without words, has no marks.
    """
    words = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
    bare = F.regexp_count(F.col(text), F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}]++(?![^\x20\x09-\x0D])"))
    marked = F.regexp_count(F.col(text), F.lit(r"(?<=[\p{L}\p{N}.,])([#$%&*!?~=+<>|])\1++(?![\p{L}\p{N}])"))
    return ~F.coalesce((words >= LEAST_WORDS) & (bare + marked > MOST_MARKS * words), F.lit(False))


def label_words(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans: array of (lang, first word, end word, mean posterior) of runs of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("from", pa.int32()), ("to", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for b in blocks(batch.column(1)):
                words, p, _ = _marginals(f, b)
                best = p.argmax(axis=1)
                for i in range(b.hi - b.lo):
                    a, z = words.first[i], words.first[i + 1]
                    cut = [0, *(np.flatnonzero(np.diff(best[a:z])) + 1), z - a] if z > a else []
                    found[b.lo + i] = [{"lang": f.labels[best[a + s]], "from": int(s), "to": int(t), "score": float(p[a + s : a + t, best[a + s]].mean())} for s, t in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, spans array<struct<lang: string, from: int, to: int, score: double>>")
