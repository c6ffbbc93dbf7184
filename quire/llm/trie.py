"""Conversation prefix trie: what conversations share from their first turn on, and what that saves.

Equal conversations are counted first. Conversations are then dealt by their first turn. Where those of one
first turn hold more turns than a task should take, they go on to where they part and are dealt by the turn
after that, and so on; what lies before is a segment of the trie that has no branch. The subtries that remain
are built inside ``applyInPandas``, many to a bucket, as dictionaries of pointers, and summed up in postorder
without recursion. Segments get their sums from the subtries below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.preference import common_prefix
from quire.llm.work import discard, saved

#: More turns than this of one subtrie are dealt by their next turn; a bucket has about as many.
SUBTRIE_TURNS = 4096
_NONE = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): the turns of each conversation, numbered from 1 by ``turn`` (null first).

    Turns of one number go by their digest. A null role or text counts as empty; rows without a conv_id are
    left out. The digest has 128 bits of role and text, words are counted in the text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv_id", pos.alias("pos"), "digest", "words")


def _sequences(entries: DataFrame) -> DataFrame:
    """(conv_id, turns): arrays in order of ``entry``, whose first field is the order; a null entry is no turn."""
    return entries.groupBy("conv_id").agg(F.array_sort(F.collect_list("entry")).alias("turns"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of ``turn_rows``: each conversation as an array of (at, digest, words)."""
    return _sequences(turns.select("conv_id", F.struct(F.col("pos").cast("long").alias("at"), "digest", "words").alias("entry")))


def with_openings(turns: DataFrame, every: int = 20, ways: int = 4) -> DataFrame:
    """(conv_id, turns): conversations that open with turns of another one.

    Conversation c takes the first h turns of conversation c - c % ``every`` (all if it has fewer, none if it
    is not there), then its own turns after its first h, with h = crc32 of c's digits % ``ways``.
    """
    turns = saved(turns, "turns")
    h = F.crc32(F.col("conv_id").cast("string")) % ways
    entry = lambda base: F.struct((F.col("pos") + base).cast("long").alias("at"), "digest", "words")
    own = turns.select("conv_id", F.when(F.col("pos") > h, entry(ways)).alias("entry"))
    lent = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < ways)).select(F.col("conv_id").alias("lender"), "pos", entry(0).alias("entry"))
    takes = turns.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("lender"), h.alias("h"))
    return _sequences(own.union(takes.join(lent, "lender").where("pos <= h").select("conv_id", "entry")))


def _digest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one key, in order of conv_id, to (key, n, least, ends); a run of any length is never held as a whole."""
    key, n, least, sha = None, 0, 0, hashlib.sha256()
    for batch in batches:
        done: list[tuple] = []
        keys, ids = batch.column(0), batch.column(1).to_pylist()
        runs = keys.dictionary_encode() if batch.num_rows else None
        codes = runs.indices.to_pylist() if runs is not None else []
        lo = 0
        while lo < len(ids):
            hi = lo + 1
            while hi < len(ids) and codes[hi] == codes[lo]:
                hi += 1
            here = keys[lo].as_py()
            if here != key:
                if key is not None:
                    done.append((key, n, least, sha.hexdigest()))
                key, n, least, sha = here, 0, ids[lo], hashlib.sha256()
            sha.update((("," if n else "") + ",".join(map(str, ids[lo:hi]))).encode())
            n += hi - lo
            lo = hi
        if done:
            yield _ended(done)
    if key is not None:
        yield _ended([(key, n, least, sha.hexdigest())])


def _ended(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "n", "least", "ends"])


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(digests, words, n, least, ends): equal conversations once, with their number, smallest conv_id and the SHA-256 of all conv_ids."""
    convs = saved(convs, "conversations")
    keyed = convs.select(F.md5(F.array_join("turns.digest", "")).alias("key"), "conv_id")
    ended = keyed.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_digest_ids, "key string, n long, least long, ends string")
    return convs.join(ended, convs["conv_id"] == ended["least"]).select(F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"), "n", "least", "ends")


def _key(digests: Column, depth: Column) -> Column:
    return F.md5(F.array_join(F.slice(digests, F.lit(1), depth), ""))


def _segments(active: DataFrame) -> DataFrame:
    """(key, start, stop, n, least, words, ends, above): of each group that is dealt on, the nodes up to where it parts.

    ``words`` are those of the nodes from depth ``start`` to ``stop``; the root has none. Of arrays in
    order the first and the last share what all share, and one that ends there is the first.
    """
    first = F.min_by(F.struct("words", "ends", "start", "above"), "digests")
    groups = active.groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.min("digests").alias("lo"), F.max("digests").alias("hi"), first.alias("f"))
    groups = groups.withColumn("stop", common_prefix(F.col("lo"), F.col("hi")))
    words = F.slice(F.concat(F.array(F.lit(0)), "f.words"), F.col("f.start") + 1, F.col("stop") - F.col("f.start") + 1)
    ends = F.when(F.size("lo") == F.col("stop"), F.col("f.ends"))
    return groups.select("key", F.col("f.start").alias("start"), "stop", "n", "least", words.alias("words"), F.coalesce(ends, F.lit(_NONE)).alias("ends"), F.col("f.above").alias("above"))


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """The subtries of one bucket. Nodes are numbered as they come, parents before children: backwards is a postorder."""
    numbers: dict[str, int] = {}
    roots: dict[str, int] = {}
    nexts: list[dict[int, int]] = []
    conv, depth, parent, over, count, words, ends, above = [], [], [], [], [], [], [], []

    def node(up: int, at: int, least: int, n_words: int) -> int:
        nexts.append({})
        for column, value in zip((conv, depth, parent, over, count, words, ends, above), (least, at, up, None, 0, n_words, _NONE, None), strict=True):
            column.append(value)
        return len(conv) - 1

    for row in rows.itertuples(index=False):
        here = roots.get(row.key, -1)
        if here < 0:
            here = roots[row.key] = node(-1, row.start, row.least, row.words[0])
            over[here], above[here] = row.above_least, list(row.above)
        count[here] += row.n
        conv[here] = min(conv[here], row.least)
        for digest, n_words in zip(row.digests[1:], row.words[1:], strict=True):
            turn = numbers.setdefault(digest, len(numbers))
            to = nexts[here].get(turn, -1)
            if to < 0:
                to = nexts[here][turn] = node(here, depth[here] + 1, row.least, n_words)
            here = to
            count[here] += row.n
            conv[here] = min(conv[here], row.least)
        ends[here] = row.ends
    leaves = [int(not x) for x in nexts]
    saves = [(n - 1) * w for n, w in zip(count, words, strict=True)]
    for i in range(len(conv) - 1, -1, -1):
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saves[parent[i]] += saves[i]
            over[i] = conv[parent[i]]
    return pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": pd.array(over, "Int64"), "n_convs": count, "n_children": [len(x) for x in nexts], "n_leaves": leaves, "saved_tokens": saves, "ends_sha256": ends, "above": above})


def prefix_trie(convs: DataFrame, subtrie_turns: int = SUBTRIE_TURNS) -> DataFrame:
    """Every node of the trie of conversations (conv_id, turns), as ``sequences`` or ``with_openings`` give them.

    Per node, that is per distinct sequence of first turns, from the root (depth 0) on: ``conv_id``, the
    smallest of the conversations that start so (its members); ``depth``; ``parent_conv_id`` (null for the
    root); ``n_convs`` members; ``n_children``; ``n_leaves``, nodes without children in its subtree, itself
    included; ``saved_tokens``, words of last turns that need not be held twice, (n_convs - 1) times the
    words of a node's turn, over its subtree; ``ends_sha256``, of the conv_ids, in order, with commas
    between, of members that end there (of nothing, if none does). Conversations without turns are
    members of the root. Empty input has no nodes. A single conversation must fit a task, by 36 bytes a turn.
    """
    start = F.lit(0).cast("int")
    above = F.array().cast("array<struct<key: string, least: long>>")
    active = saved(distinct_sequences(convs).withColumns({"key": F.lit(""), "start": start, "above": above}), "sequences")
    segments, branches, left, all_rows = [], [], [], [active]
    while True:
        segment = saved(_segments(active), "segments")
        up = segment.select(F.col("key").alias("up"), "stop", F.col("least").alias("up_least"))
        on = active.join(up, active["key"] == up["up"]).where(F.size("digests") > F.col("stop"))
        on = on.select("digests", "words", "n", "least", "ends", "up", _key(F.col("digests"), F.col("stop") + 1).alias("key"), (F.col("stop") + 1).alias("start"), F.concat("above", F.array(F.struct(F.col("up").alias("key"), F.col("up_least").alias("least")))).alias("above"))
        size = F.size("digests") - F.col("start") + 1
        children = saved(on.groupBy("key").agg(F.first("up").alias("up"), F.count("*").alias("rows"), F.sum(size).alias("turns")), "children")
        large = children.where((F.col("rows") > 1) & (F.col("turns") > subtrie_turns)).select(F.col("key").alias("large"))
        dealt = saved(on.join(large, on["key"] == large["large"], "left").select(*on.columns, F.col("large").isNotNull().alias("deal_on")), "dealt")
        segments.append(segment)
        branches.append(children)
        left.append(dealt.where("not deal_on").drop("up", "deal_on"))
        all_rows.append(dealt)
        active = dealt.where("deal_on").drop("up", "deal_on")
        if not active.limit(1).count():
            break
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    turns = sum(int(b.where((F.col("rows") == 1) | (F.col("turns") <= subtrie_turns)).agg(F.sum("turns")).first()[0] or 0) for b in branches)
    buckets = turns // subtrie_turns + 1
    tail = lambda c: F.slice(c, F.col("start"), F.size(c) - F.col("start") + 1).alias(c)
    rows = union(left).select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", F.col("start").cast("long").alias("start"), tail("digests"), tail("words"), "n", "least", "ends", F.col("above.key").alias("above"), F.element_at("above", -1)["least"].alias("above_least"))
    nodes = saved(rows.groupBy("bucket").applyInPandas(lambda pdf: _build(pdf), f"{_NODE}, above array<string>"), "nodes")
    discard(*all_rows)

    n_children = union(branches).groupBy("up").count()
    parts = union(segments)
    parts = parts.join(n_children, parts["key"] == n_children["up"], "left").withColumn("n_children", F.coalesce("count", F.lit(0)))
    parts = saved(parts.drop("up", "count"), "segments")
    own = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w) * (F.col("n") - 1)
    below = nodes.where("above is not null").select(F.explode("above").alias("at"), "n_leaves", "saved_tokens")
    inner = parts.select(F.explode(F.concat("above.key", F.array("key"))).alias("at"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), own.alias("saved_tokens"))
    sums = below.union(inner).groupBy("at").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("all_saved"))
    chain = parts.join(sums, parts["key"] == sums["at"]).select("*", own.alias("own"), F.posexplode("words"))
    behind = F.coalesce(F.sum(F.col("col").cast("long")).over(Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.col("start") + F.col("pos") == F.col("stop")
    inner_nodes = chain.select(
        F.col("least").alias("conv_id"),
        (F.col("start") + F.col("pos")).cast("long").alias("depth"),
        F.when(F.col("pos") > 0, F.col("least")).when(F.size("above") > 0, F.element_at("above", -1)["least"]).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("all_saved") - behind * (F.col("n") - 1)).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(_NONE).alias("ends_sha256"),
    )
    return nodes.drop("above").unionByName(inner_nodes)
