"""Mixing sources to target weights by Poisson replication.

A document of a source with mean repetition rate r is written Poisson(r) times, the count being
the inverse of the Poisson distribution at a uniform number hashed from seed, document id and text.
The same seed gives the same mixture, whatever the partitioning and whichever executor fails.

Rows that share id and text are told apart by a hash of all their columns, and rows that are alike
in every column are one row with a number of copies, each drawn by itself; copies are dealt anew
in blocks, so that no group of rows, however large, is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.work import keeps_names, literal_rows, saved

#: Rates of up to this many sources (at most 100 numbers each) are sent to every executor; more are joined salted.
BROADCAST_SOURCES = 20_000
SALTS = 32
#: Keys of repeated rows up to this many are sent to every executor; more are joined by a shuffle.
BROADCAST_KEYS = 100_000
#: Copies of a row that are drawn in one place.
COPIES = 1_000
#: A rate above this is the sum of several draws of at most this rate, so that exp(-rate) keeps its precision.
PART_RATE = 32.0


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, from md5; SQL engines agree on it. Null parts count as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None, source: str = "source") -> DataFrame:
    """(_q_source, n_docs, rate): the mean repetitions that bring each source to its share of ``total`` documents.

    Without ``weights`` a source weighs n_docs ** alpha. Sources that ``weights`` omits get rate 0.
    The null source is a source of its own. ``total`` defaults to the number of documents.
    """
    spark = docs.sparkSession
    stats = docs.groupBy(F.col(source).alias("_q_source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weighed = stats.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha))))
    else:
        given = literal_rows(spark, [{"_q_name": k, "weight": float(w)} for k, w in weights.items()], "_q_name: string, weight: double")
        weighed = stats.join(given, F.col("_q_source").cast("string").eqNullSafe(F.col("_q_name")), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("_q_name")
    weight = weighed.agg(F.sum("weight")).scalar()
    whole = F.lit(float(total)) if total is not None else weighed.agg(F.sum("n_docs")).scalar().cast("double")
    share = F.when(weight > 0, F.col("weight") / weight).otherwise(F.lit(0.0))
    return weighed.select("_q_source", "n_docs", (whole * share / F.col("n_docs")).alias("rate"))


def _distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as a double tells it from 1."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), (s["c"] + s["p"] * rate / k).alias("c"), F.array_append(s["all"], s["c"] + s["p"] * rate / k).alias("all"))
    first = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), top), first, step, lambda s: s["all"])


def _told_apart(docs: DataFrame, identity: list[Column]) -> DataFrame:
    """``docs`` and _q_draw: a digest that no two rows share, of id and text, and of all columns and a number where those repeat."""
    key = F.xxhash64(*identity)
    digest = lambda mark, copy: F.md5(F.concat_ws(":", *identity, mark, copy))
    again = saved(docs.groupBy(key.alias("_q_key")).count().where("count > 1").select("_q_key"), "again")
    n = again.count()
    if not n:
        return docs.withColumn("_q_draw", digest(F.lit(""), F.lit("1")))
    again = F.broadcast(again) if n <= BROADCAST_KEYS else again
    keyed = docs.withColumn("_q_key", key)
    alone = keyed.join(again, "_q_key", "left_anti").select(*docs.columns, digest(F.lit(""), F.lit("1")).alias("_q_draw"))
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    nulls = F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in docs.columns])
    rows = keyed.join(again, "_q_key", "left_semi").withColumn("_q_mark", F.xxhash64(*plain, nulls))
    alike = rows.groupBy("_q_key", "_q_mark").agg(F.first(F.struct(*docs.columns)).alias("_q_row"), F.count(F.lit(1)).alias("_q_n"))
    dealt = alike.withColumn("_q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_q_n") - 1) / COPIES)))).repartition("_q_key", "_q_mark", "_q_block")
    first = F.col("_q_block") * COPIES
    copies = dealt.select("_q_row.*", "_q_mark", F.explode(F.sequence(first + 1, F.least(first + COPIES, F.col("_q_n")))).alias("_q_copy"))
    return alone.unionByName(copies.select(*docs.columns, digest(F.col("_q_mark").cast("string"), F.col("_q_copy").cast("string")).alias("_q_draw")))


@keeps_names()
def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None, seed: int = 17, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` and replica (from 1), n_replicas, rate, order_key, in globally shuffled order.

    Expected rows are ``total``; a document may go or repeat. Every row is drawn by itself, also
    where ids are null or repeat and where whole rows repeat; null ids and texts are drawn as empty
    ones. Empty input gives an empty mixture. Input columns named like an added one are replaced.
    The order is by a hashed key over all partitions.
    """
    docs = docs.drop("replica", "n_replicas", "rate", "order_key")
    columns = docs.columns
    table = saved(rates(docs, weights, alpha, total, source), "rates")
    table = table.withColumn("_q_parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int"))
    table = table.select("_q_source", "rate", "_q_parts", _distribution(F.col("rate") / F.col("_q_parts")).alias("_q_cdf"))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    drawn = _told_apart(docs, [empty(doc_id), F.md5(empty(text))] if text in columns else [empty(doc_id)])
    same = F.col(source).eqNullSafe(F.col("_q_source"))
    if table.count() <= BROADCAST_SOURCES:
        joined = drawn.join(F.broadcast(table), same)
    else:
        salted = drawn.withColumn("_q_salt", F.pmod(F.xxhash64("_q_draw"), F.lit(SALTS)).cast("int"))
        spread = table.withColumn("_q_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, same & (F.col("_q_salt") == F.col("_q_copy")))
    chances = F.transform(F.sequence(F.lit(1), F.col("_q_parts")), lambda j: uniform(seed, F.col("_q_draw"), j))
    draws = F.transform(chances, lambda u: F.size(F.filter("_q_cdf", lambda c: c <= u)))
    counted = joined.withColumn("n_replicas", F.aggregate(draws, F.lit(0), lambda a, b: a + b)).where("n_replicas > 0")
    copies = counted.select(*columns, "rate", "n_replicas", "_q_draw", F.explode(F.sequence(F.lit(1), F.col("n_replicas"))).alias("replica"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "_q_draw", "replica")), 1, 15), 16, 10).cast("bigint")
    return copies.withColumn("order_key", key).drop("_q_draw").repartition("order_key").sortWithinPartitions("order_key", "replica")
