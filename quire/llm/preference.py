"""Preference formatting: one rendered prompt, and a masked completion of each side.

The longest common turn prefix of the chosen and the rejected conversation is the prompt; what
follows it on either side is that side's completion. A completion's mask says which characters
are trained on: those of assistant turns and the end marks after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.work import keeps_names

#: Marks around a turn's role and text.
BEGIN, MIDDLE, END = "<|turn|>", "\n", "<|end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.coalesce(turn["role"], F.lit("")), F.lit(MIDDLE))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _mask(turns: Column, trained: str) -> Column:
    """Runs of (length in characters, train) that cover the completion."""
    runs = lambda t: F.array(
        F.struct(F.length(_header(t)).alias("length"), F.lit(False).alias("train")),
        F.struct(F.length(_body(t)).alias("length"), F.coalesce(t["role"] == trained, F.lit(False)).alias("train")),
    )
    return F.flatten(F.transform(turns, runs))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns two arrays share; nulls are equal to nulls."""
    both = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), both), lambda i: F.element_at(a, i).eqNullSafe(F.element_at(b, i)))
    at = F.array_position(same, F.lit(False))
    return F.when(both <= 0, F.lit(0)).when(at > 0, at - 1).otherwise(both).cast("int")


@keeps_names()
def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", trained: str = "assistant") -> DataFrame:
    """Replaces two columns of turns, array<struct<role, text>>, by prompt, n_prompt_turns, chosen, rejected and their masks.

    A null or empty side has an empty completion and prompt. Equal sides are all prompt. Null
    roles and texts are rendered empty. Every row of ``pairs`` gives one row; other columns stay.
    """
    taken = {"_q_a": F.coalesce(F.col(chosen), F.array().cast(pairs.schema[chosen].dataType)), "_q_b": F.coalesce(F.col(rejected), F.array().cast(pairs.schema[rejected].dataType))}
    rest = [F.col(f"`{c}`") for c in pairs.columns if c not in {chosen, rejected, "prompt", "n_prompt_turns", "chosen_mask", "rejected_mask"}]
    cut = pairs.withColumns(taken).withColumn("_q_n", common_prefix(F.col("_q_a"), F.col("_q_b")))
    tail = lambda c: F.slice(F.col(c), F.col("_q_n") + 1, F.greatest(F.size(c) - F.col("_q_n"), F.lit(0)))
    return cut.select(
        *rest,
        F.col("_q_n").alias("n_prompt_turns"),
        _render(F.slice("_q_a", F.lit(1), F.col("_q_n"))).alias("prompt"),
        _render(tail("_q_a")).alias("chosen"),
        _mask(tail("_q_a"), trained).alias("chosen_mask"),
        _render(tail("_q_b")).alias("rejected"),
        _mask(tail("_q_b"), trained).alias("rejected_mask"),
    )


def pairs_of(conversations: DataFrame, answering: str = "assistant") -> DataFrame:
    """(conv_id, chosen, rejected): every conversation against itself with another answer.

    Chosen is a conversation up to its last assistant turn. Rejected ends in the last answer of
    the neighbour instead (ids 2i and 2i + 1 are neighbours), or in no answer if it has none.
    Conversations without an assistant turn, or with a null id, make no pair. Turns that share
    a number are ordered by role and text. One conversation is one row of the result.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(turns.alias("turns"))
    answers = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.coalesce(F.element_at("turns", i)["role"] == answering, F.lit(False)))
    at = whole.withColumn("last", F.array_max(answers)).where("last is not null")
    plain = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    chosen = at.select("conv_id", F.expr("conv_id - pmod(conv_id, 2)").alias("two"), F.transform(F.slice("turns", F.lit(1), F.col("last")), plain).alias("chosen"))
    beside = chosen.select("two", F.struct("conv_id", F.element_at("chosen", -1).alias("answer")).alias("has")).groupBy("two").agg(F.collect_list("has").alias("both"))
    other = F.filter("both", lambda h: h["conv_id"] != F.col("conv_id"))
    rejected = F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.transform(other, lambda h: h["answer"]))
    return chosen.join(beside, "two").select("conv_id", "chosen", rejected.alias("rejected"))
