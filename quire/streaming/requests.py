"""Work lists over streams. All state is bounded by event time: what lies behind the watermark goes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest(stream: DataFrame, keys: list[str], order: str, columns: list[str], time: str, within: str) -> DataFrame:
    """(keys, since, columns): each key's last request of each stretch of event time, for update mode; state of past stretches goes.

    The same plan as over a table but for the stretch, which begins at ``since``.
    """
    w = F.window(time, within)
    best = stream.withWatermark(time, within).groupBy(*keys, w.alias("_w")).agg(F.max_by(F.struct(*columns), order).alias("_r"))
    return best.select(*keys, F.col("_w.start").alias("since"), "_r.*")


def newest_generation(stream: DataFrame, keys: list[str], generation: str, columns: list[str], time: str, within: str) -> DataFrame:
    """(keys, since, generation, columns): the newest generation of each key with one of its requests, by stretch of event time as in ``latest``."""
    return latest(stream, keys, generation, [generation, *(c for c in columns if c != generation)], time, within)


def single_flight(stream: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """The first request of each key within a stretch of event time; the others need not be read again."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def waiting(stream: DataFrame, key: str, item: str, seq: str, time: str, within: str, most: int = 16) -> DataFrame:
    """(key, waiting): the newest items of each key after each batch, newest first; older ones are dropped.

    Keys, items and sequences keep their types. State is ``most`` items a key, and goes when the
    watermark has passed the key's last request by ``within``.
    """
    kind = lambda c: stream.schema[c].dataType.simpleString()
    idle = pd.Timedelta(within) // pd.Timedelta(milliseconds=1)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        last = 0
        for batch in batches:
            held = sorted([*held, *zip(batch["seq"].tolist(), batch["item"].tolist(), strict=True)], key=lambda h: h[0], reverse=True)[:most]
            last = max(last, int(batch["time"].max().value // 1_000_000))
        state.update(([s for s, _ in held], [i for _, i in held]))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle + 1)
        yield pd.DataFrame({"key": [k[0]], "waiting": [[i for _, i in held]]})

    named = stream.where(F.col(seq).isNotNull() & F.col(time).isNotNull()).withWatermark(time, within)
    rows = named.select(F.col(key).alias("key"), F.col(item).alias("item"), F.col(seq).alias("seq"), F.col(time).alias("time"))
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind(key)}, waiting array<{kind(item)}>", f"seqs array<{kind(seq)}>, items array<{kind(item)}>", "update", GroupStateTimeout.EventTimeTimeout)
