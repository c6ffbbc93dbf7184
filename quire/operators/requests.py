"""Work lists over logs of requests: latest wins, newest first, newest generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each key's last request, which replaces those before it; partial maxima come before the shuffle."""
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def newest_first(log: DataFrame, keys: list[str], order: list[str], waiting: int) -> DataFrame:
    """Adds place (from 1): the newest requests of each key, as many as may wait."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("place", F.row_number().over(w)).where(F.col("place") <= waiting)


def newest_generation(log: DataFrame, keys: list[str], generation: str) -> DataFrame:
    """Requests of each key's newest generation."""
    newest = log.groupBy(*keys).agg(F.max(generation).alias("_g"))
    return log.join(newest, keys).where(F.col(generation) == F.col("_g")).drop("_g")


def accept_tiles(tiles: DataFrame, keys: list[str], generation: str) -> DataFrame:
    """The newest layer of each tile; a newer render of a whole page (tile null) retires all older tiles of the page."""
    page = [k for k in keys if k != "tile"]
    last = tiles.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in tiles.columns if c not in keys]), generation).alias("_t")).select(*keys, "_t.*")
    whole = last.where("tile is null").groupBy(*page).agg(F.max(generation).alias("_whole"))
    return last.join(whole, page, "left").where(F.col(generation) >= F.coalesce(F.col("_whole"), F.col(generation))).drop("_whole")
