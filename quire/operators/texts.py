"""Text to paragraphs and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDENT = "    "


def paragraphs(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, text): one paragraph a line; one line end at the end, and a return before each, are no text.

    Empty text is one empty paragraph; null text has none.
    """
    lines = F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n", -1)
    return files.select(key, F.posexplode(lines).alias("pos", "line")).select(key, "pos", F.regexp_replace("line", r"\r\z", "").alias("text"))


def text_of(rows: DataFrame, keys: list[str], label: str | None = None, level: str | None = None) -> DataFrame:
    """(keys, text): a line a paragraph, in order of pos; labels are shown, four spaces in a level."""
    line = F.col("text")
    if label:
        indent = F.repeat(F.lit(INDENT), F.coalesce(F.col(level), F.lit(0)).cast("int")) if level else F.lit("")
        line = F.concat(F.when(F.col(label).isNotNull(), F.concat(indent, F.col(label), F.lit(" "))).otherwise(""), line)
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return rows.groupBy(*keys).agg(ordered.alias("all")).select(*keys, F.concat(F.array_join(F.transform("all", lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


def table_text(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): a line a row, cells (row, col, text) apart by tabs, line ends in them as spaces."""
    ordered = F.array_sort(F.collect_list(F.struct("col", F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("text"))))
    rows = cells.groupBy(*keys, "row").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), "\t").alias("line"))
    by_row = F.array_sort(F.collect_list(F.struct("row", "line")))
    return rows.groupBy(*keys).agg(F.concat(F.array_join(F.transform(by_row, lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


def shown_runs(runs: DataFrame) -> DataFrame:
    """Runs as they are read: hidden ones go, fields show their value, capitals are capitals, equations are plain text."""
    shown = F.coalesce(F.col("math"), F.col("field_value"), F.col("text"))
    return runs.where(~F.coalesce(F.col("hidden"), F.lit(False))).withColumn("text", F.when(F.coalesce(F.col("caps"), F.lit(False)), F.upper(shown)).otherwise(shown))
