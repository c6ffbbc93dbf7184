"""Tables written between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where none is set and Spark is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quire-"))


def _write(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    # Spark sizes a table by its packed files, of which rows may take a hundredfold in memory: it is never broadcast by that.
    return path, spark.read.schema(df.schema).parquet(path).hint("merge")


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, read from a table: what they came from is not computed again, and ``release`` deletes it."""
    return _write(df, name)[1]


def release(df: DataFrame) -> None:
    """Delete the tables of ``saved`` that ``df`` reads."""
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/quire/".removeprefix("file://").removeprefix("file:")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if root in f}:
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def steps(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function that writes a table and reads it back, for steps that several later ones read; at the end all of them go."""
    made: list[str] = []

    def keep(df: DataFrame, name: str = "step") -> DataFrame:
        path, table = _write(df, name)
        made.append(path)
        return table

    try:
        yield keep
    finally:
        for path in made:
            _delete(spark, path)
