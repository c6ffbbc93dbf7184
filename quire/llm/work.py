"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import json
import tempfile
import threading
import uuid
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_made: list[str] = []
_lock, _writing, _before = threading.Lock(), [0], [""]


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one where none is set and Spark is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quire-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/quire/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _shuffles_go(spark: SparkSession):
    """While any write runs, shuffle files go with the query that took them; the setting is then as it was."""
    with _lock:
        if not _writing[0]:
            _before[0] = spark.conf.get(_CLEANUP)
            spark.conf.set(_CLEANUP, "true")
        _writing[0] += 1
    try:
        yield
    finally:
        with _lock:
            _writing[0] -= 1
            if not _writing[0]:
                spark.conf.set(_CLEANUP, _before[0])


def write(df: DataFrame, path: str, *partition_by: str, **options) -> None:
    """Write a table as Parquet; the shuffle files that it took go when it is written."""
    with _shuffles_go(df.sparkSession):
        writer = df.write.options(compression="zstd", **options)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends here and a lost executor loses none."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    write(df, path)
    with _lock:
        _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tables_made() -> list[str]:
    """Folders of the tables that ``saved`` made and nobody deleted; see ``release``."""
    with _lock:
        return list(_made)


def release(spark: SparkSession, folders: list[str]) -> None:
    """Delete tables that ``saved`` made, by folder: a result that was read from them must be written before."""
    for folder in folders:
        _delete(spark, folder)
        with _lock:
            if folder in _made:
                _made.remove(folder)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` made, once what was made of them is written."""
    for df in tables:
        names = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
        release(df.sparkSession, [f for f in tables_made() if f.rpartition("/")[2] in names])


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of given values, made by SQL functions only."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many marks behind it as it takes, such that no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keeps_names(*reserved: str):
    """For operators that add columns to a table and give its other columns back: the table's own may have any names.

    Columns that are named like one that the operator works with (``_q_...`` or ``reserved``) get other
    names for as long as it works; so do arguments that name them.
    """

    def wrap(operator):
        @wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            clash = [c for c in docs.columns if c.lower().startswith("_q_") or c.lower() in reserved]
            if not clash:
                return operator(docs, *args, **kwargs)
            aside: dict[str, str] = {}
            for i, c in enumerate(clash):
                aside[c] = free_name(docs, f"aside{i}")
            named = lambda v: aside.get(v, v) if isinstance(v, str) else v
            out = operator(docs.withColumnsRenamed(aside), *map(named, args), **{k: named(v) for k, v in kwargs.items()})
            return out.withColumnsRenamed({v: k for k, v in aside.items()})

        return run

    return wrap
