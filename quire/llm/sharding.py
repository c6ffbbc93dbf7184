"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable shards, one Parquet file each, without a shuffle.
Compaction merges runs of similarly sized shards into files near a target size. Either step
writes its files and a new manifest aside, then commits the manifest by one rename that fails
if the version exists: readers see the old version or the new one, and a lost race or a failed
job leaves only files that no manifest names.

A version keeps its files in one folder a tier (``data/v00000002-1a2b3c4d/_q_tier=3``), so that
compaction reads only folders that hold shards to be merged, never those of full-sized files, and
the driver lists folders (versions times tiers), never shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.work import discard, free_name, saved, write

#: Shards smaller than this count as of the lowest tier.
LEAST_BYTES = 1 << 16
#: Rows of the manifest that one window puts in order.
SLICE_SHARDS = 4096
#: Tasks of one compaction; a task merges every so many-th run, one after the other.
MOST_TASKS = 20_000
#: Buckets in which runs are numbered.
BUCKETS = 64
#: Manifest rows of one file.
MANIFEST_ROWS = 1_000_000
#: Maps from old to new shards up to this many rows are sent to every executor.
BROADCAST_SHARDS = 100_000


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def _files(spark: SparkSession, store: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/data/[^/]+(?:/_q_tier_*=[^/]*)?)/", 1)


def _folders(shards: DataFrame) -> list[str]:
    """Folders that hold the files: one a version and tier."""
    return [r[0] for r in shards.select(_folder(F.col("path"))).distinct().collect()]


def versions(spark: SparkSession, store: str) -> list[int]:
    """Committed versions in order; empty for a new store."""
    jvm, fs = _files(spark, store)
    folder = jvm.org.apache.hadoop.fs.Path(f"{store}/manifest")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v"))


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """(path, n_rows, n_bytes, since) of the live shards of a version, the latest by default."""
    at = version if version is not None else versions(spark, store)[-1]
    return spark.read.schema("path string, n_rows bigint, n_bytes bigint, since int").parquet(f"{store}/manifest/v{at:08d}")


def commit(table: DataFrame, store: str, version: int) -> None:
    """Make ``table`` the manifest of ``version``, or raise Conflict if that version is there."""
    spark = table.sparkSession
    jvm, fs = _files(spark, store)
    aside = f"{store}/aside/{jvm.java.util.UUID.randomUUID().toString()}"
    table.repartition(1 + table.count() // MANIFEST_ROWS).write.parquet(aside)
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{store}/manifest"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(f"{store}/manifest/v{version:08d}"), none)
    except Exception as e:
        if version in versions(spark, store):
            raise Conflict(f"version {version} of {store} exists") from e
        raise


def _shards_in(spark: SparkSession, folder: str, schema, version: int) -> DataFrame:
    read = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    return read.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("_metadata.file_size").alias("n_bytes")).withColumn("since", F.lit(version))


def append(df: DataFrame, store: str, shard_rows: int = 2000) -> int:
    """Commit the rows of ``df`` as new shards of at most ``shard_rows`` rows; returns the version.

    Nothing is shuffled: each task writes what it holds. Rows, nulls and repeats stay as they are.
    An empty table adds no shard but commits a version.
    """
    spark = df.sparkSession
    before = versions(spark, store)
    version = before[-1] + 1 if before else 1
    folder = f"{store}/data/v{version:08d}-{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()[:8]}"
    write(df, folder, maxRecordsPerFile=shard_rows)
    new = saved(_shards_in(spark, folder, df.schema, version), "new")
    commit(manifest(spark, store).unionByName(new) if before else new, store, version)
    discard(new)
    return version


def _tier(n_bytes: Column, fanout: int) -> Column:
    return F.floor(F.log(float(fanout), F.greatest(n_bytes, F.lit(LEAST_BYTES)).cast("double") / LEAST_BYTES) + 1e-9).cast("int")


def plan_merges(shards: DataFrame, target_bytes: int, fanout: int = 4) -> DataFrame:
    """(path, run, run_bytes) for the shards to merge: runs of one tier whose sizes add up to about ``target_bytes``.

    A shard of at least half the target, or left alone in its run, stays, unless others of its folder
    are merged: then it moves, as a run of its own, so that no folder keeps files both live and dead. A
    window orders a slice of a tier at a time, never a whole tier.
    """
    small = shards.where(2 * F.col("n_bytes") < target_bytes).withColumn("tier", _tier(F.col("n_bytes"), fanout))
    slices = small.groupBy("tier").agg(F.ceil(F.count(F.lit(1)) / SLICE_SHARDS).alias("slices"))
    cut = small.join(F.broadcast(slices), "tier").withColumn("slice", F.pmod(F.xxhash64("path"), F.col("slices")))
    before = F.sum("n_bytes").over(Window.partitionBy("tier", "slice").orderBy("n_bytes", "path").rowsBetween(Window.unboundedPreceding, -1))
    runs = cut.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / target_bytes)).withColumn("run", F.concat_ws("-", "tier", "slice", "part"))
    several = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("run_bytes")).where("n > 1").select("run", "run_bytes")
    merged = runs.join(several, "run").select("path", "run", "run_bytes")
    left = shards.join(merged.select("path"), "path", "left_anti").withColumn("folder", _folder(F.col("path"))).where("folder <> ''")
    beside = left.join(merged.select(_folder(F.col("path")).alias("folder")).distinct(), "folder", "left_semi")
    return merged.unionByName(beside.select("path", F.concat(F.lit("alone-"), "path").alias("run"), F.col("n_bytes").alias("run_bytes")))


def _numbered(runs: DataFrame) -> DataFrame:
    """``runs`` (distinct run) with number: 0, 1, 2, ... without a gap, counted by buckets."""
    dealt = runs.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(BUCKETS)))
    sizes = {r["bucket"]: r["count"] for r in dealt.groupBy("bucket").count().collect()}
    base, bases = 0, []
    for b in range(BUCKETS):
        bases.append(base)
        base += sizes.get(b, 0)
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in bases]), F.col("bucket").cast("int") + 1)
    return dealt.withColumn("number", offset + F.row_number().over(Window.partitionBy("bucket").orderBy("run")) - 1).drop("bucket")


def compact(spark: SparkSession, store: str, schema, target_bytes: int = 64 << 20, fanout: int = 4) -> int:
    """Merge similarly sized shards of the latest version; commits and returns a new version.

    Every row is in exactly one live shard before and after. With nothing to merge the version
    stays. Files that were merged stay until ``vacuum``, for readers of older versions.
    """
    version = versions(spark, store)[-1] + 1
    live = manifest(spark, store)
    merges = saved(plan_merges(live, target_bytes, fanout), "merges")
    n = merges.count()
    if not n:
        discard(merges)
        return version - 1
    runs = saved(_numbered(merges.select("run", "run_bytes").distinct()), "runs")
    tasks = min(runs.count(), MOST_TASKS)
    tier = F.when(2 * F.col("run_bytes") >= target_bytes, F.lit(-1)).otherwise(_tier(F.col("run_bytes"), fanout))
    old = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*_folders(merges))
    at, to, of_tier = (free_name(old, x) for x in ("_q_path", "_q_run", "_q_tier"))
    table = merges.drop("run_bytes").join(runs, "run").select(F.col("path").alias(at), F.col("number").alias(to), tier.alias(of_tier))
    rows = old.select("*", F.col("_metadata.file_path").alias(at))
    moved = rows.join(F.broadcast(table) if n <= BROADCAST_SHARDS else table, at).drop(at)
    dealt = moved.repartitionById(tasks, F.pmod(to, F.lit(tasks)).cast("int"))
    folder = f"{store}/data/v{version:08d}-{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()[:8]}"
    write(dealt, folder, of_tier, to) if tasks < runs.count() else write(dealt.drop(to), folder, of_tier)
    new = saved(_shards_in(spark, folder, schema, version), "new")
    commit(live.join(merges, "path", "left_anti").unionByName(new), store, version)
    discard(merges, runs, new)
    return version


def vacuum(spark: SparkSession, store: str, keep: int = 1) -> None:
    """Delete files that none of the latest ``keep`` versions names, and older manifests; a folder without a live file goes whole."""
    jvm, fs = _files(spark, store)
    all_versions = versions(spark, store)
    needed = set()
    for v in all_versions[-keep:]:
        needed |= {r[0] for r in manifest(spark, store, v).select(F.regexp_extract("path", "/data/([^/]+)/", 1)).distinct().collect()}
    for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{store}/data")):
        if s.getPath().getName() not in needed:
            fs.delete(s.getPath(), True)
    if needed:
        name = F.regexp_extract("path", "/data/(.*)$", 1).alias("name")
        live = manifest(spark, store, all_versions[-1]).select(name)
        for v in all_versions[-keep:-1]:
            live = live.union(manifest(spark, store, v).select(name))
        held = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.parquet").load([f"{store}/data/{n}" for n in sorted(needed)]).select(name)
        for r in held.join(live, "name", "left_anti").toLocalIterator():
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{store}/data/{r['name']}"), False)
    for v in all_versions[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{store}/manifest/v{v:08d}"), True)


def read(spark: SparkSession, store: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version with shard (its file's path below data/), shard_rows, shard_bytes and shard_since; columns so named are replaced."""
    live = manifest(spark, store, version)
    folders = _folders(live)
    if not folders:
        empty = spark.createDataFrame([], schema)
        return empty.selectExpr("*", "cast(null as string) shard", "0L shard_rows", "0L shard_bytes", "0 shard_since")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders)
    at = free_name(rows, "_q_path")
    rows = rows.select("*", F.col("_metadata.file_path").alias(at))
    named = live.select(
        F.col("path").alias(at), F.regexp_extract("path", "/data/(.*)$", 1).alias("shard"), F.col("n_rows").alias("shard_rows"), F.col("n_bytes").alias("shard_bytes"), F.col("since").alias("shard_since")
    )
    named = F.broadcast(named) if live.count() <= BROADCAST_SHARDS else named
    return rows.drop("shard", "shard_rows", "shard_bytes", "shard_since").join(named, at).drop(at)


def shard_corpus(docs: DataFrame, store: str, shard_rows: int = 2000, target_bytes: int = 64 << 20, fanout: int = 4) -> DataFrame:
    """Append ``docs`` to the store, compact it, and read the committed version back."""
    spark = docs.sparkSession
    append(docs, store, shard_rows)
    compact(spark, store, docs.schema, target_bytes, fanout)
    return read(spark, store, docs.schema)
