"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, jaccard, language, mixing, sharding
from quire.llm.work import new_folder, release, saved, tables_made

#: No SQL expresses the first stage (a fitted random field); tests hold each stage against brute force.
ORACLE_SQL = None

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Languages that stay; None for all that the labelled rows name.
LANGUAGES: list[str] | None = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a kept language (LANGUAGES), by prediction; where ``lang`` is null the prediction is filled in.

    Null texts and texts without a letter go, texts that score little above chance, and texts that are
    no running text in any language: lists of words between marks, words with marks run on to them.
    Without a labelled row to learn from there is no field and no score to go by.
    """
    field = language.fit(language.sample(docs))
    named = language.identify(docs, field, into="_q_lang", score="_q_score").where(language.has_language(field, "text", "_q_lang", "_q_score") & language.is_running_text("text"))
    if field is not None:
        if LANGUAGES is not None:
            named = named.where(F.col("_q_lang").isin(LANGUAGES))
        named = named.withColumn("lang", F.coalesce("lang", "_q_lang"))
    return named.select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more; one row of each group stays, that of the smallest id."""
    return jaccard.one_of_each(docs, size=5, percent=80).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents again, each source in proportion to the square root of its size, globally shuffled."""
    return mixing.mix_sources(docs).select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the committed version of a sharded store, with their shards."""
    return sharding.shard_corpus(docs, new_folder(spark, "corpus"))


STAGES = [
    ("language ID", identified),
    ("n-gram Jaccard join", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = tables_made()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            on_the_way = set(tables_made()) - set(before)
            docs = saved(docs, f"stage{k}")
            release(spark, sorted(on_the_way))
    return docs
