import random
import re
import shutil
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quire.llm import decontam, jaccard, language, queries

from .conftest import sentence

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(5000, None, None, None, None), (5001, "12 34", "en", "s", 5), (5002, "", None, "s", 0), (5003, "A clean short text.", None, None, 19)], docs.schema)
    tables = [docs.union(odd)]
    for _, stage in P.STAGES:
        tables.append(stage(spark, tables[-1], SF).cache())
    yield tables
    for t in tables[1:]:
        t.unpersist()


def is_marks(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    odd = sum(not any(c.isalnum() for c in w) for w in words) + sum(len(re.findall(r"(?<=[^\W_]|[.,])([#$%&*!?~=+<>|])\1+(?![^\W_])", w)) for w in words)
    return len(words) >= 5 and odd > 0.25 * len(words)


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(staged):
    docs, named, single, clean, mixed, sharded = staged
    no_text = {r.doc_id for r in docs.collect() if r.text and is_marks(r.text)}
    assert no_text and ids(docs) - ids(named) == {5000, 5001, 5002} | no_text
    assert all(t.columns == P.COLUMNS for t in (named, single, clean, mixed))
    groups = {r.doc_id: r.component_id for r in __import__("quire.llm.jaccard", fromlist=["x"]).similar_groups(named, 5, 80).collect()}
    assert ids(single) == {d for d, c in groups.items() if d == c} < ids(named)
    bench = docs.sparkSession.read.parquet(f"{SF}/benchmark.parquet")
    holds = single.join(bench.select(F.col("text").alias("item")), F.contains("text", F.col("item"))).select("doc_id").distinct()
    assert holds.count() > 0 and not ids(holds) & ids(clean) and len(ids(single) - ids(clean)) == holds.count()
    assert 5003 in ids(clean) and ids(mixed) <= ids(clean) and mixed.count() > 0
    key = lambda df: sorted(map(tuple, df.select(P.COLUMNS).collect()), key=str)
    assert key(sharded) == key(mixed)


def test_run_is_the_stages(spark, tmp_path, staged):
    source = staged[0].sparkSession.read.parquet(f"{SF}/documents.parquet").limit(40)
    source.write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    out = P.run(spark, str(tmp_path))
    assert set(P.COLUMNS) < set(out.columns) and out.count() > 0


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_language_stage_without_labels_keeps_documents_with_letters(spark):
    rows = [(1, "A clean text.", None), (2, "12 34", None), (3, None, None), (None, "no id", "en"), (5, "Здравствуй", None)]
    docs = spark.createDataFrame([(d, t, lang, None, None) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert ids(P.identified(spark, docs, SF)) == {1, None, 5}


def test_language_stage_uses_its_prediction(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bare = docs.where(~language.may_learn(F.col("doc_id"))).withColumns({"doc_id": F.col("doc_id") + 10**6, "lang": F.lit(None).cast("string")})
    both = docs.union(bare)
    named = P.identified(spark, both, SF).where("doc_id >= 1000000").select("doc_id", "lang").collect()
    truth = {r.doc_id + 10**6: r.lang for r in docs.collect()}
    assert len(named) > 20 and sum(r.lang == truth[r.doc_id] for r in named) >= 0.95 * len(named)
    monkeypatch.setattr(P, "LANGUAGES", ["de"])
    kept = P.identified(spark, both, SF).where("doc_id >= 1000000").collect()
    assert kept and {r.lang for r in kept} == {"de"} and len(kept) < len(named)


def test_repeated_rows_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    wide = docs.union(docs).withColumns({"rank": F.lit(1), "k1": F.lit("x"), "label": F.lit(0.5)})
    for k, (_, stage) in enumerate(P.STAGES):
        wide = stage(spark, wide, SF)
        assert set(P.COLUMNS) <= set(wide.columns)
        if k == 1:
            assert wide.count() == wide.select("doc_id").distinct().count() <= 60
            wide = wide.cache()


def test_language_stage_rejects_what_scores_near_chance(spark):
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("zqxjkwv") for _ in range(5)) for _ in range(40))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(6000, noise, None, None, None), (6001, "Q", None, None, None)], docs.schema)
    kept = ids(P.identified(spark, docs.union(odd), SF))
    held_out = ids(docs.where(~language.may_learn(F.col("doc_id")) & language.is_running_text()))
    assert 6000 not in kept and 6001 in kept and held_out and held_out <= kept


def test_first_stage_rejects_what_is_no_running_text(spark):
    clean = ["Wh thtion eraon the, 12 of and 97.51.17.173 at +1 (269) 555-3296 in.", "dash - by dash, and so on... yes?! quite right!", "¿Qué? ¡sí! uno | dos tres cuatro cinco seis", "one | two", "", None, "C++ and C# and R, all of them are languages"]
    junk = ["ciónza | quedo | asca | oscios, | enlla |", "la### ega%%% de$$$ tan&&& del***", "THE!! EEAIN!! STONTION!! AND!! OF!! the", "- - - = = = word word", "*** a *** b *** c ***"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string")
    kept = {r.doc_id for r in df.where(language.is_running_text()).collect()}
    assert kept == set(range(len(clean)))


def test_first_stage_keeps_rows_of_good_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = P.identified(spark, docs, sf)
    counts = labels.join(docs, "doc_id").join(kept.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"), F.count("kept").alias("kept")).collect()
    rows = {r.quality: r for r in counts}
    assert rows[1].kept == rows[1].n and rows[0].kept < rows[0].n / 2


def test_texts_go_to_python_once_and_never_come_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = language.fit(language.sample(docs))
    named = language.identify(docs, field, into="_q_lang", score="_q_score").where(language.has_language(field, "text", "_q_lang", "_q_score"))
    clean = P.decontaminated(spark, docs, SF)
    for df in (named, clean):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("step", ["language", "decontamination", "shingles"])
def test_memory_of_python_steps_follows_small_blocks(step):
    rng = random.Random(2)
    texts = pa.array([sentence(rng, 2000) for _ in range(400)], pa.large_string())
    seeds = decontam.seeds([1], [sentence(rng, 30)])
    field = language.fit([("a", sentence(rng, 200)), ("b", "another language of other words")])
    runs = {"language": lambda c: language._documents(field, c), "decontamination": lambda c: decontam._search(c, seeds, any_item=True), "shingles": lambda c: [None for _ in jaccard.shingle_sets(c, 5)]}
    runs[step](texts[:2])
    tracemalloc.start()
    runs[step](texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 3e6 and most < 32e6
    monolith = pa.array([" ".join(texts.to_pylist())], pa.large_string())
    whole = jaccard.shingle_sets(monolith, 5)
    assert sum(len(s) for _, s in whole) > 100_000  # a text beyond a block stays whole


def test_sets_of_a_batch_are_given_in_parts(monkeypatch):
    rng = random.Random(4)
    texts = [sentence(rng, 300) for _ in range(20)]
    sets = dict(jaccard.shingle_sets(pa.array(texts, pa.large_string()), 5))
    batch = pa.RecordBatch.from_arrays([pa.array([jaccard.signature(sets[i]) for i in range(20)]), pa.array(texts)], ["sig", "text"])
    (one,) = jaccard._sets(5)(iter([batch, batch]))
    monkeypatch.setattr(jaccard, "SETS_BYTES", 5000)
    parts = list(jaccard._sets(5)(iter([batch, batch])))
    assert len(parts) > 5 and pa.Table.from_batches(parts).to_pylist() == one.to_pylist() and one.num_rows == 20
