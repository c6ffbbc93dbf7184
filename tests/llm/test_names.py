"""Operators that give a table's other columns back keep them whatever they are called."""

import pytest

from quire.llm import decontam, jaccard, language, mixing, personal, preference, sharding, url_filter
from quire.llm.work import new_folder

ODD = ["won", "_q_lower", "_q_text", "_q_letters", "_q_key", "_q_draw", "_q_path", "_q_run", "_q_tier", "_q_a", "_q_n", "_Q_Gone", "_q_url", "found", "Row"]
TEXTS = ["the first text has these few words in it", "the first text has these few words in it", "quite another one stands here and goes on", None]


def run(name, docs, spark, text):
    if name == "urls":
        return url_filter.judge_urls(docs.withColumnRenamed(text, "url"), [url_filter.Rule("a", "block", "x", [])]).withColumnRenamed("url", text)
    if name == "decontaminate":
        return decontam.decontaminate(docs, spark.createDataFrame([(1, "nothing of this kind is anywhere in there")], f"item_id long, {text} string"), text=text)
    if name == "decontaminate_joined":
        return decontam.decontaminate(docs, spark.createDataFrame([(1, "nothing of this kind is anywhere in there")], f"item_id long, {text} string"), text=text)
    if name == "identify":
        return language.identify(docs, None, text=text)
    if name == "one_of_each":
        return jaccard.one_of_each(docs, text=text)
    if name == "mix":
        return mixing.mix_sources(docs, alpha=1.0, total=400, text=text)
    if name == "personal":
        return personal.detect(docs, personal.Model({}), text=text)
    return sharding.shard_corpus(docs, new_folder(spark, "names"), 1, 1 << 20)


@pytest.mark.parametrize("text", ["text", "_q_text"])
@pytest.mark.parametrize("name", ["urls", "decontaminate", "decontaminate_joined", "identify", "one_of_each", "mix", "personal", "shards"])
def test_columns_of_any_name_stay(spark, monkeypatch, name, text):
    if name == "decontaminate_joined":
        monkeypatch.setattr(decontam, "BLOCK_BYTES", 0)
    odd = [c for c in ODD if c != text]
    rows = [(i, t, f"s{i % 2}", *(f"{c} {i}" for c in odd)) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, ["doc_id", text, "source", *odd]).repartition(2)
    out = run(name, docs, spark, text)
    assert set(docs.columns) <= set(out.columns)
    got = {r.doc_id: r.asDict() for r in out.collect()}
    assert set(got) == ({0, 2, 3} if name == "one_of_each" else set(range(4)))
    for r in rows:
        if r[0] in got:
            assert {c: got[r[0]][c] for c in docs.columns} == dict(zip(docs.columns, r, strict=True))


def test_pairs_keep_columns_of_any_name(spark):
    turn = "array<struct<role string, text string>>".replace(" string", ": string")
    df = spark.createDataFrame([([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")], *ODD)], f"chosen {turn}, rejected {turn}, " + ", ".join(f"{c} string" for c in ODD))
    (r,) = preference.format_preferences(df).collect()
    assert [r[c] for c in ODD] == ODD and r.n_prompt_turns == 1
