"""Containers and property changes of Word 97 files."""

import random
import struct

from quire.sources import files, word97


def test_containers_round_trip():
    rng = random.Random(4)
    small = {"WordDocument": rng.randbytes(700), "Data": b"", "A rather long name of a stream": rng.randbytes(4096)}
    large = {"WordDocument": rng.randbytes(8_000_000), "1Table": rng.randbytes(9_000)}  # more tables than the header lists
    many = {f"s{k}": rng.randbytes(k) for k in range(30)}
    for streams in (small, large, many):
        got = files.compound_streams(word97.compound_file(streams))
        assert set(got) == set(streams)
        for name, body in streams.items():
            assert got[name][: len(body)] == body and len(got[name]) % word97.SECTOR == 0 and not any(got[name][len(body) :])


def test_documents_and_odd_bytes():
    for text in ("", "one", "Žluť\nand a second\nline 😀", "x" * 100_000):
        assert files.word97_text(word97.text_document(text)) == text
    codes = word97.changes(struct.pack("<HB", 0x0835, 1) + struct.pack("<HH", 0x4A43, 30) + struct.pack("<HB3s", 0xC615, 3, b"abc") + struct.pack("<HI", 0x6870, 7) + b"\x35")
    assert codes == [(0x0835, b"\x01"), (0x4A43, b"\x1e\x00"), (0xC615, b"abc"), (0x6870, b"\x07\x00\x00\x00")]
    assert word97.changes(struct.pack("<HB", 0xC615, 9) + b"short") == [] and word97.changes(b"") == []


def test_the_query_of_texts_makes_and_reads_each_file_once(spark):
    from quire.plans import package_queries

    found = package_queries.word97_roundtrip(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "Broadcast" not in plan


def test_files_are_made_and_told_few_at_a_time():
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField

    class Rows:
        schema = {"path": StructField("path", StringType())}
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    texts = ["x" * (k % 9000) for k in range(4000)] + [None]
    run = word97.text_documents(Rows(), "path", "text")
    made = list(run([pa.RecordBatch.from_arrays([pa.array(map(str, range(len(texts)))), pa.array(texts)], ["path", "text"])]))
    assert max(b.nbytes for b in made) <= 2 * files.BATCH_BYTES and sum(b.num_rows for b in made) == len(texts)
    assert all(all(b.column(2).to_pylist()) for b in made) and not files.is_word97(word97.compound_file({"Workbook": b"x"})) and not files.is_word97(b"") and not files.is_word97(None)
    assert [files.word97_text(c) for b in made for c in b.column(1).to_pylist()] == [t or "" for t in texts]
