from pyspark.sql import functions as F

from quire.streaming import requests as R


def run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def source(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "k long, item long, seq long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / f"b{k}"))
    return spark.readStream.schema("k long, item long, seq long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b*"))


def rows(start, n, key=1):
    from datetime import datetime, timedelta

    return [(key, 100 + i, i, datetime(2024, 1, 1) + timedelta(seconds=i)) for i in range(start, start + n)]


def test_latest_and_generation(spark, tmp_path):
    s = source(spark, tmp_path, [rows(0, 5), rows(5, 3), rows(0, 2, key=2), rows(1, 2)])
    got = run(spark, R.latest(s, ["k"], "seq", ["item"], "ts", "1 hour"), "latest", "complete").collect()
    assert sorted((r.k, r.item) for r in got) == [(1, 107), (2, 101)] and {str(r.since) for r in got} == {"2024-01-01 00:00:00"}
    s = source(spark, tmp_path / "g", [rows(0, 5)])
    newest = run(spark, R.newest_generation(s.withColumn("gen", F.floor(F.col("seq") / 3)), ["k"], "gen", ["item"], "ts", "1 hour"), "newest", "complete")
    assert [r.gen for r in newest.collect()] == [1]


def test_what_is_behind_the_watermark_goes(spark, tmp_path):
    s = source(spark, tmp_path, [rows(0, 3), rows(7200, 1), rows(1, 1)])
    got = run(spark, R.latest(s, ["k"], "seq", ["item"], "ts", "10 minutes"), "late", "append").collect()
    assert [(r.k, r.item) for r in got] == [(1, 102)]  # closed once; the late request of the last batch finds no state


def test_waiting_keeps_the_newest_of_any_type(spark, tmp_path):
    s = source(spark, tmp_path, [rows(0, 3), rows(3, 3)])
    got = run(spark, R.waiting(s, "k", "item", "seq", "ts", "1 hour", most=4), "waiting", "update")
    assert max(got.collect(), key=lambda r: r.waiting[0]).waiting == [105, 104, 103, 102]
    texts = source(spark, tmp_path / "t", [rows(0, 3), rows(3, 1)]).selectExpr("concat('k', k) as k", "concat('i', item) as item", "seq", "ts")
    got = run(spark, R.waiting(texts, "k", "item", "seq", "ts", "1 hour", most=2), "texts", "update")
    assert [(r.key, r.waiting) for r in got.collect()] == [("k1", ["i102", "i101"]), ("k1", ["i103", "i102"])]


def test_single_flight(spark, tmp_path):
    s = source(spark, tmp_path, [rows(0, 3), rows(1, 2)])
    got = run(spark, R.single_flight(s, "item", "ts", "1 hour"), "single", "append")
    assert sorted(r.item for r in got.collect()) == [100, 101, 102]
