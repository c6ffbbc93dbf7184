"""Searches that newer ones end."""

import time

import pytest

from quire.operators import search
from quire.streaming.searches import Searches


def slow(spark, seconds=60):
    def run(batches):
        for batch in batches:
            time.sleep(seconds)
            yield batch

    return lambda: spark.range(0, 4, 1, 4).mapInPandas(run, "id long")


def test_a_newer_search_ends_the_one_before(spark):
    pages = spark.createDataFrame([(0, "Self-organizing maps"), (1, "other"), (2, "self organizing  maps")], "page int, text string")
    searches = Searches(spark)
    began = time.time()
    old = searches.find("reader", slow(spark))
    time.sleep(3)
    skipped = searches.find("reader", slow(spark))
    new = searches.find("reader", lambda: search.search(pages, "text", "other"))
    assert [r.page for r in new.result(timeout=40)] == [1]
    assert old.result(timeout=1) is None and skipped.result(timeout=1) is None
    assert time.time() - began < 45
    tracker = spark.sparkContext.statusTracker()
    end = time.time() + 10
    while tracker.getActiveJobsIds() and time.time() < end:
        time.sleep(0.1)
    assert not tracker.getActiveJobsIds()
    assert spark.range(3).count() == 3  # other jobs go on
    assert not searches._newest


def test_keys_apart_and_errors(spark):
    searches = Searches(spark)
    kept = searches.find("a", slow(spark, 2))
    other = searches.find("b", lambda: spark.range(10), most=3)
    assert len(other.result(timeout=60)) == 3 and len(kept.result(timeout=60)) == 4
    with pytest.raises(Exception, match="nothing"):
        searches.find("a", lambda: spark.range(1).select("nothing")).result(timeout=60)
    assert searches.find("a", lambda: spark.range(1)).result(timeout=60)[0].id == 0
