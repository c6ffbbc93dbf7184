"""Searches that a newer one ends: one running search a key, cancelled by the tag of its jobs."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Hashable
from concurrent.futures import Future, wait
from threading import Lock

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession


class Searches:
    """Runs searches of a session beside each other, at most one of each key.

    A search of a key that has one running ends that one's jobs on the cluster and begins once they are gone;
    the answer of the older one is then None. Searches of other keys, and other jobs, are not touched.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._name = f"search-{uuid.uuid4().hex[:12]}"
        self._numbers = itertools.count()
        self._lock = Lock()
        self._newest: dict[Hashable, tuple[int, Future]] = {}

    def find(self, key: Hashable, plan: Callable[[], DataFrame], most: int = 1000) -> Future[list[Row] | None]:
        """The first ``most`` rows of a plan, as soon as they are there; None once a newer search has overtaken this one.

        ``plan`` is called in the search's own thread, so jobs that it runs to make its plan end with the search too.
        """
        answer: Future[list[Row] | None] = Future()
        with self._lock:
            number = next(self._numbers)
            before = self._newest.get(key)
            self._newest[key] = (number, answer)
        InheritableThread(target=lambda: self._run(key, number, before, plan, most, answer), session=self._spark, daemon=True).start()
        return answer

    def _overtaken(self, key: Hashable, number: int) -> bool:
        return self._newest[key][0] != number

    def _run(self, key: Hashable, number: int, before: tuple[int, Future] | None, plan: Callable[[], DataFrame], most: int, answer: Future) -> None:
        context = self._spark.sparkContext
        try:
            # Jobs that begin after a call are ended by the next one.
            while before and not before[1].done():
                context.cancelJobsWithTag(f"{self._name}-{before[0]}")
                wait([before[1]], timeout=0.05)
            rows = None
            if not self._overtaken(key, number):
                context.addJobTag(f"{self._name}-{number}")
                rows = plan().limit(most).collect()
            error = None
        except Exception as e:  # noqa: BLE001  it is the caller's
            rows, error = None, e
        with self._lock:
            overtaken = self._overtaken(key, number)
            if not overtaken:
                del self._newest[key]
        if error is not None and not overtaken:
            answer.set_exception(error)
        else:
            answer.set_result(None if overtaken else rows)
