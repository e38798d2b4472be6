"""Paged listings: ends, retries and waits, accumulation, and the data source."""

import pytest
from pyspark.sql import types as T

from sparkloom.sources.paged import Malformed, Throttled, accumulated, fetched, paged_source, pages

DATA = [(i, f"t{i}") for i in range(25)]


def fetch(start, size):
    return DATA[start : start + size]


def test_pages_end():
    assert list(pages(fetch, 10)) == DATA
    assert list(pages(fetch, 10, most=12)) == DATA[:12]
    assert list(pages(fetch, 10, start=20, end=23)) == DATA[20:23]


def test_waits():
    waits, answers = [], [Throttled(7), Throttled(), Malformed(), Throttled(999)]

    def failing(start, size):
        if answers:
            raise answers.pop(0)
        return fetch(start, size)

    assert fetched(failing, 0, 3, sleep=waits.append) == DATA[:3]
    assert waits == [7, 4.0, 8.0, 120.0]
    with pytest.raises(Throttled):
        fetched(lambda s, n: (_ for _ in ()).throw(Throttled()), 0, 1, attempts=2, sleep=waits.append)


def test_accumulation():
    seen = {3}
    rows, at, done = accumulated(fetch, lambda r: r[0], 10, 2, seen=seen)
    assert len(rows) == 19 and at == 20 and not done
    rows, at, done = accumulated(fetch, lambda r: r[0], 10, 2, at, seen)
    assert len(rows) == 5 and done


def test_data_source(spark):
    rows = [(i, f"t{i}") for i in range(25)]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType())])
    spark.dataSource.register(paged_source("paged_test", schema, lambda start, size: rows[start : start + size], 3, run=2))
    found = spark.read.format("paged_test").option("rows", "20").load()
    assert sorted(tuple(r) for r in found.collect()) == rows[:20]
