"""Paged remote listings as a Spark data source.

How a page is fetched is given by the caller, so that the source itself knows no address and tests need no network. Pages are read by
executors, a partition a run of pages; a page that fails is asked for again with growing waits."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

LONGEST_WAIT = 120.0


class Throttled(Exception):
    """The remote asks to wait; ``retry_after`` in seconds if it says how long."""

    def __init__(self, retry_after: float | None = None):
        super().__init__("throttled")
        self.retry_after = retry_after


class Malformed(Exception):
    """A page that can't be read; it may be whole when asked for again."""


def fetched(fetch: Callable[[int, int], list], start: int, size: int, attempts: int = 5, sleep: Callable[[float], Any] = time.sleep) -> list:
    """One page. After a throttle it waits as long as it is told, else 2 to the number of the attempt, at most ``LONGEST_WAIT``."""
    for attempt in range(1, attempts + 1):
        try:
            return fetch(start, size)
        except (Throttled, Malformed) as failed:
            if attempt == attempts:
                raise
            told = failed.retry_after if isinstance(failed, Throttled) else None
            sleep(min(LONGEST_WAIT, float(2**attempt) if told is None else told))
    raise AssertionError("unreachable")


def pages(fetch: Callable[[int, int], list], size: int, most: int | None = None, start: int = 0, end: int | None = None, **options) -> Iterator[tuple]:
    """Rows from ``start`` on, until an empty or short page, ``end`` or ``most`` rows."""
    at, given = start, 0
    while (most is None or given < most) and (end is None or at < end):
        wanted = min([size, *([] if most is None else [most - given]), *([] if end is None else [end - at])])
        page = fetched(fetch, at, wanted, **options)
        yield from (tuple(r) for r in page)
        given += len(page)
        at += len(page)
        if len(page) < wanted:
            return


def accumulated(fetch: Callable[[int, int], list], key: Callable[[tuple], Any], size: int, most_pages: int, start: int = 0, seen: set | None = None, **options) -> tuple[list[tuple], int, bool]:
    """(new rows, next start, exhausted) of at most ``most_pages`` pages; rows whose key was seen are left out."""
    seen = set() if seen is None else seen
    rows: list[tuple] = []
    for _ in range(most_pages):
        page = [tuple(r) for r in fetched(fetch, start, size, **options)]
        start += len(page)
        for row in page:
            if key(row) not in seen:
                seen.add(key(row))
                rows.append(row)
        if len(page) < size:
            return rows, start, True
    return rows, start, False


class _Run(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def paged_source(name: str, schema: StructType, fetch: Callable[[int, int], list], size: int, run: int = 10) -> type[DataSource]:
    """A data source for ``spark.dataSource.register``: option ``rows`` says how many rows to read, in partitions of ``run`` pages."""

    class Reader(DataSourceReader):
        def __init__(self, rows: int):
            self.rows = rows

        def partitions(self):
            step = size * run
            return [_Run(at, min(at + step, self.rows)) for at in range(0, self.rows, step)] or [_Run(0, 0)]

        def read(self, partition):
            yield from pages(fetch, size, start=partition.start, end=partition.end)

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(int(self.options.get("rows", "0")))

    return Paged
