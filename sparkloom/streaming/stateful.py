"""Streams with state of their own: corpus memory that forgets by timers, and answers joined to what they answer.

``remembered`` keeps one small record an author: papers, first and last moment, and whom they met. A record is dropped by an
event-time timer once the watermark has passed its horizon, and a gap over the horizon begins a new one however rows fall into
batches, so a stream's memory equals a batch's. ``answered`` is an outer join of two streams within a time range; both sides are watermarked, so the state
of either holds a range's rows and no more.

Defined cases: rows without author or moment don't count; repeated rows count again (``incremental.deduplicated`` removes them before); rows behind the watermark, or
older than a record by more than the horizon, are history that is forgotten already; an empty stream gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.session import checkpoint_dir
from sparkloom.streaming.incremental import run_available

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECORD = "author string, n long, deg long, first timestamp, last timestamp, known boolean"


def _micros(moment: pd.Timestamp) -> int:
    return int(moment.value // 1_000)


def _moment(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros * 1_000)


class Memory(StatefulProcessor):
    """One author's record: how many papers, from when to when, and with whom."""

    def __init__(self, horizon: timedelta):
        self.horizon = int(horizon.total_seconds() * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "n long, first long, last long")
        self.others = handle.getMapState("others", "other string", "times long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = pd.concat(list(rows)).sort_values("moment", kind="stable")
        n, first, last = self.record.get() if self.record.exists() else (0, 0, None)
        before = last
        # The store answers each call over a socket: whom the author met is read once a batch and told the store once, not asked for every row.
        held = {k[0] for k in self.others.keys()} if last is not None else set()
        met = set(held)
        for moment, other in zip(fresh["moment"], fresh["other"], strict=True):
            at = _micros(moment)
            if last is not None and at < last - self.horizon:
                continue
            if last is None or at > last + self.horizon:
                if held:
                    self.others.clear()
                held, met = set(), set()
                n, first, last = 0, at, at
            n, first, last = n + 1, min(first, at), max(last, at)
            if other is not None:
                met.add(other)
        if last is None:
            return
        for other in met - held:
            self.others.updateValue((other,), (1,))
        self.record.update((n, first, last))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.handle.registerTimer(self._expiry(last))
        yield self._told(key[0], n, len(met), first, last, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, first, last = self.record.get()
        self.record.clear()
        self.others.clear()
        yield self._told(key[0], n, 0, first, last, False)

    def _expiry(self, last: int) -> int:
        return (last + self.horizon) // 1_000 + 1

    @staticmethod
    def _told(author, n, deg, first, last, known) -> pd.DataFrame:
        return pd.DataFrame({"author": [author], "n": [n], "deg": [deg], "first": [_moment(first)], "last": [_moment(last)], "known": [known]})

    def close(self) -> None:
        return None


def remembered(stream: DataFrame, author: str, moment: str, other: str, horizon: timedelta, late: str = "48 hours") -> DataFrame:
    """Changes of memory, as a stream of records in update mode: ``known`` is false where one is forgotten."""
    typed = stream.select(F.col(author).cast("string").alias("author"), F.col(moment).cast("timestamp").alias("moment"), F.col(other).cast("string").alias("other"))
    marked = typed.where("author IS NOT NULL AND moment IS NOT NULL").withWatermark("moment", late)
    return marked.groupBy("author").transformWithStateInPandas(Memory(horizon), RECORD, "Update", "EventTime")


def answered(asked: DataFrame, answers: DataFrame, key: str, moment: str, within: str, late: str) -> DataFrame:
    """Rows of ``asked`` with those of ``answers`` (columns ``answer_*``) of the same key from their moment to ``within`` later;
    rows without any come once the watermark has passed their range."""
    left = asked.withWatermark(moment, late)
    right = answers.select(*[F.col(c).alias(f"answer_{c}") for c in answers.columns]).withWatermark(f"answer_{moment}", late)
    near = (F.col(key) == F.col(f"answer_{key}")) & F.col(f"answer_{moment}").between(F.col(moment), F.col(moment) + F.expr(f"INTERVAL {within}"))
    return left.join(right, near, "left_outer")


def file_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A Parquet table as a stream, ``files`` files a micro-batch.

    The path goes as a pattern that only it matches, since Spark's stream reader takes a plain path for a folder and a table may be one file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, name: str, mode: str, folder: str | None = None) -> DataFrame:
    """Everything that ``stream`` has to say now, as a table with its micro-batch as ``batch``.

    Output and the query's checkpoint lie in ``folder`` (one of its own in the shared checkpoint folder, if none is given); drained again into the same
    folder, the query goes on where it ended. A batch that is repeated after a failure overwrites its own part."""
    spark = stream.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        run_available(stream, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"), f"{folder}/checkpoint", mode)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    schema = stream.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(f"{folder}/out")


def memory_now(changes: DataFrame, newest: DataFrame, horizon: timedelta) -> DataFrame:
    """(author, n, deg, first, last) as of the newest moment (one row, ``newest``): each author's last change, without what is beyond the horizon."""
    w = Window.partitionBy("author").orderBy(F.desc("batch"), F.desc("known"))
    last = changes.withColumn("_r", F.row_number().over(w)).where("_r = 1 AND known").drop("_r", "known", "batch")
    fresh = F.col("last") >= F.col("newest") - F.expr(f"INTERVAL {int(horizon.total_seconds())} SECONDS")
    return last.crossJoin(F.broadcast(newest)).where(fresh).drop("newest")
