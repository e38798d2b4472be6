"""Incremental work: watermarks with overlap, stateful folds of corpus memory, deduplicated streams."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERLAP_HOURS = 48
HORIZON_MONTHS = 24


def resume_from(watermark: datetime | None, newest: datetime | None, as_of: datetime, overlap_hours: int = OVERLAP_HOURS) -> datetime:
    """Where an incremental run begins: the first known of the three, less the overlap."""
    return next(x for x in (watermark, newest, as_of) if x is not None) - timedelta(hours=overlap_hours)


def next_watermark(current: datetime | None, as_of: datetime, truncated: bool) -> datetime | None:
    """A truncated run leaves the watermark, so that nothing between is skipped."""
    return current if truncated else as_of


def since(rows: DataFrame, moment: str, start: datetime) -> DataFrame:
    return rows.where(F.col(moment) >= F.lit(start).cast("timestamp"))


def month_windows(start: datetime, end: datetime) -> list[tuple[datetime, datetime]]:
    """[first of month, last second of it] from ``start`` to ``end``, clamped to both."""
    found, at = [], start
    while at <= end:
        after = datetime(at.year + at.month // 12, at.month % 12 + 1, 1, tzinfo=at.tzinfo)
        found.append((at, min(end, after - timedelta(seconds=1))))
        at = after
    return found


def fold_authors(state: DataFrame, batch: DataFrame, month: int, horizon: int = HORIZON_MONTHS) -> DataFrame:
    """state (author, n, last) after a batch of the same columns; authors unseen beyond the horizon go."""
    both = state.select("author", "n", "last").unionByName(batch.select("author", "n", "last"))
    return both.groupBy("author").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("last") >= month - horizon)


def folded(memory: dict[str, DataFrame] | None, papers: DataFrame, month: int, horizon: int = HORIZON_MONTHS) -> dict[str, DataFrame]:
    """Corpus memory after a batch of papers (paper_id, authors, terms, t): the given one isn't changed, and what is scored before the fold sees only it.

    authors (author, n, last, deg): papers, last month, collaborators met so far; authors unseen beyond the horizon go.
    collaborators (author, other, last): pairs, so that meeting again counts once; they go with the horizon too.
    terms (term, month, df) and volume (month, n): papers that have a term, and all papers, by month within the horizon."""
    oldest = month - horizon
    each = papers.select("t", F.explode(F.array_distinct("authors")).alias("author"))
    fresh = each.groupBy("author").agg(F.count("*").alias("n"), F.max("t").alias("last"))
    met = papers.select("t", F.array_distinct("authors").alias("a")).select("t", F.explode("a").alias("author"), "a").select("author", F.explode("a").alias("other"), "t").where("author <> other")
    met = met.groupBy("author", "other").agg(F.max("t").alias("last"))
    terms = papers.select("t", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term", F.col("t").alias("month")).agg(F.count("*").alias("df"))
    volume = papers.groupBy(F.col("t").alias("month")).agg(F.count("*").alias("n"))
    if memory is not None:
        fresh = memory["authors"].select("author", "n", "last").union(fresh).groupBy("author").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        met = memory["collaborators"].union(met).groupBy("author", "other").agg(F.max("last").alias("last"))
        terms = memory["terms"].union(terms).groupBy("term", "month").agg(F.sum("df").alias("df"))
        volume = memory["volume"].union(volume).groupBy("month").agg(F.sum("n").alias("n"))
    met = met.where(F.col("last") >= oldest)
    degree = met.groupBy("author").agg(F.count("*").alias("deg"))
    authors = fresh.where(F.col("last") >= oldest).join(degree, "author", "left").select("author", "n", "last", F.coalesce("deg", F.lit(0)).alias("deg"))
    return {"authors": authors, "collaborators": met, "terms": terms.where(F.col("month") >= oldest), "volume": volume.where(F.col("month") >= oldest)}


def run_windows(windows: list[tuple], run, record, fail_fast: bool = False) -> list[tuple]:
    """Runs ``run(start, end)`` over windows one by one and tells ``record(start, end, status, detail)`` of each; windows that failed come back.

    A failure ends the loop only with ``fail_fast``; each window's outcome is recorded before the next begins."""
    failed = []
    for start, end in windows:
        try:
            detail, status = run(start, end), "completed"
        except Exception as error:  # noqa: BLE001  whatever a window's run raises is its outcome
            detail, status = str(error), "failed"
            failed.append((start, end))
        record(start, end, status, detail)
        if failed and fail_fast:
            break
    return failed


def deduplicated(stream: DataFrame, keys: list[str], moment: str, late: str = "48 hours") -> DataFrame:
    """A stream without repeats of a key within the lateness; the moment must be a timestamp with zone."""
    typed = stream.withColumn(moment, F.col(moment).cast("timestamp"))
    return typed.withWatermark(moment, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, moment: str, by: list[str], width: str, late: str = "48 hours") -> DataFrame:
    typed = stream.withColumn(moment, F.col(moment).cast("timestamp"))
    return typed.withWatermark(moment, late).groupBy(F.window(moment, width), *by).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "append"):
    """Everything available now in micro-batches to ``sink(batch, id)``, resumable from the checkpoint."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
