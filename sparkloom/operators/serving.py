"""What the product's views ask for: controls, search, visits, imports, enrichment health and the run ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import grid

STATUSES = ("unread", "reading", "read", "archived")


def controls(points: DataFrame) -> DataFrame:
    """(papers, first_year, last_year): the bounds that filters start from."""
    return points.agg(F.count("*").alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def author_query(text: str) -> tuple[str, bool]:
    """The needle of a search, and whether it asks for an author (``author:`` before it); outer quotes go."""
    needle = text.strip()
    exact = needle.lower().startswith("author:")
    needle = needle[7:].strip() if exact else needle
    if len(needle) > 1 and needle[0] == needle[-1] and needle[0] in "\"'":
        needle = needle[1:-1]
    return needle.lower(), exact


def search(papers: DataFrame, text: str, columns: tuple[str, ...], authors: str) -> DataFrame:
    """Papers whose title, abstract or an author holds the text; with ``author:``, whose author is exactly it."""
    needle, exact = author_query(text)
    if not needle:
        return papers.limit(0)
    if exact:
        return papers.where(F.exists(authors, lambda a: F.lower(a) == needle))
    found = F.exists(authors, lambda a: F.contains(F.lower(a), F.lit(needle)))
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
    return papers.where(found)


def new_since(feed: DataFrame, published: str, last_visit: str, by: list[str], order: list[Column]) -> DataFrame:
    """Adds ``is_new``, and ``caught_up`` on the first row of a feed that isn't new after ones that are."""
    marked = feed.withColumn("is_new", F.col(published) > F.lit(last_visit))
    before = F.lag("is_new").over(Window.partitionBy(*by).orderBy(*order))
    return marked.withColumn("caught_up", F.coalesce(before & ~F.col("is_new"), F.lit(False)))


def sanitised_entries(raw: DataFrame, payload: str, schema: str = "id string, title string, status string, note string") -> DataFrame:
    """Rows of untrusted JSON: known fields only, unknown statuses as the first, rows without id or title dropped."""
    parsed = raw.select(F.from_json(payload, schema).alias("r")).select("r.*")
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(STATUSES[0])
    filled = (F.trim("id") != "") & (F.trim("title") != "")
    return parsed.where(filled).select("id", "title", status.alias("status"), F.coalesce("note", F.lit("")).alias("note"))


def recent_searches(searches: DataFrame, by: str, text: str, moment: str, most: int = 8) -> DataFrame:
    """The newest distinct searches of each user, newest first; ``most`` is the list's own length."""
    newest = searches.groupBy(by, text).agg(F.max(moment).alias(moment))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col(moment).desc(), text))
    return newest.withColumn("place", place).where(F.col("place") <= most)


def enrichment_health(papers: DataFrame, by: str, asked: str, answered: str, matched: str) -> DataFrame:
    """(by, status): skipped, no-candidates, unreachable, no-match or ok (5 % matched)."""
    n = F.count("*")
    q, a, m = (F.sum(F.col(c).cast("long")) for c in (asked, answered, matched))
    status = F.when(n == 0, "skipped").when(q == 0, "no-candidates").when(a == 0, "unreachable").when(m < 0.05 * q, "no-match").otherwise("ok")
    return papers.groupBy(by).agg(status.alias("status"))


def paper_sheet(points: DataFrame, near: DataFrame, doc_id: int, most: int = 8) -> DataFrame:
    """A paper's neighbours with their details in one join; ``near`` is (query_id, doc_id, similarity, place)."""
    own = near.where((F.col("query_id") == doc_id) & (F.col("place") <= most)).select(F.col("doc_id").alias("near_id"), "similarity", "place")
    return points.join(F.broadcast(own), points["doc_id"] == F.col("near_id")).drop("near_id")


def map_answer(points: DataFrame, x: tuple | None, y: tuple | None, years: tuple | None, text: str, cap: int) -> tuple[str, DataFrame]:
    """The map's mode and the points to draw: in hash order, so that a cut is the same every time."""
    found = grid.viewport(points, x, y, years, text)
    n = found.limit(cap + 1).count()
    mode = grid.map_mode(x is not None and y is not None, bool(text.strip()) or years is not None, n, cap)
    return mode, found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cap)


class RunLedger:
    """Runs as an append-only table of events; a run's state is its newest event."""

    SCHEMA = "run_id string, mode string, status string, processed long, error string, at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, run_id: str, mode: str, status: str, processed: int = 0, error: str | None = None, at: datetime | None = None) -> None:
        row = [(run_id, mode, status, processed, error, at or datetime.now())]
        self.spark.createDataFrame(row, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def state(self) -> DataFrame:
        events = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("at").desc(), F.col("processed").desc()))
        return events.withColumn("_p", place).where("_p = 1").drop("_p")
