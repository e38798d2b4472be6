"""Answers of external sources, identifiers, and loops with budgets and outcomes."""

from datetime import datetime

from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.sources import lookups
from sparkloom.streaming import incremental


def test_answers(spark):
    rows = spark.createDataFrame(
        [
            (1, '{"paperId": "x", "externalIds": {"DOI": "10.1/A"}, "citationCount": 3, "venue": " V ", "publicationTypes": ["Review"]}'),
            (2, '{"results": [{"id": "W1", "doi": "https://doi.org/10.2/b", "cited_by_count": 5, "referenced_works_count": 7, "type": "article", "primary_location": {"source": {"display_name": "J"}}}]}'),
            (3, '{"id": "W2", "cited_by_count": 0}'),
            (4, '{"message": {"DOI": "10.3/C", "reference-count": 2, "is-referenced-by-count": 9, "container-title": ["T"], "type": "journal"}}'),
            (5, "not json"),
            (6, '{"results": []}'),
        ],
        "key int, payload string",
    )
    scholar = lookups.scholar_papers(rows, "key", "payload").collect()
    assert [(r["key"], r["doi"], r["citations"], r["references"], r["venue"], r["publication_type"]) for r in scholar] == [(1, "10.1/a", 3, None, "V", "Review")]
    works = {r["key"]: (r["external_id"], r["doi"], r["citations"], r["references"], r["venue"]) for r in lookups.open_works(rows, "key", "payload").collect()}
    assert works == {2: ("W1", "10.2/b", 5, 7, "J"), 3: ("W2", None, 0, None, None)}
    registry = lookups.registry_works(rows, "key", "payload").collect()
    assert [(r["key"], r["external_id"], r["citations"], r["references"], r["venue"]) for r in registry] == [(4, "10.3/c", 9, 2, "T")]


def test_identifiers(spark):
    row = spark.createDataFrame([("2005.14165", "hep-th/9901001", "https://doi.org/10.48550/arXiv.2005.14165", datetime(2026, 1, 2, 3, 4, 5))], "a string, b string, d string, t timestamp").select(
        scalars.arxiv_doi(F.col("a")).alias("doi"),
        scalars.arxiv_doi(F.col("b")).alias("none"),
        scalars.paper_of_doi(F.col("d")).alias("paper"),
        scalars.snapshot_id("cs.LG, cs.CV", "org/model", F.col("t")).alias("name"),
        scalars.snapshot_time(scalars.snapshot_id("x", "y", F.col("t"))).alias("time"),
        scalars.snapshot_time(F.lit("latest")).alias("no_time"),
        scalars.snippet(F.concat(F.lit("a  b\n"), F.repeat(F.lit("c"), 400))).alias("snippet"),
    ).first()
    assert row["doi"] == "10.48550/arxiv.2005.14165" and row["none"] is None and row["paper"] == "2005.14165"
    assert row["name"] == "20260102T030405Z__cs.LG-cs.CV__org-model" and row["time"] == datetime(2026, 1, 2, 3, 4, 5) and row["no_time"] is None
    assert row["snippet"].startswith("a b c") and len(row["snippet"]) == 320
    payload = spark.createDataFrame([(1, None)], "doc_id int, paper_title string").select(scalars.camel_payload(["doc_id", "paper_title"]).alias("p")).first()["p"]
    assert payload == '{"docId":1,"paperTitle":null}'


def test_budget_and_second_chances():
    now, asked, refuse = [0.0], [], {1}

    def ask(batch):
        asked.append(batch)
        now[0] += 1
        return None if len(asked) in refuse else {x: x.upper() for x in batch}

    answers, left = lookups.enriched(list("abcdef"), ask, 2, 10, lambda: now[0])
    assert sorted(answers) == list("abcdef") and left == [] and asked[0] == ["a", "d"] == asked[-1]
    now[0], asked[:] = 0.0, []
    answers, left = lookups.enriched(list("abcdef"), ask, 2, 2, lambda: now[0])
    assert len(answers) == 2 and len(left) == 4
    assert lookups.batches([], 5) == [] and lookups.settled(None, [{"title": "t"}, {"title": ""}])["partial"]
    assert lookups.settled({"citationCount": 1, "tldr": {"text": " x "}}, []) == {"citationCount": 1, "influentialCitationCount": None, "referenceCount": None, "venue": None, "tldr": "x", "related": [], "partial": False}


def test_window_loop():
    told = []

    def run(start, end):
        if start == 2:
            raise ValueError("no")
        return start

    windows = [(1, 2), (2, 3), (3, 4)]
    assert incremental.run_windows(windows, run, lambda *x: told.append(x)) == [(2, 3)]
    assert [x[2] for x in told] == ["completed", "failed", "completed"]
    told.clear()
    assert incremental.run_windows(windows, run, lambda *x: told.append(x), fail_fast=True) == [(2, 3)] and len(told) == 2
