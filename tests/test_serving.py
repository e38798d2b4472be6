"""Views on small frames."""

import datetime

from pyspark.sql import functions as F

from sparkloom.operators import serving


def test_search_words():
    assert serving.author_query(' author: "Ann Lee" ') == ("ann lee", True)
    assert serving.author_query("'deep nets'") == ("deep nets", False)


def test_search(spark):
    frame = spark.createDataFrame([(1, "A c++ tool", ["Bo"]), (2, None, ["Ann Lee"]), (3, "x", ["Ann"])], "id int, title string, authors array<string>")
    ids = lambda text: [r["id"] for r in serving.search(frame, text, ("title",), "authors").orderBy("id").collect()]
    assert ids("C++") == [1] and ids("ann") == [2, 3] and ids("author:ann") == [3] and ids(" ") == []


def test_sanitised_entries(spark):
    rows = [('{"id":"1","title":"t","status":"bogus","evil":1}',), ("not json",), ('{"id":"","title":"t"}',), ('{"id":"2","title":"u","status":"read","note":"n"}',)]
    found = serving.sanitised_entries(spark.createDataFrame(rows, "p string"), "p").orderBy("id").collect()
    assert [tuple(r) for r in found] == [("1", "t", "unread", ""), ("2", "u", "read", "n")]


def test_map_answer_and_sheet(spark):
    points = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") / 50).alias("x"), F.lit(0.5).alias("y"), F.lit(2020).alias("year"), F.lit("T").alias("title"))
    mode, found = serving.map_answer(points, (0, 1), (0, 1), None, "", 10)
    assert mode == "Zoom for focus" and found.count() == 10
    near = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.8, 9)], "query_id long, doc_id long, similarity double, place int")
    assert [r["doc_id"] for r in serving.paper_sheet(points, near, 1).collect()] == [2]


def test_ledger(spark, tmp_path):
    ledger = serving.RunLedger(spark, str(tmp_path / "runs"))
    ledger.record("r1", "incremental", "running", 0, at=datetime.datetime(2024, 1, 1))
    ledger.record("r1", "incremental", "failed", 1000, "boom", at=datetime.datetime(2024, 1, 2))
    assert [(r["status"], r["processed"]) for r in ledger.state().collect()] == [("failed", 1000)]
