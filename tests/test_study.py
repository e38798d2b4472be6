"""Evaluation operators whose results SQL can't give, and edges of the others."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import evaluation, graph, models, records, tables
from sparkloom.streaming import incremental


def test_row_numbers_of_wide_rows(spark):
    """A wide column and many partitions: numbers are dense, distinct and in order."""
    n = 200_000
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spark.range(n, numPartitions=16).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), 200).alias("wide"))
        numbered = tables.row_numbers(rows, ["k"], "number")
        low, high, distinct = numbered.agg(F.min("number"), F.max("number"), F.countDistinct("number")).first()
        wrong = numbered.join(numbered.select((F.col("number") - 1).alias("number"), F.col("k").alias("after")), "number").where("after < k").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (low, high, distinct, wrong) == (0, n - 1, n, 0)


def test_pagerank_with_tolerance_and_loss(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "c")], "src string, dst string")
    names = ["a", "b", "c", "d"]
    m = np.zeros((4, 4))
    for s, d in edges.collect():
        m[names.index(d), names.index(s)] = 1
    rank = np.full(4, 0.25)
    for _ in range(200):
        rank = 0.85 * (m / np.maximum(m.sum(axis=0), 1)) @ rank + 0.15 / 4
    found = {r["node"]: r["rank"] for r in graph.pagerank(edges, 200, tolerance=1e-9).collect()}
    assert [found[x] for x in names] == pytest.approx(rank, abs=1e-7)
    papers = spark.createDataFrame([(1, 0, ["x", "y"]), (2, 0, ["z"]), (3, 5, ["x", "z"])], "id int, t int, authors array<string>")
    found = {r["author"]: r["rank"] for r in graph.coauthor_pagerank(papers, 5, 30).collect()}
    assert found["x"] == pytest.approx(found["y"]) and found["x"] == pytest.approx(1.0, abs=1e-2) and found["z"] == pytest.approx(0.15)


def _joins(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_pagerank_rounds_start_from_stored_ranks(spark):
    """Repeated and weighted links against rounds on a matrix; a result's plan holds no round that is done."""
    rows = [("a", "b", 1.0), ("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 4.0), ("c", "a", 1.0), ("d", "a", 2.0), ("c", "e", 3.0)]
    names, m = list("abcde"), np.zeros((5, 5))
    for s, d, w in rows:
        m[names.index(d), names.index(s)] += w
    rank = np.full(5, 0.2)
    for _ in range(3):
        rank = 0.85 * (m / np.where(m.sum(axis=0) > 0, m.sum(axis=0), 1) @ rank + rank[4] / 5) + 0.15 / 5
    ranks = graph.pagerank(spark.createDataFrame(rows, "src string, dst string, w double"), 3, weight="w")
    found = {r["node"]: r["rank"] for r in ranks.collect()}
    assert [found[x] for x in names] == pytest.approx(rank, abs=1e-12)
    assert _joins(ranks) == 0


def test_coauthor_rounds_start_from_stored_ranks(spark):
    papers = spark.createDataFrame([(1, 0, ["x", "y"]), (2, 0, ["y", "x", "v"]), (3, 0, ["z"]), (4, 5, ["x", "z"])], "id int, t int, authors array<string>")
    ranks = graph.coauthor_pagerank(papers, 5, 3)
    w = np.array([[0, 2, 1], [2, 0, 1], [1, 1, 0]])  # x, y, v
    rank = np.full(3, 1.0)
    for _ in range(3):
        rank = 0.85 * (w / w.sum(axis=0)) @ rank + 0.15
    found = {r["author"]: r["rank"] for r in ranks.collect()}
    assert [found[x] for x in "xyv"] == pytest.approx(rank, abs=1e-12) and found["z"] == pytest.approx(0.15)
    assert _joins(ranks) <= 1  # the number of authors


def test_memory_forgets_and_keeps_the_old_one(spark):
    schema = "paper_id string, authors array<string>, terms array<string>, t int"
    first = spark.createDataFrame([("a", ["Ada", "Grace"], ["x"], 100), ("b", ["Ada", "Alan"], ["x", "y"], 101), ("o", ["Rip"], ["z"], 80)], schema)
    memory = incremental.folded(None, first, 101)
    authors = {r["author"]: (r["n"], r["last"], r["deg"]) for r in memory["authors"].collect()}
    assert authors == {"Ada": (2, 101, 2), "Grace": (1, 100, 1), "Alan": (1, 101, 1), "Rip": (1, 80, 0)}
    later = incremental.folded(memory, spark.createDataFrame([("c", ["Ada", "Grace"], ["x"], 120)], schema), 120)
    authors = {r["author"]: (r["n"], r["deg"]) for r in later["authors"].collect()}
    assert authors["Ada"] == (3, 2) and "Rip" not in authors
    assert {r["month"] for r in later["volume"].collect()} == {100, 101, 120}
    assert {r["author"]: r["n"] for r in memory["authors"].collect()}["Ada"] == 2


def test_bags_and_selection(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, float(i % 7 == 0) * 2 + rng.random(), rng.random(), int(i % 7 == 0)) for i in range(210)]
    frame = spark.createDataFrame(rows, "id int, month int, a double, b double, hit int")
    drawn = evaluation.resampled(frame, "hit", "id", 4).groupBy("replica", "hit").count().collect()
    assert len(drawn) == 8 and all(abs(r["count"] - (30 if r["hit"] else 180)) < (25 if r["hit"] else 60) for r in drawn)
    fit = models.logistic(["a"], "hit")
    scored = evaluation.bagged(frame, fit, "hit", "id", frame, ["month"], replicas=3).join(frame, ["month", "id"])
    low, high = (scored.where(f"hit = {h}").agg(F.avg("score")).first()[0] for h in (0, 1))
    assert high > 0.85 > low and scored.where("spread < 0").count() == 0
    gains = {("a",): 0.6, ("b",): 0.5, ("c",): 0.5, ("a", "b"): 0.7, ("a", "c"): 0.65, ("a", "b", "c"): 0.7}
    assert evaluation.forward_selection(["a", "b", "c"], lambda f: gains[tuple(f)], 3) == [("a", 0.6), ("b", 0.7)]
    assert evaluation.leave_one_feature_out(["a", "b"], lambda f: {("a", "b"): 0.7, ("a",): 0.6, ("b",): 0.4}[tuple(f)])[0][0] == "a"
    hidden = evaluation.missing_authors(frame, {"a": -1.0}, "id", 0.5, "s").where("a = -1").count()
    assert 60 < hidden < 150
    assert evaluation.by_age(frame, "month").orderBy(F.desc("score")).first()["month"] == 2
    assert evaluation.single_feature(frame, "a", -1).agg(F.max("score")).first()[0] <= 0


def test_kendall_is_exact(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("fg"), rng.randrange(20), rng.randrange(15)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id int, field string, x int, y int")
    found = {r["field"]: r["tau"] for r in evaluation.kendall(frame, "x", "y", "id", ["field"], block=40).collect()}
    for f in "fg":
        own = [(x, y) for _, g, x, y in rows if g == f]
        s = tx = ty = 0
        for i in range(len(own)):
            for j in range(i):
                a, b = np.sign(own[i][0] - own[j][0]), np.sign(own[i][1] - own[j][1])
                s, tx, ty = s + a * b, tx + abs(a), ty + abs(b)
        assert found[f] == pytest.approx(s / (tx * ty) ** 0.5)


def test_records(spark):
    assert records.parse_list(" a, ,b,") == ["a", "b"] and records.parse_viewport(1, None, 0, 1) is None
    entries = spark.createDataFrame([("http://arxiv.org/abs/2101.00001v2", " A \n title ", "x", "2021-01-01T00:00:00Z", None, ["Ann", " ", "Ann"], ["cs.LG", "stat.ML"])], "id string, title string, abstract string, published string, updated string, authors array<string>, categories array<string>")
    record = records.normalised_entry(entries)
    row = record.first()
    assert (row["paper_id"], row["version"], row["paper_version_id"], row["title"], row["authors"], row["primary_category"]) == ("2101.00001", 2, "2101.00001v2", "A title", ["Ann"], "cs.LG")
    full = record.withColumn("doi", F.lit("10.1/x")).withColumn("raw", F.lit("{}"))
    out = records.fan_out(full.union(full))
    assert {k: v.count() for k, v in out.items()} == {"papers": 1, "paper_versions": 1, "paper_categories": 2, "authors": 1, "authorships": 1, "external_ids": 1, "raw_payloads": 1}
    good, bad = records.accepted(spark.createDataFrame([("1", "t", "a", ["c"], ["v"]), ("2", " ", None, [], None)], "id string, title string, abstract string, categories array<string>, versions array<string>"))
    assert good.count() == 1 and bad.first()["missing"] == ["title", "abstract", "categories", "versions"]
    rows = spark.createDataFrame([(1, "read", "a"), (2, "unread", "b")], "id int, status string, primary string")
    assert records.with_status(rows, "all").count() == 2 and records.with_status(rows, "read").count() == 1
    assert records.focused(rows, "primary", None).count() == 2 and records.scan_limit(10) == 4_000 and records.scan_limit(1_000) == 40_000


def test_approximate_neighbours_recall(spark):
    """Every query against brute force, on clustered vectors of the test tables at two sizes."""
    from sparkloom.operators import vectors

    for sf in ("sf0.01", "sf0.1"):
        v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        q = v.where("vec_id % 50 = 0")
        exact = vectors.neighbours(v, q, "vec_id", "embedding", 10, block=700)
        near = vectors.approximate_neighbours(v, q, "vec_id", "embedding", 10)
        found = exact.join(near.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
        assert found >= 0.9 * exact.count() > 0
