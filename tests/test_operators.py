"""Operators on small frames: quota loop, streams, sources, sinks and graphs."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph, grid, ranking, tables, vectors
from sparkloom.sources import readers, writers
from sparkloom.streaming import incremental


def quota_loop(old, new, quota):
    out, placed, j = [], 0, 0
    while len(out) < old + new:
        if j < new and ((placed + 1) * quota > j + 0.5 or len(out) - j >= old):
            out.append(("new", j))
            j += 1
        else:
            out.append(("old", len(out) - j))
        placed += 1
    return out


@pytest.mark.parametrize(("old", "new"), [(20, 20), (0, 5), (5, 0), (3, 40), (50, 4)])
def test_interleave_is_the_loop(spark, old, new):
    rows = [(i, False) for i in range(old)] + [(100 + i, True) for i in range(new)]
    frame = spark.createDataFrame(rows, "id int, newcomer boolean").withColumn("g", F.lit(1))
    found = ranking.interleave(frame, "newcomer", ["g"], [F.col("id")]).orderBy("position").collect()
    assert [("new", r["id"] - 100) if r["newcomer"] else ("old", r["id"]) for r in found] == quota_loop(old, new, 0.3)


def test_partial_lane_needs_evidence(spark):
    frame = spark.createDataFrame([(i, 1, float(i % 3) if i < 6 else None) for i in range(20)] + [(100 + i, 2, float(i)) for i in range(9)], "id int, g int, v double")
    found = {r["id"]: r["lane"] for r in ranking.partial_lane(frame, "v", ["g"], "lane").collect()}
    assert all(found[i] is None for i in range(20))
    assert found[108] == 1 and found[100] == 9


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, v int")
    source = spark.createDataFrame([(2, "B", None), (3, "c", 3)], "k int, name string, v int")
    once = tables.upsert(target, source, ["k"], ["name", "v"], keep_known=True)
    twice = tables.upsert(once, source, ["k"], ["name", "v"], keep_known=True)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "B", 2), (3, "c", 3)]


def test_row_numbers_are_dense(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    found = [tuple(r) for r in tables.row_numbers(frame, ["x"], "n").collect()]
    assert all(x == n for x, n in found) and len(found) == 1000
    sizes = tables.shards(frame, ["x"], 300).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in sizes) == [100, 300, 300, 300]


def test_grid_of_a_constant_axis(spark):
    frame = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "x double, y double")
    cells = grid.density(frame, grid.edges(frame), 8).collect()
    assert sum(r["doc_count"] for r in cells) == 2 and all(0 <= r["bin_y"] < 8 for r in cells)
    modes = [grid.map_mode(False, False, 5, 10), grid.map_mode(True, False, 0, 10), grid.map_mode(True, False, 50, 10), grid.map_mode(True, True, 5, 10), grid.map_mode(True, False, 5, 10)]
    assert modes == ["Global preview", "No exact papers", "Zoom for focus", "Search focus", "Exact paper view"]


def test_pagerank_sums_to_one(spark):
    frame = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(frame, 30).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks[1] < ranks[2]
    assert graph.pagerank(frame.limit(0), 3).count() == 0


def test_pairs_and_thinning(spark):
    row = spark.range(1).select(graph.pairs_of(F.array(*[F.lit(x) for x in (3, 1, 2, 1)])).alias("p"), graph.thinned(F.sequence(F.lit(0), F.lit(9)), 4).alias("t")).first()
    assert [tuple(p) for p in row["p"]] == [(1, 2), (1, 3), (2, 3)] and row["t"] == [0, 2, 5, 7]


def test_authors_without_papers(spark):
    papers = spark.createDataFrame([(1, 0, ["a", "b"]), (2, 1, ["a"]), (3, 5, []), (4, 5, ["z", "a"])], "id int, t int, authors array<string>")
    state = graph.author_state(papers, 5)
    assert {r["author"]: (r["n"], r["last"], r["deg"]) for r in state.collect()} == {"a": (2, 1, 1), "b": (1, 0, 1)}
    found = {r["id"]: r for r in graph.author_features(papers.where("t = 5"), state, 5, "id").collect()}
    assert found[3]["author_new_frac"] == 1 and found[3]["team_size"] == 0 and found[4]["author_new_frac"] == 0.5


def test_vector_norms(spark):
    frame = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])], "id int, v array<double>")
    assert {r["id"] for r in vectors.bad_norms(frame, "v").collect()} == {1, 3}
    assert frame.select(vectors.normalised(F.col("v")).alias("u")).first()["u"] == pytest.approx([0.6, 0.8])


def test_incremental_bounds():
    at = datetime.datetime(2024, 1, 10)
    assert incremental.resume_from(None, None, at) == datetime.datetime(2024, 1, 8)
    assert incremental.resume_from(datetime.datetime(2024, 1, 5), at, at) == datetime.datetime(2024, 1, 3)
    assert incremental.next_watermark(None, at, truncated=True) is None
    windows = incremental.month_windows(datetime.datetime(2023, 12, 15), datetime.datetime(2024, 2, 3))
    assert [w[0].day for w in windows] == [15, 1, 1] and windows[0][1] == datetime.datetime(2023, 12, 31, 23, 59, 59) and windows[-1][1].day == 3


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    events.unionByName(events.limit(50)).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    incremental.run_available(incremental.deduplicated(stream, ["event_id"], "ts", "4000 days"), lambda batch, _: batch.write.mode("append").parquet(out), str(tmp_path / "check"))
    assert spark.read.parquet(out).count() == events.select("event_id").distinct().count()
    counts = str(tmp_path / "counts")
    wide = incremental.windowed_counts(stream, "ts", ["event_type"], "1 day", "4000 days")
    incremental.run_available(wide, lambda batch, _: batch.select("event_type", "n").write.mode("append").parquet(counts), str(tmp_path / "check2"), "update")
    assert spark.read.parquet(counts).agg(F.sum("n")).first()[0] == events.count() + 50


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"id": "1", "n": 2},\n\n{"id": "2"}\n]\n')
    assert [tuple(r) for r in readers.json_lines(spark, str(tmp_path / "a.json"), "id string, n int").collect()] == [("1", 2), ("2", None)]
    (tmp_path / "bad.json").write_text("{oops\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        readers.json_lines(spark, str(tmp_path / "bad.json"), "id string").collect()
    (tmp_path / "e.txt").write_text("# c\n1 2\n3\t4\nx y\n")
    assert sorted(map(tuple, readers.edge_list(spark, str(tmp_path / "e.txt")).collect())) == [(1, 2), (3, 4)]
    (tmp_path / "l.tsv").write_text("1501.00001\tT\t12\tzscore: -1.5\nheader\tx\n")
    assert [tuple(r) for r in readers.label_lines(spark, str(tmp_path / "l.tsv")).collect()] == [("1501.00001", "T", 12, -1.5)]
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "p"))
    assert readers.tolerant_parquet(spark, str(tmp_path / "p"), "id long, more string").columns == ["id", "more"]
    assert readers.tolerant_parquet(spark, str(tmp_path / "none"), "id long").count() == 0
    frame = spark.createDataFrame([("['a', 'b']",), ("[\"it's\", 'c']",)], "v string")
    odd = spark.createDataFrame([("""["Mary O'Brien", 'Ann Lee', 'He said "so"', 'it\\'s', '']""",), ("[]",), (None,)], "v string")
    assert [r[0] for r in odd.select(readers.python_strings(F.col("v"))).collect()] == [["Mary O'Brien", "Ann Lee", 'He said "so"', "it's", ""], [], None]
    assert [r[0] for r in frame.select(readers.python_strings(F.col("v"))).collect()][0] == ["a", "b"]


def test_atom(spark):
    feed = """<feed><entry><id>http://x/1</id><title>A
 b</title><summary>s</summary><published>2024-01-01T00:00:00Z</published><author><name>N</name></author><author><name>M</name></author><category term="cs.LG"/></entry>
 <entry><id>http://x/api/errors</id><title>E</title></entry></feed>"""
    rows = readers.atom_entries(spark.createDataFrame([(feed,)], "x string"), "x").collect()
    assert len(rows) == 1 and rows[0]["title"] == "A b" and rows[0]["authors"] == ["N", "M"] and rows[0]["categories"] == ["cs.LG"]


def test_shards_and_manifest(spark, tmp_path):
    path = str(tmp_path / "shards")
    writers.write_shards(spark.range(250).withColumn("y", F.col("id") % 3), ["y", "id"], 100, path)
    found = writers.manifest(spark, path)
    assert found.count() == 3 and len(writers.aggregate_checksum(found).first()["checksum"]) == 64
    assert {r["status"] for r in writers.check_manifest(found, found).collect()} == {"ok"}
    assert writers.check_manifest(found, found.limit(0)).first()["status"] == "missing"


def test_rss_and_union(spark):
    rows = spark.createDataFrame([("cs", f"{i}", f"t<{i}>", "l", f"2024-01-{i:02d}") for i in range(1, 6)], "c string, id string, title string, link string, published string")
    text = writers.rss(rows, "c", 2).first()["rss"]
    assert text.count("<item>") == 2 and text.index("t&lt;5&gt;") < text.index("t&lt;4&gt;")
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, readers.first_wins([a, b], "k").collect())) == [(1, "a"), (2, "b")]


def test_raw_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for _ in range(2):
        writers.write_raw_log(spark.createDataFrame([("d1", "x")], "run_date string, payload string"), path, ["run_date"])
    assert spark.read.json(path).count() == 2 and json.dumps({})


def test_components_of_small_samples(spark):
    rows = spark.createDataFrame([(i, [float(i), float(i * i), 1.0]) for i in range(6)], "id int, v array<double>")
    assert {len(r["pca"]) for r in vectors.principal_components(rows, rows.limit(0), "v", 2).collect()} == {0}
    assert {len(r["pca"]) for r in vectors.principal_components(rows, rows.limit(2), "v", 2).collect()} == {1}
    found = vectors.principal_components(rows, rows, "v", 2).collect()
    spread = [sum((r["pca"][i] - sum(x["pca"][i] for x in found) / 6) ** 2 for r in found) for i in (0, 1)]
    points = [(i - 2.5, i * i - 55 / 6) for i in range(6)]
    assert sum(spread) == pytest.approx(sum(a * a + b * b for a, b in points)) and spread[0] > spread[1]  # two components hold all that varies


def test_tfidf_centroid_shuffles_no_unit_vectors(spark):
    docs = spark.createDataFrame([(1, ["aa", "bb", "aa"]), (2, ["bb", "cc"]), (3, ["aa", "zz"]), (4, []), (5, None), (2, ["cc"])], "k long, terms array<string>")
    found = vectors.tfidf_similarity(docs, "k", "terms")
    # Stored counts meet the centroid, then a row a document: nothing is derived again.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3
    n, tf = 6, {1: {"aa": 2, "bb": 1}, 2: {"bb": 1, "cc": 2}, 3: {"aa": 1, "zz": 1}}
    df = {t: sum(t in c for c in tf.values()) for t in ("aa", "bb", "cc", "zz")}
    w = {k: {t: x * (math.log((1 + n) / (1 + df[t])) + 1) for t, x in c.items() if df[t] >= 2} for k, c in tf.items()}
    unit = {k: {t: x / math.hypot(*c.values()) for t, x in c.items()} for k, c in w.items()}
    centre = {t: sum(u.get(t, 0) for u in unit.values()) / n for t in df}
    size = math.hypot(*centre.values())
    assert {r["k"]: r["centroid_similarity"] for r in found.collect()} == pytest.approx({k: sum(x * centre[t] for t, x in u.items()) / size for k, u in unit.items()})


def test_recent_similarity_makes_no_unit_vectors(spark):
    docs = spark.createDataFrame([(1, 1, ["aa", "bb"]), (2, 2, ["bb", "aa", "aa"]), (3, 3, ["aa", "cc"]), (4, 3, ["cc"]), (5, 3, None)], "k long, t int, terms array<string>")
    found = vectors.recent_similarity(docs, "k", "terms", 3, 2, least=1)
    # Documents meet their own product; that is stored counts with a centroid and a length: no counts of the months before are in the plan.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 6
    first, second = (1, 1), (2, 1)  # both terms are in both documents, so their weights are equal
    centre = [a / math.hypot(*first) + b / math.hypot(*second) for a, b in zip(first, second, strict=True)]
    assert {r["k"]: r["similarity"] for r in found.collect()} == pytest.approx({3: centre[0] / math.hypot(*centre), 4: 0.0, 5: 0.0})
