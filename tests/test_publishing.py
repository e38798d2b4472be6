"""Publishing, manifests, versions of state, shard status and watermarks on a folder."""

import json

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import grid, publishing, records
from sparkloom.plans import shapes
from sparkloom.sources import readers, writers

NOW = datetime(2026, 1, 2, 3, 4, 5)


def test_publish_and_health(spark, sf_dir, tmp_path):
    points = shapes.points(spark, sf_dir)
    edges = grid.edges(points)
    detail, density = grid.binned(points, edges, 20), grid.density(points, edges, 20)
    artefacts = {"map_density": density, "map_points_sample": detail.limit(50), "map_points_detail_index": detail}
    folder = str(tmp_path)
    assert publishing.health(spark, folder) == {"status": "empty", "snapshots": []}
    manifest = publishing.publish(spark, folder, "20260101", artefacts, 10, True, NOW)
    publishing.publish(spark, folder, "20260102", artefacts, 10, False, NOW)
    assert manifest["counts"]["map_points_sample"] == 50 and manifest["counts"]["map_points_detail_index"] == points.count()
    assert manifest["counts"]["latest_papers"] == spark.read.parquet(f"{folder}/20260101/latest_papers.parquet").count() > 0
    assert publishing.health(spark, folder) == {"status": "ok", "snapshots": ["20260102", "20260101"]}


def test_build_only_what_is_missing(spark, tmp_path):
    built = []
    path = str(tmp_path / "a.json")

    def build():
        built.append(1)
        publishing.write_text(spark, path, "x")

    assert publishing.build_if_missing(spark, [path], build) and not publishing.build_if_missing(spark, [path], build)
    assert built == [1] and publishing.read_text(spark, path) == "x" and publishing.read_text(spark, path + "2") is None


def test_manifest_keeps_what_earlier_runs_had(spark, tmp_path):
    path = str(tmp_path / "manifest.json")
    publishing.merged_manifest(spark, path, "t1", ["b", "a"])
    assert publishing.merged_manifest(spark, path, "t2", ["c"])["categories"] == ["a", "b", "c"]
    assert publishing.mostly_failed(2, 5) and not publishing.mostly_failed(2, 4)


def test_versions_of_state(spark, tmp_path):
    folder = str(tmp_path / "memory")
    assert publishing.newest_version(spark, folder) is None
    for v in (1, 2):
        publishing.write_version(spark, spark.range(v), folder, v)
    number, frame = publishing.newest_version(spark, folder)
    assert number == 2 and frame.count() == 2


def test_watermarks(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert publishing.load_watermark(spark, folder, "ingest") is None
    publishing.save_watermark(spark, folder, "ingest", NOW, NOW)
    publishing.save_watermark(spark, folder, "ingest", NOW + timedelta(days=1), NOW + timedelta(days=2))
    publishing.save_watermark(spark, folder, "other", NOW + timedelta(days=9), NOW + timedelta(days=9))
    assert publishing.load_watermark(spark, folder, "ingest") == NOW + timedelta(days=1)
    assert publishing.export_since(NOW, None, None) == NOW
    assert publishing.export_since(None, None, NOW) == NOW - timedelta(hours=48)
    assert publishing.export_since(None, NOW, NOW + timedelta(days=3), 1) == NOW - timedelta(hours=1)
    assert publishing.export_since(None, None, None) is None


def test_vectors_without_documents_are_an_error(spark):
    documents = spark.createDataFrame([(0, "a"), (1, "b")], "shard int, doc_id string")
    vectors = spark.createDataFrame([(0, "a", [1.0]), (2, "c", [1.0])], "shard int, doc_id string, embedding array<float>")
    with pytest.raises(ValueError, match="2"):
        publishing.joined_vectors(documents, vectors)
    assert publishing.joined_vectors(documents, vectors.where("shard = 0")).count() == 1


def test_shards(spark):
    expected = spark.createDataFrame([(x,) for x in "abc"], "name string")
    some, done = expected.where("name = 'b'"), expected
    row = publishing.shard_status(expected, some, "name").first()
    assert (row["status"], row["missing"]) == ("partial", ["a", "c"])
    assert publishing.shard_status(expected, done, "name").first()["status"] == "complete"
    assert [r[0] for r in publishing.pending(expected, some, "name").collect()] == ["a", "c"]
    assert [r[0] for r in publishing.pending(expected, some, "name", 1, 3).collect()] == ["c"]


def test_display_order(spark):
    rows = [(i, "headline" if i < 4 else "rest" if i < 8 else None, i % 2 == 0, float(10 - i), "f") for i in range(10)]
    frame = spark.createDataFrame(rows, "id int, tier string, newcomer boolean, score double, field string")
    placed = [r["id"] for r in publishing.display_order(frame, "tier", "newcomer", "score", "id", ["field"]).orderBy("place").collect()]
    assert set(placed[:4]) == {0, 1, 2, 3} and set(placed[4:8]) == {4, 5, 6, 7} and placed[8:] == [8, 9]


def test_workspace(spark, sf_dir):
    points = shapes.points(spark, sf_dir).withColumn("categories", F.array(F.lit("cs.LG")))
    edges = grid.edges(points)
    feed = grid.latest_feed(grid.binned(points, edges, 20), grid.density(points, edges, 20), "submitted_at", 10)
    shown = publishing.workspace(points, feed, ["ai-ml"], (2016, 2018), "", records.parse_viewport(-0.1, 0.1, -0.1, 0.1), 5, 3)
    assert shown["controls"].first()["papers"] == points.count()
    assert shown["mode"] in ("Zoom for focus", "Search focus") and shown["map"].count() <= 5 and shown["latest"].count() <= 3
    assert publishing.progress(300, 10.0, 100, 1000) == (20.0, 30.0) and publishing.progress(5, 0.0) == (5.0, None)


def test_discovery_snapshots_and_fallbacks(spark, tmp_path):
    root = str(tmp_path)
    assert readers.discovered(spark, root + "/none", ("a.json",), ("meta",)) == []
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "Paper-Metadata.json").write_text("{}")
    (tmp_path / "deep" / "other.json").write_text("{}")
    assert [x.rsplit("/", 1)[1] for x in readers.discovered(spark, root, ("a.json",), ("paper", "metadata"))] == ["Paper-Metadata.json"]
    (tmp_path / "a.json").write_text("{}")
    assert readers.discovered(spark, root, ("b.json", "a.json"), ("meta",)) == [f"{root}/a.json"]
    (tmp_path / "cs.LG.json").write_text('{"category": "cs.LG", "fetchedAt": "t", "papers": [{"id": "1"}, {"id": "2"}]}')
    (tmp_path / "cs.CV.json").write_text('{"category": "cs.CV", "papers": [')
    papers, missing = readers.snapshots(spark, root, ["cs.LG", "cs.CV", "hep-th"], "id string")
    assert sorted(r["id"] for r in papers.collect()) == ["1", "2"] and missing == ["cs.CV", "hep-th"]
    spark.range(3).select("id", F.lit(2.5).alias("paper_score")).write.parquet(root + "/weekly")
    found = readers.with_fallback(spark, root + "/latest", root + "/weekly", "id long, score double, extra int", {"paper_score": "score"}, {"extra": 0})
    assert {(r["score"], r["extra"]) for r in found.collect()} == {(2.5, 0)}
    assert readers.with_fallback(spark, root + "/x", root + "/y", "id long", {}, {}).count() == 0
    points = readers.synthetic_points(spark)
    assert points.count() == 3_000 and points.select("cluster").distinct().count() == 5


def test_listing(spark, tmp_path):
    path = tmp_path / "list.json"
    path.write_text('[{"id": "1", "title": "A  b", "summary": "s", "author": "[{\'name\': \'Ann O\'}, {\'name\': \\"O\'Neil\\"}]", "tag": "[{\'term\': \'cs.LG\', \'x\': None}]", "year": 2018}, {"id": "1", "title": "again"}]')
    row = readers.listing(spark, str(path)).collect()
    assert len(row) == 1 and row[0]["title"] == "A b"
    assert row[0]["categories"] == ["cs.LG"] and row[0]["authors"] == ["Ann O", "O'Neil"]


def test_listing_keeps_the_first_version(spark, tmp_path):
    path = tmp_path / "versions.json"
    rows = [{"id": f"1801.0000{i % 3}v{i + 1}", "title": f"T{i}", "summary": " s  t\n", "author": "[]", "tag": "[{'term': 'a.B'}, {'term': \"c'D\"}]" if i else "[]", "year": 2018, "month": 2, "day": 3} for i in range(9)]
    path.write_text(json.dumps(rows))
    found = {r["id"]: r for r in readers.listing(spark, str(path)).collect()}
    assert {k: r["title"] for k, r in found.items()} == {"1801.00000": "T0", "1801.00001": "T1", "1801.00002": "T2"}
    assert found["1801.00000"]["primary"] == "" and found["1801.00001"]["primary"] == "a.B" and found["1801.00001"]["categories"] == ["a.B", "c'D"]
    assert found["1801.00001"]["abstract"] == "s t" and found["1801.00001"]["month"] == 2


def test_seeds_don_t_follow_partitions(spark):
    sums = []
    for parts in (2, 5):
        points = readers.synthetic_points(spark).repartition(parts)
        sums.append({r["doc_id"]: (r["x"], r["y"]) for r in points.collect()})
    assert sums[0] == sums[1] and len({x for x, _ in sums[0].values()}) > 2_900


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    writers.write_csv(rows, str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 2
    writers.write_model(spark, str(tmp_path / "model.json"), {"b": 0.25, "a": -1.0}, {"auc": 0.8})
    assert publishing.read_text(spark, str(tmp_path / "model.json")) == '{"validation": {"auc": 0.8}, "weights": {"a": -1.0, "b": 0.25}}'
    archive = spark.createDataFrame([], "id int, payload_hash string")
    fresh = records.new_payloads(archive, rows.union(rows), ["id"], "name")
    assert fresh.count() == 2 and records.new_payloads(fresh, rows, ["id"], "name").count() == 0
