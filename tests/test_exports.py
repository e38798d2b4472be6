"""Exported shards, their manifest and its validation, and runs that fail."""

import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.sources import exports


def vectors(spark, n, length=3):
    return spark.range(n).select(F.format_string("d%04d", "id").alias("doc_id"), F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(length)]).alias("embedding"))


def status(spark, path, **options):
    return {r["name"]: (r["rows"], r["status"]) for r in exports.validated(spark, str(path), "embedding", **options).collect()}


def read(path, name):
    return json.loads((path / name).read_text())


def test_shards_and_manifest(spark, tmp_path):
    exports.export(vectors(spark, 25).repartition(5), ["doc_id"], 10, str(tmp_path), "embedding", snapshot_id="s1")
    found = read(tmp_path, "manifest.json")
    assert [(s["name"], s["rows"], s["dimension"]) for s in found["shards"]] == [("shard_00000.parquet", 10, 3), ("shard_00001.parquet", 10, 3), ("shard_00002.parquet", 5, 3)]
    assert found["rows"] == 25 and found["dimension"] == 3 and found["snapshot_id"] == "s1"
    assert all(s["bytes"] == os.path.getsize(tmp_path / s["name"]) for s in found["shards"])
    assert pq.read_table(tmp_path / "shard_00001.parquet")["doc_id"].to_pylist() == [f"d{i:04d}" for i in range(10, 20)]
    assert read(tmp_path, "status.json") == {"status": "exported", "snapshot_id": "s1", "rows": 25}
    assert not [x for x in os.listdir(tmp_path) if x.startswith("attempt") or x.endswith(".new")]
    assert set(status(spark, tmp_path, dimension=3, unit=True).values()) == {(10, "ok"), (5, "ok"), (25, "ok")}
    assert status(spark, tmp_path, dimension=4)["shard_00002.parquet"] == (5, "dimension")


@pytest.mark.parametrize("harm", ["missing", "checksum", "unexpected", "rows", "declared", "dimension"])
def test_what_validation_finds(spark, tmp_path, harm):
    exports.export(vectors(spark, 20), ["doc_id"], 10, str(tmp_path), "embedding")
    manifest, shard = read(tmp_path, "manifest.json"), tmp_path / "shard_00001.parquet"
    if harm == "missing":
        shard.unlink()
    elif harm == "checksum":
        pq.write_table(pq.read_table(shard), shard, compression="none")
    elif harm == "unexpected":
        pq.write_table(pq.read_table(shard), tmp_path / "shard_00009.parquet")
    else:
        if harm == "declared":
            manifest["rows"] = 21
        elif harm == "rows":
            manifest["shards"][1]["rows"] = 9
        else:
            manifest["shards"][1]["dimension"] = 4
        (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    found = status(spark, tmp_path)
    if harm == "declared":
        assert found[""][1] == "count" and {s for n, (_, s) in found.items() if n} == {"ok"}
    else:
        name = "shard_00009.parquet" if harm == "unexpected" else "shard_00001.parquet"
        assert found[name][1] == harm and found["shard_00000.parquet"][1] == "ok" and found[""][1] == "shards"


def test_a_killed_task_leaves_no_manifest(spark, tmp_path):
    exports.export(vectors(spark, 20), ["doc_id"], 10, str(tmp_path), "embedding")
    broken = vectors(spark, 20).withColumn("embedding", F.when(F.col("doc_id") == "d0015", F.array(F.lit(1.0))).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="several lengths"):
        exports.export(broken, ["doc_id"], 10, str(tmp_path), "embedding", snapshot_id="s2")
    assert exports.manifest_of(spark, str(tmp_path)) is None
    assert read(tmp_path, "status.json")["status"] == "failed"
    assert status(spark, tmp_path) == {"": (None, "no manifest")}
    exports.export(vectors(spark, 20), ["doc_id"], 10, str(tmp_path), "embedding", snapshot_id="s3")  # again, into the same folder
    assert set(s for _, s in status(spark, tmp_path).values()) == {"ok"}


def test_empty_and_odd_tables(spark, tmp_path):
    exports.export(vectors(spark, 0), ["doc_id"], 10, str(tmp_path / "none"), "embedding")
    assert read(tmp_path / "none", "status.json")["status"] == "exported_empty"
    assert status(spark, tmp_path / "none") == {"": (0, "ok")}
    odd = spark.createDataFrame([(None, None), ("a", None), ("a", None)], "doc_id string, embedding array<double>")
    exports.export(odd, ["doc_id"], 2, str(tmp_path / "odd"), "embedding")
    found = read(tmp_path / "odd", "manifest.json")
    assert found["rows"] == 3 and found["dimension"] is None and len(found["shards"]) == 2
