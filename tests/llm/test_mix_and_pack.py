"""Mixing against its SQL, packing against a plain search, and the pipeline's stages on their own inputs."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import mixing, near_dedup, packing
from sparkloom.llm.common import table


def test_mix_matches_sql(spark, sf_dir, odd_docs, no_docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    expected = con.execute(f"SELECT doc_id, size, source_size, target, taken, source FROM ({mixing.ORACLE}) ORDER BY doc_id").fetchall()
    found = [tuple(r) for r in mixing.mix(table(spark, sf_dir, "documents")).orderBy("doc_id").collect()]
    assert found == expected
    assert mixing.mix(no_docs).count() == 0
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 11 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)


def test_mix_targets_and_takes(spark, sf_dir):
    found = mixing.mix(table(spark, sf_dir, "documents"))
    per = found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert all(abs(r["taken"] - r["target"]) < 1 and r["target"] <= 2 * r["size"] for r in per)
    total = sum(r["size"] for r in per)
    assert sum(r["target"] for r in per) == pytest.approx(1.5 * total)


def test_mix_stops_everything_when_the_budget_is_large(spark):
    frame = spark.createDataFrame([(1, "a b c", "x"), (2, "d", None)], "doc_id long, text string, source string")
    assert {r["doc_id"]: (r["target"], r["taken"]) for r in mixing.mix(frame, budget=9.0).collect()} == {1: (6.0, 6), 2: (2.0, 2)}


def pack_brute(rows, capacity, per_source):
    bins = []
    out = []
    for size, source, cluster in rows:
        fits = [i for i, b in enumerate(bins) if b["left"] >= size and (cluster is None or cluster not in b["clusters"]) and b["sources"].count(source) < per_source]
        at = min(fits, key=lambda i: (bins[i]["left"], i), default=None)
        if at is None:
            at = len(bins)
            bins.append({"left": capacity, "clusters": set(), "sources": []})
        out.append((at, capacity - bins[at]["left"]))
        bins[at]["left"] -= size
        bins[at]["clusters"].add(cluster)
        bins[at]["sources"].append(source)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packing_matches_a_plain_search(seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(1, 100), rng.choice(["a", "a", "b", None]), rng.choice([None, 1, 2, *range(3, 90)])) for _ in range(300)]
    rows.sort(key=lambda r: -r[0])
    assert packing.pack_shard(rows, 100, 3) == pack_brute(rows, 100, 3)


def test_packing_query(spark, sf_dir, odd_docs, no_docs):
    docs = table(spark, sf_dir, "documents")
    found = packing.pack(docs, capacity=512, shard=50)
    sizes = {r["doc_id"]: r["n"] for r in docs.select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect()}
    rows = found.collect()
    assert sum(r["n_words"] for r in rows) == sum(sizes.values()) and {r["doc_id"] for r in rows} == set(sizes)
    fill = {}
    for r in sorted((r for r in rows if r["bin_id"] is not None), key=lambda r: (r["bin_id"], r["offset"])):
        assert fill.get(r["bin_id"], 0) == r["offset"]
        fill[r["bin_id"]] = r["offset"] + r["n_words"]
    assert max(fill.values()) <= 512
    clusters = {r["doc_id"]: r["c"] for r in docs.select("doc_id", packing.text_cluster(F.col("text")).alias("c")).collect()}
    seen = [(r["bin_id"], clusters[r["doc_id"]]) for r in rows if r["n_words"] and r["n_words"] < 512]
    assert len(seen) == len(set(seen))
    assert packing.pack(odd_docs).where("n_words = 0").count() == 3 and packing.pack(no_docs).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["identify_language", "dedup_lines", "dedup_near", "mix_sources", "pack_bins"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir).cache()
        if name != "pack_bins":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        if name == "identify_language":
            assert after.count() == before.count()  # every document of the table has a language
        if name == "dedup_near":
            assert near_dedup.near_duplicates(after).where("NOT kept").count() == 0
        before = after
    assert before.count() > 100


def test_pipeline_stages_on_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, sf_dir)
            assert found.count() >= 0, name
            assert name == "pack_bins" or found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
