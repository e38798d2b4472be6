"""Bucketed joins without exchanges, and searches by an index of trigrams against scans."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import aligned


def test_buckets_meet_without_an_exchange(spark):
    documents = spark.range(0, 500, 2).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    vectors = spark.range(0, 500, 3).select(F.col("id").alias("doc_id"), F.lit(1).alias("label"))
    names = aligned.bucketed(documents, "doc_id", 8), aligned.bucketed(vectors, "doc_id", 8)
    found = aligned.aligned_join(spark, *names, "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(0, 500, 6))


def test_a_missing_document_shard_is_an_error(spark):
    few = spark.createDataFrame([(1, "en")], "doc_id long, lang string")
    vectors = spark.range(100).select(F.col("id").alias("doc_id"))
    names = aligned.bucketed(few, "doc_id", 8), aligned.bucketed(vectors, "doc_id", 8)
    with pytest.raises(ValueError, match="without documents"):
        aligned.aligned_join(spark, *names, "doc_id")
    assert aligned.aligned_join(spark, names[1], names[0], "doc_id").count() == 1


def made_up():
    draw = random.Random(9)
    words = ["alpha", "Beta", "the", "ÜBER", "日本語", "a\nb", "x"]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(9))), draw.choice(["", "Title of the text", None])) for i in range(300)]
    return [*rows, (300, None, None), (300, "twice alphab", "t"), (None, "no id alphab", "t"), (301, "ab", "xy")]


NEEDLES = ["alphab", "ALPHA b", "über 日本", "本語", "a", "", "zzz", "a\nb", "title OF", "the the"]


def test_search_against_a_scan(spark, tmp_path):
    rows = made_up()
    frame = spark.createDataFrame(rows, "id long, body string, title string")
    index = aligned.TextIndex.build(frame, "id", ["body", "title"], str(tmp_path))
    for needle in NEEDLES:
        found = sorted((r["id"], r["body"] or "") for r in index.search(spark, needle).where("id IS NOT NULL").collect())
        assert found == sorted((i, b or "") for i, b, t in rows if i is not None and any(needle.lower() in x.lower() for x in (b, t) if x is not None)), needle


def test_a_rare_needle_reads_few_files(spark, tmp_path):
    frame = spark.range(2_000).select("id", F.concat(F.lit("common words "), F.when(F.col("id") == 77, "needle").otherwise(F.lit("hay"))).alias("body"))
    index = aligned.TextIndex.build(frame, "id", ["body"], str(tmp_path))
    found = index.search(spark, "a n").collect(), index.search(spark, "needle")
    assert found[0] == [] and [r["id"] for r in found[1].collect()] == [77]
    every = spark.read.parquet(f"{tmp_path}/texts").inputFiles()
    plan = found[1]._jdf.queryExecution().executedPlan().toString()
    # One partition of texts and no more: the filter on it is a partition filter of the scan.
    assert len(every) >= 10 and "PartitionFilters: [" in plan
    place = spark.range(1).select(aligned._block(F.lit(77).cast("long"), index.blocks)).first()[0]
    assert f"block#" in plan and f"= {place})" in plan or f"({place})" in plan


def test_empty_table(spark, tmp_path):
    index = aligned.TextIndex.build(spark.createDataFrame([(1, None)], "id long, body string"), "id", ["body"], str(tmp_path))
    assert index.search(spark, "needle").count() == 0 and index.search(spark, "n").count() == 0


def test_no_rows_at_all(spark, tmp_path):
    index = aligned.TextIndex.build(spark.createDataFrame([], "id long, body string"), "id", ["body"], str(tmp_path))
    assert index.search(spark, "needle").count() == 0 and index.search(spark, "n").count() == 0


def test_trigrams_of_a_long_text_take_one_pass(spark):
    import time

    long = "".join(chr(97 + i * i % 26) for i in range(200_000))
    texts = [None, "", "a", "ab", "ABc", "aaaa", "日本語日", "\U0001F600x\U0001F601Yz", "a\nb c", long]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", aligned.trigrams(F.col("t")).alias("grams"))
    began = time.monotonic()
    for r in made.collect():
        low = None if texts[r["i"]] is None else texts[r["i"]].lower()
        assert (None if r["grams"] is None else sorted(r["grams"])) == (None if low is None else sorted({low[k : k + 3] for k in range(len(low) - 2)}))
    assert time.monotonic() - began < 30  # by the square of its length, the long text takes minutes
