"""Keys of segments cut by bytes and by characters, and how probing rows meet the index."""

from pyspark.sql import functions as F

from sparkloom.llm import lines


def test_keys_are_those_of_characters(spark):
    """A line without other letters than ASCII has the keys that a cut by characters gives it, as have others."""
    texts = ["plain ascii line of some length", "fünf Äpfel liegen auf dem Tisch", "one \U0001f600 wide letter in this line", "ab", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "line string").withColumn("length", F.char_length("line"))
    for place in lines._places(2):
        shorter_by, i, move = [F.lit(x) for x in place]
        total, start, size = lines._segment(F.col("length"), shorter_by, i, move, 2)
        expected = F.xxhash64(total, i, F.substring(F.col("line"), start, size))
        own = lines.segment_key(F.col("line"), F.col("length"), shorter_by, i, move, 2)
        assert rows.where((F.col("length") >= 2) & (own != expected)).isEmpty()


def test_probing_rows_are_not_sorted(spark):
    docs = spark.createDataFrame([(n, f"common start of every line, then the number {n:05d} and an end") for n in range(60)], "doc_id long, text string")
    firsts = lines._first_places(docs, 20, 1, 2).where("near").drop("near")
    found = lines.near_places(docs, firsts, 2, 20)
    assert "strategy=shuffle_hash" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 59
