"""Sinks: fixed-size shards with a manifest, raw JSON logs, RSS, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.scalars import xml_escape
from sparkloom.operators.tables import shards


def write_shards(rows: DataFrame, order: list[str], size: int, path: str) -> None:
    """One folder a shard, zstd Parquet."""
    shards(rows, order, size).repartition("shard").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of a folder's Parquet files, hashed on executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_extract("path", r"[^/]+/[^/]+$", 0).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def aggregate_checksum(found: DataFrame) -> DataFrame:
    """One hash of a manifest, whatever its order; a manifest has a row a shard."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "name", "sha256")))
    return found.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("checksum"))


def check_manifest(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(name, status): ok, missing, changed or unexpected."""
    e, p = expected.select("name", F.col("sha256").alias("want")), present.select("name", F.col("sha256").alias("have"))
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") == F.col("have"), "ok").otherwise("changed")
    return e.join(p, "name", "full_outer").select("name", status.alias("status"))


def write_raw_log(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.mode("append").option("compression", "gzip").partitionBy(*by).json(path)


def rss(rows: DataFrame, category: str, most: int = 40) -> DataFrame:
    """(category, rss): the newest items of each category as RSS 2.0; ``most`` is the feed's own length."""
    from pyspark.sql import Window

    newest = rows.withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy(F.col("published").desc(), F.col("id")))).where(F.col("_r") <= most)
    item = F.concat(F.lit("<item><title>"), xml_escape(F.col("title")), F.lit("</title><link>"), xml_escape(F.col("link")), F.lit("</link><guid>"), xml_escape(F.col("id")), F.lit("</guid></item>"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", item.alias("x")))), lambda s: s["x"]), "")
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'), xml_escape(F.col(category)), F.lit("</title>"))
    return newest.groupBy(category).agg(items.alias("_items")).select(category, F.concat(head, F.col("_items"), F.lit("</channel></rss>")).alias("rss"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_model(spark: SparkSession, path: str, weights: dict[str, float], validation: dict[str, float]) -> None:
    """A linear model as one JSON file, names in order, so that two exports of the same model are equal."""
    import json

    from sparkloom.operators.publishing import write_text

    write_text(spark, path, json.dumps({"weights": weights, "validation": validation}, sort_keys=True))
