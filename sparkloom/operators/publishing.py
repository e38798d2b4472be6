"""Snapshots on their way out: vectors joined to documents, feeds, manifests, pulses, memory, shard status, watermarks."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.operators import grid
from sparkloom.operators.ordering import numbered
from sparkloom.operators.ranking import QUOTA, interleave

BANDS = ("headline", "notable", "rest")


def _file(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _file(spark, path)
    return bool(system.exists(found))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's folders, newest (largest name) first; none if it isn't there. Only Hadoop's file systems touch the path."""
    found, system = _file(spark, path)
    if not system.exists(found):
        return []
    return sorted((s.getPath().getName() for s in system.listStatus(found) if s.isDirectory()), reverse=True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced whole."""
    found, system = _file(spark, path)
    out = system.create(found, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def joined_vectors(documents: DataFrame, vectors: DataFrame, shard: str = "shard") -> DataFrame:
    """Documents with their vectors, by shard and doc_id; a vector shard without a document shard is an error.

    ``shard`` is part of the key, so tables bucketed or partitioned by it meet without an exchange."""
    lacking = vectors.select(shard).distinct().join(documents.select(shard).distinct(), shard, "left_anti").orderBy(shard).limit(5).collect()
    if lacking:
        raise ValueError(f"vector shards without documents: {', '.join(str(r[0]) for r in lacking)}")
    return documents.join(vectors, [shard, "doc_id"])


def build_if_missing(spark: SparkSession, paths: list[str], build: Callable[[], None]) -> bool:
    """Runs ``build`` unless all ``paths`` are there; says whether it ran."""
    if all(exists(spark, p) for p in paths):
        return False
    build()
    return True


def publish(spark: SparkSession, folder: str, snapshot_id: str, artefacts: dict[str, DataFrame], window_days: int, rebuilt: bool, now: datetime) -> dict:
    """Writes a snapshot: the artefacts map_density, map_points_sample and map_points_detail_index, the latest feed made of them, and a manifest of counts.

    The manifest comes last, so a snapshot without one isn't whole. Counts are of what was written."""
    paths = {name: f"{folder}/{snapshot_id}/{name}.parquet" for name in (*artefacts, "latest_papers")}
    for name, rows in artefacts.items():
        rows.write.mode("overwrite").parquet(paths[name])
    detail, density = (spark.read.parquet(paths[n]) for n in ("map_points_detail_index", "map_density"))
    grid.latest_feed(detail, density, "submitted_at", window_days).write.mode("overwrite").parquet(paths["latest_papers"])
    manifest = {
        "snapshot_id": snapshot_id,
        "created_at": now.isoformat(),
        "latest_window_days": window_days,
        "counts": {name: spark.read.parquet(path).count() for name, path in sorted(paths.items())},
        "space_rebuilt": rebuilt,
    }
    write_text(spark, f"{folder}/{snapshot_id}/build_manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def category_snapshots(papers: DataFrame, category: str, fetched_at: str, order: list[Column], most: int) -> DataFrame:
    """(category, snapshot): the newest ``most`` papers of each category as one JSON object; ``most`` is the snapshot's own length."""
    place = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    kept = papers.withColumn("_place", place).where(F.col("_place") <= most)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_place", F.struct(*papers.columns).alias("paper")))), lambda x: x["paper"])
    return kept.groupBy(category).agg(rows.alias("papers")).select(category, F.to_json(F.struct(F.col(category).alias("category"), F.lit(fetched_at).alias("fetchedAt"), "papers")).alias("snapshot"))


def merged_manifest(spark: SparkSession, path: str, generated_at: str, succeeded: list[str]) -> dict:
    """The manifest of categories after a run: those before and those that succeeded, sorted; a partial run takes none away."""
    before = json.loads(read_text(spark, path) or "{}").get("categories", [])
    manifest = {"generatedAt": generated_at, "categories": sorted({*before, *succeeded})}
    write_text(spark, path, json.dumps(manifest))
    return manifest


def mostly_failed(succeeded: int, asked: int) -> bool:
    """Whether more than half of a run's categories failed, so that yesterday's snapshot is better."""
    return asked - succeeded > asked / 2


def attached_pulses(papers: DataFrame, pulses: DataFrame, key: str) -> DataFrame:
    """``papers`` with ``pulse``: the struct of the other columns of ``pulses``, null where a paper has none."""
    own = pulses.select(F.col(key).alias("_key"), F.struct(*[c for c in pulses.columns if c != key]).alias("pulse"))
    return papers.join(own, papers[key] == own["_key"], "left").drop("_key")


def write_version(spark: SparkSession, frame: DataFrame, folder: str, version: int) -> str:
    """State written as a version of its own, so that a reader of the last one is never disturbed."""
    path = f"{folder}/version={version:010d}"
    frame.write.mode("overwrite").parquet(path)
    return path


def newest_version(spark: SparkSession, folder: str) -> tuple[int, DataFrame] | None:
    """The newest version that was written to its end."""
    for name in folders(spark, folder):
        if name.startswith("version=") and exists(spark, f"{folder}/{name}/_SUCCESS"):
            return int(name.partition("=")[2]), spark.read.parquet(f"{folder}/{name}")
    return None


def shard_status(expected: DataFrame, produced: DataFrame, name: str) -> DataFrame:
    """(status, expected, produced, missing): ``partial`` with the missing shards' names while any is, else ``complete``; a shard is a row."""
    had = produced.select(F.col(name).alias("_had")).distinct()
    joined = expected.select(name).distinct().join(had, F.col(name) == F.col("_had"), "left")
    counted = joined.agg(F.count("*").alias("expected"), F.count("_had").alias("produced"), F.array_sort(F.collect_list(F.when(F.col("_had").isNull(), F.col(name)))).alias("missing"))
    return counted.select(F.when(F.size("missing") > 0, "partial").otherwise("complete").alias("status"), "expected", "produced", "missing")


def pending(expected: DataFrame, produced: DataFrame, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Shards that aren't finished, by name, out of numbers ``start`` to ``end`` of that order if given."""
    listed = expected.select(name).distinct().withColumn("_number", F.row_number().over(Window.orderBy(name)) - 1)
    wanted = F.lit(True)
    if start is not None:
        wanted = wanted & (F.col("_number") >= start)
    if end is not None:
        wanted = wanted & (F.col("_number") < end)
    return listed.where(wanted).select(name).join(produced.select(name).distinct(), name, "left_anti").orderBy(name)


def load_watermark(spark: SparkSession, folder: str, key: str) -> datetime | None:
    """The newest moment saved under ``key``; none before the first."""
    if not exists(spark, f"{folder}/_SUCCESS"):
        return None
    saved = spark.read.schema("key string, value timestamp, saved_at timestamp").parquet(folder)
    row = saved.where(F.col("key") == key).orderBy(F.desc("saved_at"), F.desc("value")).first()
    return row["value"] if row else None


def save_watermark(spark: SparkSession, folder: str, key: str, value: datetime, now: datetime) -> None:
    """Appends; a run that dies half-way leaves what was saved before."""
    spark.createDataFrame([(key, value, now)], "key string, value timestamp, saved_at timestamp").coalesce(1).write.mode("append").parquet(folder)


def export_since(explicit: datetime | None, embedded: datetime | None, newest_import: datetime | None, overlap_hours: int = 48) -> datetime | None:
    """Where an export begins: what was asked for, else the embedding's watermark, else the newest import, the latter two less the overlap; none is everything."""
    if explicit is not None:
        return explicit
    known = embedded or newest_import
    return None if known is None else known - timedelta(hours=overlap_hours)


def display_order(rows: DataFrame, tier: str, newcomer: str, score: str, key: str, by: list[str], quota: float = QUOTA) -> DataFrame:
    """Adds ``place`` from 1: bands one after the other, newcomers' quota inside each, unscored rows (null tier) last by key."""
    band = F.array_position(F.array(*[F.lit(b) for b in BANDS]), F.col(tier))
    banded = rows.withColumn("_band", F.coalesce(F.nullif(band, F.lit(0)), F.lit(len(BANDS) + 1))).withColumn("_new", F.coalesce(F.col(newcomer), F.lit(False)))
    inside = interleave(banded, "_new", [*by, "_band"], [F.col(score).desc_nulls_last(), F.col(key)], quota)
    order = F.when(F.col(tier).isNull(), F.lit(0)).otherwise(F.col("position"))
    return numbered(inside.withColumn("_order", order), by, [F.col("_band"), F.col("_order"), F.col(key)], "place").drop("_band", "_new", "_order", "position")


def active_lanes(rows: DataFrame, lanes: dict[str, str], by: list[str]) -> DataFrame:
    """(by, lanes): names of the lanes, in order, that have a rank for some row of the cohort."""
    return rows.groupBy(*by).agg(F.array_compact(F.array(*[F.when(F.count(c) > 0, F.lit(name)) for name, c in lanes.items()])).alias("lanes"))


def workspace(points: DataFrame, feed: DataFrame, tokens: list[str], years: tuple | None, text: str, viewport: tuple | None, cap: int, latest: int) -> dict[str, DataFrame | str]:
    """What the dashboard shows at once: controls of all points, the map's mode and points, and the latest rows, under the same filters."""
    from sparkloom.operators import serving

    chosen = points.where(scalars.in_topic(F.col("categories"), tokens)) if tokens else points
    x, y = viewport if viewport else (None, None)
    mode, drawn = serving.map_answer(chosen, x, y, years, text, cap)
    return {"controls": serving.controls(points), "mode": mode, "map": drawn, "latest": latest_rows(feed, tokens, years, text, latest)}


def latest_rows(feed: DataFrame, tokens: list[str], years: tuple | None, text: str, most: int) -> DataFrame:
    """The latest feed under the view's filters, best first; numbers to four places, categories as text."""
    found = grid.viewport(feed, None, None, years, text)
    found = found.where(scalars.in_topic(F.col("categories"), tokens)) if tokens else found
    rounded = found.withColumns({c: F.round(c, 4) for c in ("recency_score", "novelty_score", "score") if c in feed.columns})
    return rounded.withColumn("category_text", F.array_join("categories", ", ")).orderBy(F.desc("score"), F.desc("submitted_at"), "doc_id").limit(most)


def viewport_ranges(points: DataFrame, margin: float = 0.03) -> DataFrame:
    """(x_min, x_max, y_min, y_max) around all points, wider by ``margin`` of the span; a span of 0 counts as 1."""
    bounds = points.agg(*[f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    wide = lambda c: F.when(F.col(f"{c}_hi") > F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo")).otherwise(1.0) * margin
    return bounds.select(*[x for c in ("x", "y") for x in ((F.col(f"{c}_lo") - wide(c)).alias(f"{c}_min"), (F.col(f"{c}_hi") + wide(c)).alias(f"{c}_max"))])


def progress(done: int, seconds: float, before: int = 0, expected: int | None = None) -> tuple[float, float | None]:
    """(rows a second since ``before``, percent of ``expected``)."""
    return (done - before) / max(seconds, 1.0), None if not expected else 100.0 * done / expected


def health(spark: SparkSession, folder: str) -> dict:
    """Whether anything is published, and which snapshots, newest first."""
    found = [name for name in folders(spark, folder) if exists(spark, f"{folder}/{name}/build_manifest.json")]
    return {"status": "ok" if found else "empty", "snapshots": found}
