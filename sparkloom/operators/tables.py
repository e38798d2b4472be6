"""Versioned tables: merges, latest versions, set operations, samples, shards, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import checkpoint_dir


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], keep_known: bool = False) -> DataFrame:
    """Rows of ``target`` with those of ``source`` inserted or, on equal keys, ``update`` columns replaced.

    ``keep_known``: a null in ``source`` doesn't overwrite. ``source`` rows must be unique by key; see ``last_by``."""
    new = source.select(F.struct(*[source[c] for c in target.columns]).alias("new"))
    old = target.select(F.struct(*[target[c] for c in target.columns]).alias("old"))
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    joined = old.join(new, on, "full_outer")

    def value(c: str) -> Column:
        fresh, had = F.col(f"new.{c}"), F.col(f"old.{c}")
        if c in update:
            return F.coalesce(fresh, had) if keep_known else F.when(F.col("new").isNotNull(), fresh).otherwise(had)
        return F.when(F.col("old").isNotNull(), had).otherwise(fresh)

    return joined.select(*[value(c).alias(c) for c in target.columns])


def change_kinds(target: DataFrame, source: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``source`` with ``change``: inserted, updated (content differs) or same."""
    had = target.select(*[F.col(k).alias(f"had_{k}") for k in keys], F.col(content).alias("had_content"))
    on = [source[k] == had[f"had_{k}"] for k in keys]
    change = F.when(F.col("had_content").isNull(), "inserted").when(F.col("had_content") != source[content], "updated").otherwise("same")
    return source.join(had, on, "left").withColumn("change", change).drop(*[f"had_{k}" for k in keys], "had_content")


def last_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row in ``order`` of each key: newest version, newest-first distinct, first source wins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def latest_versions(rows: DataFrame, key: str, version: str) -> DataFrame:
    """All rows that share their key's largest version; one shuffle, ties stay."""
    top = F.max(version).over(Window.partitionBy(key))
    return rows.withColumn("_top", top).where(F.col(version) == F.col("_top")).drop("_top")


def replace_children(target: DataFrame, incoming: DataFrame, parent: str, child: str, order: str) -> DataFrame:
    """Children of parents in ``incoming`` are replaced; a child listed twice keeps its last place."""
    fresh = incoming.groupBy(parent, child).agg(F.max(order).alias(order))
    return target.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(fresh.select(*target.columns), allowMissingColumns=True)


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"))


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def not_in_every_source(candidates: DataFrame, done: DataFrame, key: str, source: str, sources: list[str]) -> DataFrame:
    """Candidates that at least one of ``sources`` hasn't done; counts instead of a cross join."""
    n = done.where(F.col(source).isin(sources)).groupBy(key).agg(F.countDistinct(source).alias("_n"))
    return candidates.join(n, key, "left").where(F.coalesce("_n", F.lit(0)) < len(sources)).drop("_n")


def hash_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` rows of smallest SHA-1 prefix of their key, in that order; fixed-width hex sorts like the number."""
    prefix = F.substring(F.sha1(F.col(key).cast("string").cast("binary")), 1, 16)
    return rows.withColumn("sample_key", prefix).orderBy("sample_key", key).limit(size)


def row_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers from 0 in ``order`` without one task seeing all rows: range partitions are numbered each, then offset by sums.

    The partition's number is stored with its rows by a checkpoint: planned anew, bounds and coalescing may differ from one branch
    to the other, and the counts would belong to other partitions than the rows."""
    checkpoint_dir(rows.sparkSession)
    spread = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = spread.withColumn("_inside", inside).join(F.broadcast(starts.select("_part", "_start")), "_part")
    return numbered.withColumn(name, F.col("_inside") + F.col("_start")).drop("_part", "_inside", "_start")


def shards(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``rows`` with their shard's number, exactly ``size`` rows a shard in ``order``."""
    return row_numbers(rows, order, "_number").withColumn("shard", F.floor(F.col("_number") / size).cast("int")).drop("_number")


def stripes(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Item i goes to batch i mod ceil(n / size); n comes from a count."""
    batches = max(1, -(-rows.count() // size))
    return row_numbers(rows, order, "_number").withColumn("batch", (F.col("_number") % batches).cast("int")).drop("_number")


def facets(rows: DataFrame, keys: Column, names: list[str]) -> DataFrame:
    """(facet, place, n): rows by each of their distinct keys, in the order of ``names``; empty ones don't come."""
    places = F.array(*[F.lit(x) for x in names])
    counted = rows.select(F.explode(F.array_distinct(keys)).alias("facet")).groupBy("facet").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.array_position(places, F.col("facet")).cast("int"))


def page(rows: DataFrame, order: list[Column], start: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(start).limit(size)


def merge_max_known(left: DataFrame, right: DataFrame, key: str, largest: str, known: str) -> DataFrame:
    """Full outer merge of two indexes: the larger ``largest``; ``known`` from the right one where over 0 (0 is unknown there)."""
    r = right.select(F.col(key).alias("_k"), F.col(largest).alias("_l"), F.when(F.col(known) > 0, F.col(known)).alias("_r"))
    joined = left.join(r, left[key] == r["_k"], "full_outer")
    return joined.select(F.coalesce(left[key], "_k").alias(key), F.greatest(left[largest], "_l").alias(largest), F.coalesce("_r", left[known]).alias(known))
