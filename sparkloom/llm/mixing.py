"""Mixing sources to target weights by capped water-filling.

The mix shares ``budget`` (a multiple of all sizes) over the sources by weight. A source's target stops
at ``max_epochs`` times its own size; what is over goes to the other sources by their weights, until no
target is above its stop. That fixed point has a closed form: with sources ordered by stop/weight, those
before some place are stopped and all others get ``weight * level`` for one common level.

Sampling: with ``rate = target / source size``, each document is taken ``floor(rate)`` whole times. The
rest of the target is one more, partial pass over a seeded order of the source's documents, which ends
where the target is reached; so a source's taken words equal its target, rounded down to a word.

Running sums over that order are made in two steps (sums of hash buckets, then within a bucket), so a
source with a third of all rows is spread over ``BUCKETS`` groups and never sorted by one task.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source
whose sizes are all 0 has target 0; repeated rows are documents of their own and tie in the order by
their size; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import stored

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix"
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Number of words, runs of anything but ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source_key, source_size, target): ``sizes`` has source_key and size. One row a source is all that meets in a task."""
    by_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source_key").asc_nulls_last())
    ranked = by_source.withColumn("turn", (F.row_number().over(order) - 1) % len(weights)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("turn") + 1).cast("int"))
    )
    every = Window.partitionBy(F.lit(0))
    filling = Window.partitionBy(F.lit(0)).orderBy(F.col("stop_per_weight"), F.col("source_key").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    stops = (
        ranked.withColumn("stop", F.col("source_size") * max_epochs)
        .withColumn("stop_per_weight", F.col("stop") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(every) * F.lit(float(budget)))
        .withColumn("left_words", F.col("wanted") - F.coalesce(F.sum("stop").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
    )
    # Levels fall from the first place that isn't stopped on, where the true one stands.
    level = F.max(F.when(F.col("stop_per_weight") > F.col("level"), F.col("level"))).over(every)
    return stops.withColumn("common", level).select(
        "source_key",
        "source_size",
        F.when(F.col("common").isNull() | (F.col("stop_per_weight") <= F.col("common")), F.col("stop").cast("double"))
        .otherwise(F.col("weight") * F.col("common"))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source): ``docs`` has doc_id, text and source."""
    sized = docs.select("doc_id", F.col("source").alias("source_key"), word_count(F.col("text")).alias("size")).withColumn(
        "draw", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    )
    sized = stored(sized.withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int")), "sized")  # texts are read once
    share = targets(sized, weights, budget, max_epochs)
    of_bucket = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_bucket.select("source_key", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("start"))
    plan = (
        starts.join(share, starts["source_key"].eqNullSafe(share["source_key"]))
        .select(starts["source_key"].alias("plan_source"), F.col("bucket").alias("plan_bucket"), "start", "source_size", "target")
    )
    joined = sized.join(plan, sized["source_key"].eqNullSafe(plan["plan_source"]) & (sized["bucket"] == plan["plan_bucket"]))
    inside = Window.partitionBy("source_key", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    partial = F.floor(F.col("target")) - F.col("whole") * F.col("source_size")
    return (
        joined.withColumn("whole", whole.cast("long"))
        .withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), partial - F.col("at"))))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"),
            F.col("source_key").alias("source"),
        )
    )


def repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, its partial pass rounded to a whole document.

    A document without words has nothing to weigh and stays once."""
    plan = mix(docs, **options).select(
        F.col("doc_id").alias("mix_id"),
        F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int").alias("copies"),
    )
    plan = plan.groupBy("mix_id").agg(F.max("copies").alias("copies"))
    rows = docs.select(docs["doc_id"].alias("own_id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # so that no name can clash
    joined = rows.join(plan, F.col("own_id").eqNullSafe(F.col("mix_id"))).where("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source AS source_key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
by_source AS (
  SELECT source_key, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source_key NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source_key),
stops AS (
  SELECT *, 2 * source_size AS stop, (2 * source_size)::DOUBLE / weight AS stop_per_weight,
         (sum(source_size) OVER ())::DOUBLE * 1.5 AS wanted, sum(weight) OVER () AS all_weight FROM by_source),
levels AS (
  SELECT *, (wanted - coalesce(sum(stop) OVER w, 0)::DOUBLE) / (all_weight - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM stops WINDOW w AS (ORDER BY stop_per_weight, source_key NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (
  SELECT source_key, source_size, CASE WHEN common IS NULL OR stop_per_weight <= common THEN stop::DOUBLE ELSE weight * common END AS target
  FROM (SELECT *, max(CASE WHEN stop_per_weight > level THEN level END) OVER () AS common FROM levels)),
placed AS (
  SELECT s.doc_id, s.size, h.source_size, h.target, s.source_key,
         CASE WHEN h.source_size > 0 THEN floor(h.target / h.source_size)::BIGINT ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source_key ORDER BY s.draw, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM sized s JOIN share h ON s.source_key IS NOT DISTINCT FROM h.source_key)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - place)))::BIGINT AS taken,
       source_key AS source
FROM placed
"""
