"""Queries that read tables as streams, write them through data sources or in layouts of their own, or train on them; with SQL that says the same."""

from __future__ import annotations

import uuid
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import linear, ordering
from sparkloom.plans import shapes
from sparkloom.plans.registry import register
from sparkloom.session import checkpoint_dir, table
from sparkloom.sources import aligned, exports
from sparkloom.streaming import stateful

_HORIZON = timedelta(days=2)


@register(
    "streamed_memory",
    """WITH g AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g),
    r AS (SELECT user_id, session, count(*) AS n, count(DISTINCT event_type) AS deg, min(ts) AS first, max(ts) AS last FROM s GROUP BY 1, 2)
    SELECT user_id::VARCHAR AS author, n, deg, epoch_us(first) AS first, epoch_us(last) AS last FROM r
    WHERE last >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY session DESC) = 1""",
)
def streamed_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = stateful.drained(stateful.remembered(stateful.file_stream(spark, f"{sf_dir}/events.parquet"), "user_id", "ts", "event_type", _HORIZON), "memory", "update")
    newest = table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("newest"))
    found = stateful.memory_now(changes, newest, _HORIZON)
    return found.select("author", "n", "deg", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


@register(
    "streamed_answers",
    """WITH v AS (SELECT * FROM events WHERE event_type = 'view'), c AS (SELECT * FROM events WHERE event_type = 'click'),
    mark AS (SELECT least((SELECT max(ts) FROM v), (SELECT max(ts) FROM c)) - INTERVAL 2 HOUR AS w)
    SELECT v.event_id, c.event_id AS answer_event_id FROM v CROSS JOIN mark LEFT JOIN c ON c.user_id = v.user_id AND c.ts BETWEEN v.ts AND v.ts + INTERVAL 12 HOUR
    WHERE c.event_id IS NOT NULL OR v.ts + INTERVAL 12 HOUR < w""",
)
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(kind: str) -> DataFrame:
        events = stateful.file_stream(spark, f"{sf_dir}/events.parquet").where(F.col("event_type") == kind)
        return events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))

    found = stateful.answered(of("view"), of("click"), "user_id", "ts", "12 HOURS", "2 hours")
    return stateful.drained(found.select("event_id", "answer_event_id"), "answers", "append").select("event_id", "answer_event_id")


@register(
    "exported_shards",
    """WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings)
    SELECT printf('shard_%05d.parquet', i // 300) AS name, count(*) AS rows, 'ok' AS status, min(vec_id) AS first_id, max(vec_id) AS last_id FROM n GROUP BY i // 300
    UNION ALL SELECT '', count(*), 'ok', min(vec_id), max(vec_id) FROM n""",
)
def exported_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/sparkloom-export-{uuid.uuid4().hex}"
    exports.export(table(spark, sf_dir, "embeddings"), ["vec_id"], 300, path, "embedding", snapshot="s")
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(path).withColumn("of", F.regexp_extract(F.input_file_name(), r"[^/]+$", 0))
    ends = rows.rollup("of").agg(F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id")).select(F.coalesce("of", F.lit("")).alias("of"), "first_id", "last_id")
    found = exports.validated(spark, path, "embedding")
    return found.join(ends, F.col("name") == F.col("of"), "left").drop("of")


@register("aligned_vectors", "SELECT d.doc_id, d.lang, e.label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id")
def aligned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = aligned.bucketed(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 16)
    vectors = aligned.bucketed(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", 16)
    return aligned.aligned_join(spark, documents, vectors, "doc_id").select("doc_id", "lang", "label")


_NEEDLES = ("The of", "que la", "Überh", "a@", "zzzqq", "n")


@register(
    "indexed_search",
    "SELECT n.needle, d.doc_id FROM documents d JOIN (SELECT unnest([" + ", ".join(f"'{x}'" for x in _NEEDLES) + "]) AS needle) n ON contains(lower(d.text), lower(n.needle))",
)
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/sparkloom-index-{uuid.uuid4().hex}"
    index = aligned.TextIndex.build(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", ["text"], path)
    return reduce(DataFrame.union, [index.search(spark, x).select(F.lit(x).alias("needle"), "doc_id") for x in _NEEDLES])


_RIDGE = """t AS (SELECT id, field, coalesce(known, 0) / 1000 AS x, label AS z, hit::DOUBLE AS y FROM cohort),
 w AS (SELECT count(*) AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy FROM t),
 f AS (SELECT field, count(*) AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy FROM t GROUP BY 1),
 r AS (SELECT field, w.n - f.n AS n, w.x - f.x AS x, w.z - f.z AS z, w.y - f.y AS y, w.xx - f.xx AS xx, w.xz - f.xz AS xz, w.zz - f.zz AS zz, w.xy - f.xy AS xy, w.zy - f.zy AS zy FROM f CROSS JOIN w),
 c AS (SELECT field, x / n AS mx, z / n AS mz, y / n AS my, xx - x * x / n + 2 AS a, xz - x * z / n AS b, zz - z * z / n + 2 AS d, xy - x * y / n AS p, zy - z * y / n AS q FROM r),
 s AS (SELECT field, mx, mz, my, (p * d - q * b) / (a * d - b * b) AS bx, (q * a - p * b) / (a * d - b * b) AS bz FROM c)"""


@register("ridge_folds", f"WITH {shapes.COHORT_SQL}, {_RIDGE} SELECT t.id, round(my + bx * (x - mx) + bz * (z - mz), 6) AS score FROM t JOIN s USING (field)")
def ridge_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shapes.cohort(spark, sf_dir).select("id", "field", (F.coalesce("known", F.lit(0.0)) / 1000).alias("x"), F.col("label").alias("z"), F.col("hit").cast("double").alias("y"))
    models = linear.leave_one_out(c, ["x", "z"], "y", "field", 2.0)
    return linear.scored_by_fold(c, models, ["x", "z"], "field").select("id", F.round("score", 6).alias("score"))


@register("ridge_bags")
def ridge_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shapes.cohort(spark, sf_dir).select("id", "field", (F.coalesce("known", F.lit(0.0)) / 1000).alias("x"), "score", F.col("hit").cast("double").alias("y"))
    models = linear.bags(c, ["x", "score"], "y", "id", 25, 1.0)
    return linear.bagged(c, models, ["x", "score"], "id", ["field"]).select("id", F.round("score", 6).alias("score"), F.round("spread", 6).alias("spread"))


@register(
    "isotonic_fit",
    f"""WITH {shapes.COHORT_SQL}, v AS (SELECT score AS x, count(*)::DOUBLE AS w, sum((hit + label + score / 50)::DOUBLE) AS s FROM cohort GROUP BY 1), p AS (SELECT x, row_number() OVER (ORDER BY x) AS i, w, s, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs FROM v),
    m AS (SELECT j.i AS j, k.i AS k, (k.cs - j.cs + j.s) / (k.cw - j.cw + j.w) AS a FROM p j JOIN p k ON j.i <= k.i),
    least_after AS (SELECT i.i, m.j, min(m.a) AS a FROM p i JOIN m ON m.j <= i.i AND m.k >= i.i GROUP BY 1, 2)
    SELECT p.x AS score, round(max(a), 6) AS fitted FROM p JOIN least_after l ON l.i = p.i GROUP BY 1""",
)
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shapes.cohort(spark, sf_dir).withColumn("y", F.col("hit") + F.col("label") + F.col("score") / 50)
    return ordering.fitted(c, "score", ordering.isotonic(c, "score", "y")).select("score", F.round("fitted", 6).alias("fitted"))
