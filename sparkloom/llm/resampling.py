"""Importance resampling towards a target: hashed n-gram frequencies of all documents against those of the target texts.

DuckDB works inside the tasks. Each Arrow batch is a table to it, and one SQL statement lower-cases, unnests words, joins runs of
1 to 3 words by window functions, and counts them by document and bucket. A run's bucket is the CRC-32 of its bytes: ``crc32`` is registered
with DuckDB over zlib and called on distinct words, and ``crc32_join`` gives that of two joined strings from those of both (appending a
string shifts a CRC by a linear map of the string's length, as zlib's own crc32_combine does), so longer runs are never built.

The counts of each document are spilled to Parquet in the shared folder, once. From there Spark merges them by bucket over all
documents and over the target, makes a gain a bucket, and scores the documents; the table of gains has as many rows as buckets and is
broadcast. The best are drawn with seeded Gumbel noise: scores are range-partitioned, numbered in their ranges and offset by counts, so that no task
ranks all.

Defined cases: null and empty texts have no features and weigh 0; a null id takes the noise of the empty id; repeated rows are scored and ranked one
by one; ties go to the smaller id, nulls last; an empty target has no counts; an empty table gives no rows; very long texts are single rows of a batch, and DuckDB
spills beyond ``MEMORY``; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, small_batches, stored

BUCKETS = 10_000
LEAST_WORDS = 20
#: Per cent of the documents with enough words that are drawn.
PERCENT = 5
SEED = 42
#: Rows of one DuckDB table, and what one DuckDB may hold before it spills.
TABLE_ROWS = 1_000
MEMORY = "400MB"
#: Lengths whose shift has a table of its own.
DIRECT = 64


def _append_tables(powers: int = 40) -> list[np.ndarray]:
    """[k][j][b]: what a CRC register with only byte j set, to b, becomes when 2**k zero bytes are appended."""
    x = np.arange(256, dtype=np.uint32)
    # crc32 of one byte, without zlib's initial and final complements, is the step table.
    step = np.empty(256, np.uint32)
    step[x ^ 255] = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32) ^ np.uint32(0xFF000000)
    one = lambda v: (v >> np.uint32(8)) ^ step[v & np.uint32(255)]
    found = [np.stack([one(x << np.uint32(8 * j)) for j in range(4)])]
    while len(found) < powers:
        found.append(np.stack([_mapped(found[-1][j], found[-1]) for j in range(4)]))
    return found


def _mapped(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][values & 255] ^ table[1][(values >> 8) & 255] ^ table[2][(values >> 16) & 255] ^ table[3][values >> 24]


_APPEND = _append_tables()


def _shifted_bitwise(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    values = values.copy()
    for k, table in enumerate(_APPEND):
        bit = (lengths >> k) & 1 == 1
        values[bit] = _mapped(values[bit], table)
    return values


_DIRECT = np.concatenate([_shifted_bitwise(np.arange(256, dtype=np.uint32) << np.uint32(8 * j), np.full(256, n)) for n in range(DIRECT) for j in range(4)])


def shifted(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers after so many zero bytes each."""
    if len(lengths) and int(lengths.max()) >= DIRECT:
        return _shifted_bitwise(values, lengths)
    at = lengths << 10
    return _DIRECT[at + (values & 255)] ^ _DIRECT[at + 256 + ((values >> 8) & 255)] ^ _DIRECT[at + 512 + ((values >> 16) & 255)] ^ _DIRECT[at + 768 + (values >> 24)]


def crc32(words: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(x) for x in words.cast(pa.binary()).to_pylist()], pa.uint32())


def crc32_join(first: pa.Array, second: pa.Array, length: pa.Array) -> pa.Array:
    """CRC-32 of two joined strings from both CRCs and the second's length in bytes."""
    own, other, n = (x.to_numpy(zero_copy_only=False) for x in (first, second, length))
    return pa.array(shifted(own, n.astype(np.int64)) ^ other)


def connection() -> duckdb.DuckDBPyConnection:
    """DuckDB of one task, with the CRC functions registered."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
    con.create_function("crc32", crc32, ["VARCHAR"], "UINTEGER", type="arrow")
    con.create_function("crc32_join", crc32_join, ["UINTEGER", "UINTEGER", "BIGINT"], "UINTEGER", type="arrow")
    return con


#: Counts of a batch's documents by bucket. Runs of a document are found by one sort of all words by place; lead() shows whether the following
#: words are the same document's.
COUNTS = r"""
WITH texts AS (SELECT r, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM batch),
listed AS (SELECT r, unnest(regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
words AS MATERIALIZED (SELECT r, word, row_number() OVER () AS place FROM listed),
known AS (SELECT word, crc32(word) AS own, crc32(' ' || word) AS tail, strlen(word) + 1 AS n FROM (SELECT DISTINCT word FROM words)),
placed AS (SELECT r, place, own, tail, n FROM words JOIN known USING (word)),
runs AS (
  SELECT r, own, lead(r) OVER w = r AS has_two, lead(r, 2) OVER w = r AS has_three,
    lead(tail) OVER w AS tail2, lead(n) OVER w AS n2, lead(tail, 2) OVER w AS tail3, lead(n, 2) OVER w AS n3
  FROM placed WINDOW w AS (ORDER BY place)),
pairs AS MATERIALIZED (SELECT *, crc32_join(own, coalesce(tail2, 0), coalesce(n2, 0)) AS two FROM runs),
features AS (
  SELECT r, own AS crc FROM runs UNION ALL SELECT r, two FROM pairs WHERE has_two
  UNION ALL SELECT r, crc32_join(two, tail3, n3) FROM pairs WHERE has_three),
counts AS (SELECT r, (crc % {buckets})::INTEGER AS bucket, count(*)::INTEGER AS n FROM features GROUP BY ALL),
sums AS (SELECT r, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS times, sum(n)::BIGINT AS n_features FROM counts GROUP BY r),
sizes AS (SELECT r, count(*) AS n_words FROM words GROUP BY r)
SELECT b.r, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, buckets, times
FROM batch b LEFT JOIN sums USING (r) LEFT JOIN sizes USING (r) ORDER BY b.r
"""


def bucket_counts(texts: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, buckets, times): each text's counts by bucket, spilled to Parquet in the shared folder."""
    small_batches(texts.sparkSession, TABLE_ROWS)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        try:
            for batch in batches:
                con.register("batch", pa.table({"r": pa.array(range(batch.num_rows), pa.int64()), "text": batch.column(1)}))
                found = con.sql(COUNTS.format(buckets=buckets)).to_arrow_table().combine_chunks()
                con.unregister("batch")
                own = pa.table({key: batch.column(0), **{c: found[c] for c in ("n_words", "n_features", "buckets", "times")}})
                yield from own.combine_chunks().to_batches()
        finally:
            con.close()

    rows = texts.select(texts[key], texts["text"])
    return stored(rows.mapInArrow(run, f"{key} {kind}, n_words long, n_features long, buckets array<int>, times array<int>"), "bucket-counts")


def merged(counts: DataFrame) -> DataFrame:
    """(bucket, n) over all texts of ``bucket_counts``."""
    pairs = counts.where("buckets IS NOT NULL").select(F.explode(F.arrays_zip("buckets", "times")).alias("x"))
    return pairs.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.times").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from the merged counts of both: 1000 times the log of the target's smoothed share over the source's, floored."""
    spark = source.sparkSession
    sums = source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s_all")).crossJoin(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t_all")))  # one row each
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    joined = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").crossJoin(F.broadcast(sums))
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = ((d("t") + 1) * (d("s_all") + buckets)) / ((d("s") + 1) * (d("t_all") + buckets))
    return joined.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(counts: DataFrame, gained: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, weight): gains summed over each text's features; one array of ``buckets`` numbers goes to the tasks."""
    table = np.zeros(buckets, np.int64)
    for row in gained.collect():
        table[row["bucket"]] = row["gain"]
    shared = counts.sparkSession.sparkContext.broadcast(table)
    kind = counts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, times = batch.column(3), batch.column(4)
            terms = shared.value[at.flatten().to_numpy()] * times.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(terms)])
            sizes = np.array([0 if n is None else n for n in at.value_lengths().to_pylist()], np.int64)
            stop = np.cumsum(sizes)
            weight = ends[stop] - ends[stop - sizes]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(weight, pa.int64())], names=[key, "n_words", "n_features", "weight"])

    return counts.mapInArrow(run, f"{key} {kind}, n_words long, n_features long, weight long")


def noise(key: str, seed: int = SEED):
    """Seeded Gumbel noise times 1000, floored."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, target_key: str = "item_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``docs`` (doc_id, text); rank is null where a document isn't drawn.

    ``target`` (``target_key``, text) holds the texts whose distribution is aimed at."""
    counts, wanted = bucket_counts(docs, "doc_id", buckets), bucket_counts(target, target_key, buckets)
    scored = weighed(counts, gains(merged(counts), merged(wanted), buckets), "doc_id", buckets)
    scored = stored(scored.withColumn("score", F.col("weight") + noise("doc_id", seed)), "resampling-scores")
    discard(counts, wanted)
    small_batches(docs.sparkSession)
    can = scored.where(F.col("n_words") >= least_words)
    draws = can.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("number")]
    spread = can.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    spread = stored(spread, "resampling-ranges")  # bounds planned twice may differ
    sizes = spread.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("range", before.alias("start")))  # a row a range
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    placed = spread.join(starts, "range").withColumn("place", F.col("start") + inside)
    result = lambda frame, rank: frame.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
    short = scored.where(F.col("n_words") < least_words)
    return result(placed, F.when(F.col("place") <= draws, F.col("place"))).union(result(short, F.lit(None)))


# A step of CRC-32 for each byte, over the distinct runs of words only; 3988292384 is its reversed polynomial.
_FEATURES = r"""
{name}_words AS (SELECT id, len(words) AS n, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM (
    SELECT {key} AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {table})),
{name}_runs AS (SELECT id, w, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM {name}_words WINDOW x AS (PARTITION BY id ORDER BY pos)),
{name}_features AS (
  SELECT id, w AS f FROM {name}_runs UNION ALL SELECT id, w || ' ' || w2 FROM {name}_runs WHERE w2 IS NOT NULL
  UNION ALL SELECT id, w || ' ' || w2 || ' ' || w3 FROM {name}_runs WHERE w3 IS NOT NULL)"""
ORACLE = f"""
WITH {_FEATURES.format(name="d", key="doc_id", table="documents")}, {_FEATURES.format(name="t", key="item_id", table="benchmark")},
steps AS MATERIALIZED (SELECT list(c ORDER BY b) AS step FROM (
  SELECT b, list_reduce(range(8), lambda acc, i: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, b) AS c FROM range(256) AS r(b))),
distinct_features AS (SELECT f, list_transform(range(1, 2 * strlen(f), 2), lambda i: ('0x' || substr(hex(f), i, 2))::BIGINT) AS bytes FROM (SELECT f FROM d_features UNION SELECT f FROM t_features)),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(bytes, lambda acc, b: xor(acc >> 8, step[(xor(acc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM distinct_features, steps),
d_all AS MATERIALIZED (SELECT id, bucket FROM d_features JOIN hashed USING (f)),
s AS (SELECT bucket, count(*) AS n FROM d_all GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM t_features JOIN hashed USING (f) GROUP BY 1),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gains AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1.0::DOUBLE) * (s_all + 10000)) / ((s.n + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT id, count(*) AS n_features, sum(gain) AS weight FROM d_all JOIN gains USING (bucket) GROUP BY 1),
sizes AS (SELECT id, max(n) AS n_words FROM d_words GROUP BY 1),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(n_words, 0) AS n_words,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id LEFT JOIN sizes z ON z.id = doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
