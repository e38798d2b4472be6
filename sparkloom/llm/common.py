"""What the training-data operators share: table access, cut lineage, Arrow batches, words."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import checkpoint_dir

#: Rows that one Arrow batch to Python holds; bounds a worker's memory when texts are long.
BATCH_ROWS = 256
#: Bytes after which Spark ends an Arrow batch early, where the session knows the setting.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; an error on a cluster where none is set."""
    return checkpoint_dir(spark)


def cut(frame: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by checkpoint(): copies in the shared folder outlive executors."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The same rows reread from a compressed table in the shared folder, deleted when the driver ends."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    atexit.register(_delete, spark, path)
    found = spark.read.schema(frame.schema).parquet(path)
    found._stored_at = path
    return found


def discard(*frames: DataFrame) -> None:
    """Deletes tables of ``stored`` that no later plan reads."""
    for frame in frames:
        _delete(frame.sparkSession, frame._stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # noqa: BLE001  the session is gone; the cluster clears its own shared folder
        return


def bounded_sample(frame: DataFrame, keys: list[str], size: int, seed: str) -> DataFrame:
    """The ``size`` rows of smallest seeded hash of ``keys``.

    A threshold on the hash, with room for chance, comes first: so all tasks together offer the driver's
    merge about twice ``size`` rows, and not ``size`` each."""
    draw = F.xxhash64(F.lit(seed), *keys)
    share = 2 * (size + 100) / max(1, frame.count())
    near = frame if share >= 1 else frame.where(draw < F.lit(int(-(2**63) + share * 2**64)))
    return near.orderBy(draw, *keys).limit(size)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches of later Python stages by rows, and by bytes where Spark can."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(frame: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    return frame.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Strings as their UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def documents_only(docs: DataFrame) -> DataFrame:
    """The columns of documents by position of first appearance; extra ones go, so that names cannot clash."""
    return docs.select(*[docs[c] for c in ("doc_id", "text", "lang", "source", "n_chars")])
