"""Shards with a manifest, written by a Spark data source.

Every task writes the rows it gets as one zstd Parquet file, row group by row group, and answers with the file's rows, bytes, SHA-256 and
vector dimension. Only when all tasks have answered the driver puts the files in place, writes ``manifest.json`` from the answers, and sets ``status.json`` from
``partial`` to ``exported`` (``exported_empty`` without rows). A run that fails leaves ``failed`` and what had been written, and no manifest: whoever reads waits for that. A task that is
tried twice writes two files, of which only the answered one is used.

Paths are URIs that pyarrow reads (``file:``, ``s3:``, ``gs:``, ``hdfs:`` or plain); on a cluster the folder must be shared.

Defined cases: null vectors have no dimension; vectors of several lengths in an export are an error; tasks without rows write no shard; an empty table has a manifest without
shards; repeated rows are written as they come.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sparkloom.operators.ordering import numbered

FORMAT = "sparkloom_shards"
MANIFEST, STATUS = "manifest.json", "status.json"
CHUNK = 1 << 20
#: What a vector's length may differ from 1.
NORM_TOLERANCE = 1e-2


@dataclass
class Shard(WriterCommitMessage):
    """What a task says of its file; ``name`` is empty if it had no rows."""

    name: str
    attempt: str
    rows: int
    bytes: int
    sha256: str
    dimension: int | None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _put(system: fs.FileSystem, path: str, content: dict) -> None:
    with system.open_output_stream(f"{path}.new") as out:
        out.write(json.dumps(content, sort_keys=True).encode())
    system.move(f"{path}.new", path)


def sha256_of(system: fs.FileSystem, path: str) -> str:
    digest = hashlib.sha256()
    with system.open_input_stream(path) as file:
        while chunk := file.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def dimension_of(vectors: pa.Array) -> int | None:
    """The one length of the vectors that aren't null."""
    lengths = pc.unique(pc.drop_null(pc.list_value_length(vectors))).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(lengths)}")
    return lengths[0] if lengths else None


class ShardWriter(DataSourceArrowWriter):
    """One export; on the driver it begins and ends it, on executors it writes shards."""

    def __init__(self, path: str, vector: str | None, prefix: str, note: dict):
        self.path, self.vector, self.prefix, self.note = path, vector, prefix, note
        system, folder = _opened(path)
        system.create_dir(folder, recursive=True)
        if system.get_file_info(posixpath.join(folder, MANIFEST)).type != fs.FileType.NotFound:
            system.delete_file(posixpath.join(folder, MANIFEST))
        _put(system, posixpath.join(folder, STATUS), {"status": "partial", **note})

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        system, folder = _opened(self.path)
        number, attempt = TaskContext.get().partitionId(), f"attempt-{uuid.uuid4().hex}"
        place, writer, rows, dimension = posixpath.join(folder, attempt), None, 0, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if self.vector is not None and (own := dimension_of(batch.column(self.vector))) is not None:
                if dimension not in (None, own):
                    raise ValueError(f"vectors of several lengths: {sorted((dimension, own))}")
                dimension = own
            if writer is None:
                writer = pq.ParquetWriter(place, batch.schema, filesystem=system, compression="zstd")
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is None:
            return Shard("", "", 0, 0, "", None)
        writer.close()
        return Shard(f"{self.prefix}_{number:05d}.parquet", attempt, rows, system.get_file_info(place).size, sha256_of(system, place), dimension)

    def commit(self, messages: list[Shard | None]) -> None:
        system, folder = _opened(self.path)
        shards = [m for m in messages if m is not None and m.name]
        dimensions = {m.dimension for m in shards if m.dimension is not None}
        if len(dimensions) > 1:
            _put(system, posixpath.join(folder, STATUS), {"status": "failed", **self.note})
            raise ValueError(f"shards of several dimensions: {sorted(dimensions)}")
        for m in shards:
            system.move(posixpath.join(folder, m.attempt), posixpath.join(folder, m.name))
        told = [{k: v for k, v in asdict(m).items() if k != "attempt"} for m in sorted(shards, key=lambda m: m.name)]
        whole = hashlib.sha256("\n".join(f"{m['name']}:{m['sha256']}" for m in told).encode()).hexdigest()
        totals = {"rows": sum(m["rows"] for m in told), "bytes": sum(m["bytes"] for m in told), "dimension": next(iter(dimensions), None), "aggregate_checksum": whole}
        _put(system, posixpath.join(folder, MANIFEST), {**self.note, **totals, "shards": told})
        _put(system, posixpath.join(folder, STATUS), {"status": "exported" if told else "exported_empty", **self.note, "rows": totals["rows"]})

    def abort(self, messages: list[Shard | None]) -> None:
        system, folder = _opened(self.path)
        written = [m.attempt for m in messages if m is not None and m.name]
        _put(system, posixpath.join(folder, STATUS), {"status": "failed", **self.note, "written": sorted(written)})


class ShardSource(DataSource):
    """Options: path, vector (a column of vectors), prefix of the files, and note_* that go into the manifest."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise NotImplementedError("shards are plain Parquet; read them by their names in the manifest")

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        note = {k.removeprefix("note_"): v for k, v in self.options.items() if k.startswith("note_")}
        return ShardWriter(self.options["path"], self.options.get("vector"), self.options.get("prefix", "shard"), note)


def export(rows: DataFrame, order: list[str], size: int, path: str, vector: str | None = None, **note: str) -> None:
    """``rows`` as shards of exactly ``size`` in ``order`` (the last is shorter), which should end with a key; a task holds one shard's batch at a time."""
    spark = rows.sparkSession
    spark.dataSource.register(ShardSource)
    placed = numbered(rows, [], [F.col(c) for c in order], "_number").withColumn("_shard", F.floor((F.col("_number") - 1) / size).cast("int"))
    shards = (placed.agg(F.max("_shard")).first()[0] or 0) + 1
    # Each shard is a partition: the number itself names it.
    dealt = placed.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_number").drop("_number", "_shard")
    writer = dealt.write.format(FORMAT).mode("append").option("path", path)
    if vector:
        writer = writer.option("vector", vector)
    for name, value in note.items():
        writer = writer.option(f"note_{name}", value)
    writer.save()


def manifest_of(spark: SparkSession, path: str) -> dict | None:
    """The manifest of an export, None while there is none."""
    system, folder = _opened(path)
    if system.get_file_info(posixpath.join(folder, MANIFEST)).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(posixpath.join(folder, MANIFEST)) as file:
        return json.loads(file.read())


def validated(spark: SparkSession, path: str, vector: str | None = None, dimension: int | None = None, unit: bool = False) -> DataFrame:
    """(name, rows, status) of each shard named in the manifest or found beside it, and of the whole as the empty name.

    ok, or the first that holds of: missing, unexpected, checksum, rows, dimension (declared or given), norm (``unit``: vectors of length 1), and for the whole also count. Files are read on executors."""
    found = manifest_of(spark, path)
    if found is None:
        return spark.createDataFrame([("", None, "no manifest")], "name string, rows long, status string")
    wanted = spark.createDataFrame([(s["name"], s["rows"], s["sha256"], s["dimension"]) for s in found["shards"]], "name string, rows long, want string, dimension long")
    dimension = found["dimension"] if dimension is None else dimension
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_[0-9]*.parquet").load(path)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    present = files.select(name.alias("name"), F.sha2("content", 256).alias("have"))
    own = F.regexp_extract(F.input_file_name(), r"[^/]+$", 0)
    if found["shards"]:
        rows = spark.read.option("pathGlobFilter", "*_[0-9]*.parquet").parquet(path)
        size = F.size(vector) if vector else F.lit(dimension)
        norm = F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)) if vector and unit else F.lit(1.0)
        other, long = F.col(vector).isNotNull() & (size != F.lit(dimension)) if vector else F.lit(False), F.abs(norm - 1) > NORM_TOLERANCE
        counted = rows.withColumn("name", own).groupBy("name").agg(F.count("*").alias("n"), F.count_if(other).alias("other"), F.count_if(long).alias("long"))
    else:
        counted = spark.createDataFrame([], "name string, n long, other long, long long")
    joined = wanted.join(present, "name", "full_outer").join(counted, "name", "left")
    status = (
        F.when(F.col("have").isNull(), "missing")
        .when(F.col("want").isNull(), "unexpected")
        .when(F.col("want") != F.col("have"), "checksum")
        .when(F.coalesce("n", F.lit(0)) != F.col("rows"), "rows")
        .when((F.col("other") > 0) | (F.col("dimension") != F.lit(dimension)), "dimension")
        .when(F.col("long") > 0, "norm")
        .otherwise("ok")
    )
    shards = joined.select("name", "rows", status.alias("status"), "n", "want")
    bad = F.count_if(F.col("status") != "ok")
    lines = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "want"))), "\n"), 256)  # a line a shard
    whole = shards.agg(F.sum("rows").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), bad.alias("bad"), lines.alias("lines"))
    told = F.when(F.col("bad") > 0, "shards").when(F.col("n") != F.lit(found["rows"]), "count").when(F.col("lines") != F.lit(found["aggregate_checksum"]), "checksum").otherwise("ok")
    return shards.select("name", "rows", "status").union(whole.select(F.lit(""), F.lit(found["rows"]).cast("long"), told))
