"""Session construction and table access shared by every query module."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that hold on one machine and on a cluster alike.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter makes the session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sparkloom")
    conf = DEFAULTS | {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores if str(cores).isdigit() else 8),
        "spark.sql.warehouse.dir": os.path.join(tempfile.gettempdir(), "sparkloom-warehouse"),
    }
    for key, value in (conf | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by the cluster, from ``spark.checkpoint.dir``; a temporary one only where driver and executors are one process."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exploded(rows: DataFrame, items: Column | str, name: str, *columns: str) -> DataFrame:
    """``columns`` and a row an element of ``items``, none of which is null.

    For ``explode`` Spark infers a filter on the array's size, and so derives a computed array two or three times; an outer one has no such filter."""
    return rows.select(*columns, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written once to the shared folder: what is asked for several times isn't derived again."""
    path = f"{checkpoint_dir(rows.sparkSession)}/sparkloom-{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
