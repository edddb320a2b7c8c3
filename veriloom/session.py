"""Session helpers: builder defaults, table reading, staged tables in the shared folder."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(app: str = "veriloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are tuned for; conf entries win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ready(builder.getOrCreate())


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this library and keeps their Arrow batches small."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def tidy() -> None:
    """Has a Python worker give free memory back; for the end of a task, since workers stay for later ones."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path, so any store will do."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over all tasks: before work that costs much for each row, since a small file is read by one task."""
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and the master is local, an
    own one. On a cluster executors would each write to their own disk, so there it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not at:
        at = spark.sparkContext.getCheckpointDir() or ""
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="veriloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str, by: str | None = None, **options: object) -> tuple[DataFrame, str]:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends at files that outlive executors.

    by: a column that the files are partitioned by, so that a part of them can be deleted alone; options: of the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veriloom/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def unstage(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
