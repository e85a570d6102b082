"""Working tables in the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textledger-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def file_versions(spark: SparkSession, path: str) -> tuple:
    """(name, time, size) of the files of a table."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in found))


def durable(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    work_path(df.sparkSession, "unused")
    return df.checkpoint()


def remove_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    """Takes a batch back."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def overwrite_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Writes a batch as its own partition; a repeated write replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
