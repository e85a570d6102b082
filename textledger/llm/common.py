"""What the operators share: tables, written intermediate tables, Arrow row batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Words between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot if it holds more than 1 / HOT of all rows; its rows are dealt over SALTS keys.
HOT = 1000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder that all executors share (spark.checkpoint.dir).

    A local session may have none, as in tests; a temporary folder is set then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textledger-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    ship(df.sparkSession)
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Removes a table made by written() that no later plan reads."""
    if isinstance(df_or_path, str):
        paths, session = [df_or_path], spark
    else:
        session = df_or_path.sparkSession
        paths = sorted({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    jvm = session.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffles and broadcasts of plans that are done.

    It does so when the driver collects garbage, which many short rounds can put off for long.
    """
    spark.sparkContext._jvm.System.gc()


def salt_of(by: str, hot: Column) -> Column:
    """For a row of the side with many rows of a key: one of SALTS if the key is hot."""
    return F.when(hot, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)


def all_salts(hot: Column) -> Column:
    """For the row of the side with one row of a key: all salts if the key is hot."""
    return F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))


def dealt(left: DataFrame, right: DataFrame, key: str, by: str, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on key with `_salt`: rows of left with a hot key have one of SALTS by `by`, its row of right has all.

    counted: a table with left's keys, if left itself is dear to read twice.
    """
    rows = left if counted is None else counted
    total = F.broadcast(rows.agg(F.count("*").alias("_n")))  # one row
    hot = rows.groupBy(key).agg(F.count("*").alias("_k")).join(total, F.col("_k") * HOT > F.col("_n")).select(key, F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)  # less than HOT keys
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    return (
        left.join(hot, key, "left").withColumn("_salt", salt_of(by, is_hot)).drop("_hot"),
        right.join(hot, key, "left").withColumn("_salt", all_salts(is_hot)).drop("_hot"),
    )
