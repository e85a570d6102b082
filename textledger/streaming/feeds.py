"""Structured Streaming forms of the change feed, sync and metrics.

Every stream runs with trigger(availableNow) to a sink below the shared folder, or to foreachBatch
functions that write by batch id, so a batch that is replayed from its checkpoint replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import globs
from ..operators import metrics, reconcile
from ..sources.tables import overwrite_batch, work_path

QUIET_MS, MOST_MS, BULK = 150, 500, 1000


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], seconds: float | None = None) -> bool:
    """Runs what is there through foreachBatch; False if it took longer than `seconds`."""
    at = work_path(stream.sparkSession, "stream-state")
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", at).trigger(availableNow=True).start()
    done = q.awaitTermination(seconds) if seconds is not None else (q.awaitTermination() or True)
    if not done:
        q.stop()
    return bool(done)


Hook = tuple[Callable[[DataFrame, int], None], Callable[[DataFrame, int], None]]


def hooked(hooks: list[Hook]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that runs hooks (do, undo) in order, each idempotent by batch id.

    If one fails, it and those before it are undone, the last first, and the batch fails, so that it is
    replayed from the checkpoint.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        for n, (do, _) in enumerate(hooks):
            try:
                do(batch, batch_id)
            except Exception:
                for _, undo in reversed(hooks[: n + 1]):
                    undo(batch, batch_id)
                raise

    return each


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's rows, run to its end into a Parquet sink."""
    spark = stream.sparkSession
    out = work_path(spark, "stream-out")
    q = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", out).option("checkpointLocation", work_path(spark, "stream-state")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def in_turns(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of build(stream) when parts arrive one after the other.

    After each part the stream runs to its end and stops; the next run goes on from the checkpoint, so
    what it keeps as state outlives it.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    at, out, state = (work_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    for part in parts:
        part.write.mode("append").parquet(at)
        stream = build(spark.readStream.schema(schema).parquet(at))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def change_feed(stream: DataFrame, since: int, patterns: list[str]) -> DataFrame:
    """Entries behind a cursor whose path, or the path they moved from, a glob selects."""
    here = F.lit(False)
    for p in patterns:
        regex = globs.path_regex(p)
        here = here | F.col("path").rlike(regex) | F.coalesce(F.col("from_path").rlike(regex), F.lit(False))
    return stream.where((F.col("change_id") > since) & here)


def first_entry(stream: DataFrame, seconds: float) -> DataFrame:
    """The first entry of a bounded run, by change_id; nothing if none comes in time."""
    spark, out = stream.sparkSession, work_path(stream.sparkSession, "stream-first")

    def each(batch: DataFrame, batch_id: int) -> None:
        overwrite_batch(batch.orderBy("change_id").limit(1), out, batch_id)

    run_batches(stream, each, seconds)
    return spark.read.schema(stream.schema).parquet(out).orderBy("change_id").limit(1)


def sync(events: DataFrame, old: DataFrame, current: DataFrame, bulk: int = BULK) -> DataFrame:
    """Updates (path, op, from_path, batch_id, full) of touched paths (path), re-read by hash.

    Each micro-batch takes its distinct paths once, whatever the events said, and reconciles the
    state (path, hash) with what is there now; moves are paired within the batch. Batches of more than
    `bulk` paths, or with a null path (a rescan request), reconcile everything. State and updates are
    written by batch id.
    """
    spark = events.sparkSession
    states, updates = work_path(spark, "sync-state"), work_path(spark, "sync-updates")
    overwrite_batch(old.select("path", "hash"), states, -1)

    def each(batch: DataFrame, batch_id: int) -> None:
        state = spark.read.parquet(f"{states}/batch_id={batch_id - 1}")
        touched = batch.select("path").distinct()
        full = touched.where("path is null").count() > 0 or touched.count() > bulk
        have, now = (state, current) if full else (state.join(touched, "path", "left_semi"), current.join(touched, "path", "left_semi"))
        found = reconcile.reconcile(have, now.select("path", "hash")).where("op <> 'unchanged'")
        moved = reconcile.moves(found)
        rows = found.join(moved.select("path", "from_path"), "path", "left").join(moved.select(F.col("from_path").alias("path"), F.lit(True).alias("left")), "path", "left")
        op = F.when(F.col("from_path").isNotNull(), "moved").when(F.col("left"), "moved_away").otherwise(F.col("op"))
        overwrite_batch(rows.select("path", op.alias("op"), "from_path", F.lit(full).alias("full")), updates, batch_id)
        rest = state.join(found.select("path"), "path", "left_anti")
        fresh = found.where("hash is not null").select("path", "hash")
        overwrite_batch(rest.unionByName(fresh), states, batch_id)

    run_batches(events, each)
    return spark.read.parquet(updates)


def versions(parts: list[DataFrame]) -> DataFrame:
    """Entries (path, version, op) of parts (path, hash, seq) that arrive one after the other.

    The last hash of each path is state, joined with a batch by path. State and entries are written by batch id;
    after each part the stream stops, and the next run goes on from the checkpoint.
    """
    spark = parts[0].sparkSession
    at, states, entries, checkpoint = (work_path(spark, f"versions-{x}") for x in ("in", "state", "out", "checkpoint"))
    overwrite_batch(spark.createDataFrame([], "path string, hash string"), states, -1)

    def each(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.schema("path string, hash string").parquet(f"{states}/batch_id={batch_id - 1}")
        new = batch.select("path", "hash", F.struct(F.lit(True).alias("new"), "seq").alias("at"))
        rows = known.select("path", "hash", F.struct(F.lit(False).alias("new"), F.lit(None).cast(batch.schema["seq"].dataType).alias("seq")).alias("at")).unionByName(new)
        last = F.lag("hash").over(Window.partitionBy("path").orderBy("at"))
        op = F.when(last.isNull(), "added").when(F.col("hash") == last, "unchanged").otherwise("modified")
        found = rows.select("path", F.substring("hash", 1, 6).alias("version"), op.alias("op"), F.col("at.new").alias("new"))
        overwrite_batch(found.where("new").drop("new"), entries, batch_id)
        overwrite_batch(rows.groupBy("path").agg(F.max_by("hash", "at").alias("hash")), states, batch_id)

    for part in parts:
        part.write.mode("append").parquet(at)
        stream = spark.readStream.schema(parts[0].schema).parquet(at)
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, version string, op string").parquet(entries).select("path", "version", "op")


def debounced(stream: DataFrame, quiet_ms: int = QUIET_MS, most_ms: int = MOST_MS) -> DataFrame:
    """Batches (stream, first_us, last_us, n) of (stream, us): quiet for a while, or open for too long.

    A batch is given out when a later event of its stream closes it, or by a timer once event time (the
    newest event of all streams) is past its quiet time. What is still open then stays in the state.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        rows = []
        for t in sorted(int(x) for frame in frames for x in frame["us"]):
            if first is not None and t - last <= quiet_ms * 1000 and t - first <= most_ms * 1000:
                last, n = t, n + 1
            else:
                if first is not None:
                    rows.append((key[0], first, last, n))
                first, last, n = t, t, 1
        close = last // 1000 + quiet_ms + 1
        if state.hasTimedOut or close <= state.getCurrentWatermarkMs():
            rows.append((key[0], first, last, n))
            state.remove()
        else:
            state.update((first, last, n))
            state.setTimeoutTimestamp(close)
        yield pd.DataFrame(rows, columns=["stream", "first_us", "last_us", "n"])

    timed = stream.withColumn("time", F.timestamp_micros("us")).withWatermark("time", "0 seconds")
    return timed.groupBy("stream").applyInPandasWithState(
        update, "stream long, first_us long, last_us long, n int", "first long, last long, n int", "append", GroupStateTimeout.EventTimeTimeout
    )


def windowed_metrics(stream: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and log-bucket histogram of calls per window and command; rows later than the watermark go."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("bucket", metrics.bucket(F.col("duration_us")))
    counts = rows.groupBy(F.window("ts", window).alias("w"), "command", "bucket").agg(F.count("*").alias("n"), F.sum("duration_us").alias("total_us"))
    return counts.select(F.col("w.start").alias("window_start"), "command", "bucket", "n", "total_us")


def running_metrics(stream: DataFrame) -> DataFrame:
    """Cumulative histogram of all calls so far: the counts of every micro-batch by id, merged when read."""
    spark, out = stream.sparkSession, work_path(stream.sparkSession, "stream-metrics")
    run_batches(stream, lambda batch, batch_id: overwrite_batch(metrics.histogram(batch, "command"), out, batch_id))
    return metrics.merged(spark.read.parquet(out), "command")
