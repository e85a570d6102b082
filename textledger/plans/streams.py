"""Streaming queries; each runs what the tables hold to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import remove_batch, work_path
from ..streaming import feeds as S
from .fixtures import CALLS, CHANGES, FILES_V1, FILES_V2, calls, changes, files_v1, files_v2, table
from .metrics import BUCKET
from .snapshots import manifests

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def as_stream(rows, parts: int = 4):
    """rows written as files and read as a stream of them, one in each micro-batch."""
    spark, at = rows.sparkSession, work_path(rows.sparkSession, "stream-in")
    rows.repartition(parts).write.parquet(at)
    return S.file_stream(spark, at, rows.schema)


@query("stream_changes", f"WITH {CHANGES} SELECT change_id, path, op FROM changes WHERE change_id > 400 AND (regexp_matches(path, '^docs/f1[^/]*(/.*)?$') OR regexp_matches(coalesce(from_path, ''), '^docs/f1[^/]*(/.*)?$'))")
def stream_changes(spark, d):
    feed = as_stream(changes(spark, d).select("change_id", "path", "from_path", "op"))
    return S.collected(S.change_feed(feed, 400, ["docs/f1*"])).select("change_id", "path", "op")


@query("stream_wait", f"WITH {CHANGES} SELECT change_id, path FROM changes WHERE change_id > 400 AND op = 'remove' AND path = 'docs/f7' ORDER BY change_id LIMIT 1")
def stream_wait(spark, d):
    feed = as_stream(changes(spark, d).where("op = 'remove'").select("change_id", "path", "from_path"))
    return S.first_entry(S.change_feed(feed, 400, ["docs/f7"]), 120).select("change_id", "path")


def touched(spark, d):
    old, new = manifests(spark, d)
    return old.select("path").union(new.select("path"))


@query("stream_sync")
def stream_sync(spark, d):
    """Touched paths re-read in micro-batches; the updates add up to the batch comparison."""
    return S.sync(as_stream(touched(spark, d)), *manifests(spark, d), bulk=10**9)


@query("stream_bulk_escalation")
def stream_bulk_escalation(spark, d):
    """Large micro-batches compare the whole snapshots."""
    return S.sync(as_stream(touched(spark, d), 2), *manifests(spark, d), bulk=100)


@query("stream_late")
def stream_late(spark, d):
    """Half of the events are lost; a rescan request (a null path) finds what they would have said."""
    some = touched(spark, d).where("crc32(path) % 2 = 0").withColumn("path", F.when(F.crc32("path") % 10 > 0, F.col("path")))
    return S.sync(as_stream(some), *manifests(spark, d), bulk=10**9)


@query("stream_retry", f"WITH {CALLS} SELECT command, bucket, count(*) AS n, sum(duration_us)::BIGINT AS total_us, max(duration_us) AS max_us FROM (SELECT *, {BUCKET} AS bucket FROM calls) GROUP BY ALL")
def stream_retry(spark, d):
    """A batch that fails after its write is replayed from the checkpoint and replaces itself."""
    feed, at, out = as_stream(calls(spark, d)), work_path(spark, "stream-state"), work_path(spark, "stream-retry")
    failed = []

    def each(batch, batch_id):
        S.overwrite_batch(M.histogram(batch, "command"), out, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("fails once, to be replayed")

    for _ in range(2):
        q = feed.writeStream.foreachBatch(each).option("checkpointLocation", at).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            if not failed:
                raise
    return M.merged(spark.read.parquet(out), "command")


@query("stream_hooks", f"WITH {CHANGES} SELECT path, op, count(*) AS n FROM changes GROUP BY ALL")
def stream_hooks(spark, d):
    """Two recorders for each batch of changes; the second fails once, both are undone, and the batch is replayed."""
    feed = as_stream(changes(spark, d).select("change_id", "path", "op"))
    log, counts, at = (work_path(spark, f"stream-{x}") for x in ("log", "counts", "state"))
    failed = []

    def count(batch, batch_id):
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("fails once, to be replayed")
        S.overwrite_batch(batch.groupBy("path", "op").agg(F.count("*").alias("n")), counts, batch_id)

    hooks = [
        (lambda batch, i: S.overwrite_batch(batch, log, i), lambda batch, i: remove_batch(spark, log, i)),
        (count, lambda batch, i: remove_batch(spark, counts, i)),
    ]
    for _ in range(2):
        q = feed.writeStream.foreachBatch(S.hooked(hooks)).option("checkpointLocation", at).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            if not failed:
                raise
    logged = spark.read.parquet(log).groupBy("path", "op").agg(F.count("*").alias("n"))
    counted = spark.read.parquet(counts).groupBy("path", "op").agg(F.sum("n").alias("n"))
    return logged.join(counted, ["path", "op", "n"])  # both recorders tell the same


@query(
    "stream_versions",
    """WITH """ + FILES_V1 + ", " + FILES_V2 + """, a AS (SELECT path, sha256(content) AS h FROM files_v1), b AS (SELECT path, sha256(content) AS h FROM files_v2)
SELECT path, substr(h, 1, 6) AS version, 'added' AS op FROM a
UNION ALL SELECT path, substr(b.h, 1, 6), CASE WHEN a.h IS NULL THEN 'added' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END FROM b LEFT JOIN a USING (path)""",
)
def stream_versions(spark, d):
    """Both snapshots' hashes, the new one behind the old one."""
    parts = [files(spark, d).select("path", F.sha2("content", 256).alias("hash"), F.lit(seq).alias("seq")) for seq, files in enumerate((files_v1, files_v2))]
    return S.versions(parts)


def by_time(rows, key: str, parts: int = 4):
    """rows in parts of equal size by key, a number."""
    cuts = rows.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    ends = [None, *sorted(set(cuts)), None]
    out = []
    for low, high in zip(ends, ends[1:]):
        part = rows if low is None else rows.where(F.col(key) > low)
        out.append(part if high is None else part.where(F.col(key) <= high))
    return out


@query("stream_debounce")
def stream_debounce(spark, d):
    """Batches that are closed at the end, by an event or by the timer; events arrive in four turns."""
    rows = table(spark, d, "events").select((F.col("user_id") % 50).alias("stream"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return S.in_turns(by_time(rows, "us"), lambda stream: S.debounced(stream, 600_000, 1_800_000))


@query("stream_metrics", f"WITH {CALLS} SELECT command, bucket, count(*) AS n, sum(duration_us)::BIGINT AS total_us, max(duration_us) AS max_us FROM (SELECT *, {BUCKET} AS bucket FROM calls) GROUP BY ALL")
def stream_metrics(spark, d):
    return S.running_metrics(as_stream(calls(spark, d)))


@query("stream_metrics_windows")
def stream_metrics_windows(spark, d):
    """Daily windows that the watermark has closed; calls arrive in four turns."""
    rows = calls(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return S.in_turns(by_time(rows, "us"), S.windowed_metrics)
