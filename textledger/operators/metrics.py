"""Calls, outcomes, latency histograms and run reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import durable

BUCKETS = 104
GROWTH = 1.2


def bucket(duration_us: Column) -> Column:
    """The first bucket whose upper bound, GROWTH^bucket microseconds, isn't below the duration; the last is open."""
    return F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.ceil(F.round(F.log(F.greatest(duration_us, F.lit(1))) / F.log(F.lit(GROWTH)), 9)))).cast("int")


def histogram(calls: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, n, total_us, max_us)."""
    rows = calls.withColumn("bucket", bucket(F.col("duration_us")))
    return rows.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.sum("duration_us").alias("total_us"), F.max("duration_us").alias("max_us"))


def merged(histograms: DataFrame, *keys: str) -> DataFrame:
    """Histograms of many shards as one for each key."""
    return histograms.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("total_us").alias("total_us"), F.max("max_us").alias("max_us"))


def quantiles(hist: DataFrame, key: str, qs: list[float]) -> DataFrame:
    """(key, q, value_us, mean_us): the upper bound of the bucket at rank ceil(q n), at most the largest duration."""
    w = Window.partitionBy(key)
    run = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.withColumns({"so_far": F.sum("n").over(run), "all_n": F.sum("n").over(w), "top": F.max("max_us").over(w), "mean_us": F.sum("total_us").over(w) / F.sum("n").over(w)})
    rows = rows.withColumn("q", F.explode(F.array(*[F.lit(q) for q in qs])))
    upper = F.when(F.col("bucket") == BUCKETS - 1, F.col("top").cast("double")).otherwise(F.least(F.pow(F.lit(GROWTH), F.col("bucket")), F.col("top").cast("double")))
    at = rows.where(F.col("so_far") >= F.ceil(F.col("q") * F.col("all_n")))
    return at.groupBy(key, "q").agg(F.round(F.min_by(upper, "bucket"), 6).alias("value_us"), F.first("mean_us").alias("mean_us"))


def percentiles(rows: DataFrame, key: str, value: str, qs: list[float]) -> DataFrame:
    """(key, q, value): the least of a key's whole numbers that at least a share q of them don't exceed.

    Selected by 16 bits at a time from the highest: four rounds count the rows that agree with what is chosen so
    far by their next 16 bits. Counts are summed before they are shuffled, and a window sees at most 65,536 of
    them for a key, so no task holds or orders a key's rows. Null values don't count; a key with none else has a
    null. A null key is a key.
    """
    bits = F.col(value).cast("long").bitwiseXOR(F.lit(-(1 << 63)))  # in the order of unsigned numbers
    rows = rows.select(F.col(key).alias("k"), bits.alias("bits"))
    n = rows.groupBy("k").agg(F.count("bits").alias("n")).withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    asked = durable(n.select(F.col("k").alias("key"), "q", "n", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).alias("rank"), F.lit(0).cast("long").alias("chosen")))
    left = asked.where("n > 0")
    for shift in (48, 32, 16, 0):
        above = F.shiftrightunsigned("bits", shift + 16) if shift < 48 else F.lit(0).cast("long")
        digits = rows.where("bits IS NOT NULL").select("k", above.alias("above"), F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit(0xFFFF)).alias("digit"))
        same = F.col("k").eqNullSafe(F.col("key")) & (F.col("above") == F.col("chosen"))
        counts = digits.join(left.select("key", "chosen"), same, "left_semi").groupBy("k", "above", "digit").agg(F.count("*").alias("c"))
        run = Window.partitionBy("key", "q").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.join(left, same).withColumn("upto", F.sum("c").over(run)).where("upto >= rank AND upto - c < rank")
        left = durable(upto.select("key", "q", "n", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.shiftleft("chosen", 16).bitwiseOR(F.col("digit")).alias("chosen")))
    found = left.select("key", "q", F.col("chosen").bitwiseXOR(F.lit(-(1 << 63))).alias("value"))
    return found.unionByName(asked.where("n = 0").select("key", "q", F.lit(None).cast("long").alias("value")))


def outcome_rate(calls: DataFrame, outcome: str) -> DataFrame:
    """The share of calls with an outcome; 0 without calls."""
    return calls.agg(F.coalesce(F.avg((F.col("outcome") == outcome).cast("int")), F.lit(0.0)).alias("rate"))


def against_targets(values: DataFrame, targets: DataFrame) -> DataFrame:
    """values (metric, value) and targets (metric, relation, target) with pass; without a value it fails."""
    ok = (
        F.when(F.col("relation") == "<", F.col("value") < F.col("target"))
        .when(F.col("relation") == "<=", F.col("value") <= F.col("target"))
        .when(F.col("relation") == ">", F.col("value") > F.col("target"))
        .when(F.col("relation") == ">=", F.col("value") >= F.col("target"))
    )
    return targets.join(values, "metric", "left").withColumn("passed", F.coalesce(ok, F.lit(False)))


def classify_commands(runs: DataFrame, tool: str, fallback: list[str], wrappers: list[str]) -> DataFrame:
    """(run_id, kind, n): the shell commands of each command line by kind: tool, fallback or other.

    Here-documents are dropped, pipes and sequences split, variable settings and wrappers skipped.
    """
    body = F.regexp_replace("command", r"(?s)<<-?\s*['\"]?(\w+)['\"]?([^\n]*)\n.*?(?<=\n)\s*\1(?=\n|$)", "$2")
    parts = F.split(body, r"\s*(?:\|\||&&|[|;&\n])\s*")
    lead = rf"^\s*(?:(?:\w+=\S*|{'|'.join(wrappers)})\s+)*"
    name = F.regexp_extract(F.regexp_replace("part", lead, ""), r"^(?:\S*/)?([\w.-]+)", 1)
    rows = runs.select("run_id", F.explode(parts).alias("part")).withColumn("name", name).where("name <> ''")
    kind = F.when(F.col("name") == tool, "tool").when(F.col("name").isin(fallback), "fallback").otherwise("other")
    return rows.groupBy("run_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def debounce(events: DataFrame, quiet_ms: int, most_ms: int) -> DataFrame:
    """(stream, first_ts, last_ts, n): batches that close after a quiet time, or a time after their first event.

    Quiet gaps cut a stream into runs, whatever batches do; they are found day by day, with what the days
    before leave over, so a busy stream is many tasks. Only inside a run are batches folded in order.
    """
    rows = events.select("stream", F.to_date("ts").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    in_day, days = Window.partitionBy("stream", "day").orderBy("us"), Window.partitionBy("stream").orderBy("day")
    before = days.rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("stream", "day").agg(F.max("us").alias("end")).withColumn("end", F.lag("end").over(days))
    last = F.coalesce(F.lag("us").over(in_day), F.col("end"))
    rows = rows.join(ends, ["stream", "day"])
    rows = rows.withColumn("start", F.when(last.isNull() | (F.col("us") - last > quiet_ms * 1000), F.col("us"))).drop("end")
    starts = rows.groupBy("stream", "day").agg(F.max("start").alias("open")).withColumn("open", F.last("open", ignorenulls=True).over(before))
    run = F.coalesce(F.last("start", ignorenulls=True).over(in_day.rangeBetween(Window.unboundedPreceding, 0)), F.col("open"))
    rows = rows.join(starts, ["stream", "day"]).withColumn("run", run)

    def batches(part: pd.DataFrame) -> pd.DataFrame:
        t, at, out = np.sort(part["us"].to_numpy()), 0, []
        while at < len(t):
            end = int(np.searchsorted(t, t[at] + most_ms * 1000, "right"))
            out.append((part["stream"].iloc[0], t[at], t[end - 1], end - at))
            at = end
        return pd.DataFrame(out, columns=["stream", "first", "last", "n"])

    schema = f"stream {events.schema['stream'].dataType.simpleString()}, first long, last long, n int"
    out = rows.select("stream", "run", "us").groupBy("stream", "run").applyInPandas(batches, schema)
    return out.select("stream", F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("last_ts"), "n")
