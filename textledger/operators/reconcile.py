"""Comparing snapshots, and finding stored line references again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

REACH = 50


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, op, old_hash, hash) of two snapshots (path, hash): unchanged, added, modified or removed."""
    a, b = old.select("path", F.col("hash").alias("old_hash")), new.select("path", "hash")
    op = F.when(F.col("old_hash").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("old_hash") != F.col("hash"), "modified").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", op.alias("op"), "old_hash", "hash")


def moves(changes: DataFrame) -> DataFrame:
    """(path, from_path, hash): the i-th vanished path with a hash went to the i-th new path with it.

    A third of all files may be equal; they are numbered per (hash, directory) with offsets from
    directory counts, so no task orders all of a hash's paths.
    """

    def ranked(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("dir", F.regexp_extract("path", "^(.*/)", 1))
        counts = rows.groupBy("h", "dir").agg(F.count("*").alias("n"))
        before = Window.partitionBy("h").orderBy("dir").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        inside = F.row_number().over(Window.partitionBy("h", "dir").orderBy("path"))
        return rows.withColumn("i", inside).join(counts, ["h", "dir"]).select("path", "h", (F.col("start") + F.col("i")).alias("i"))

    gone = ranked(changes.where("op = 'removed'").select("path", F.col("old_hash").alias("h")))
    new = ranked(changes.where("op = 'added'").select("path", F.col("hash").alias("h")))
    return new.join(gone.withColumnRenamed("path", "from_path"), ["h", "i"]).select("path", "from_path", F.col("h").alias("hash"))


def stale(indexed: DataFrame, listing: DataFrame) -> DataFrame:
    """Indexed paths (path, size, mtime) that vanished or differ from a listing; new paths aren't looked for."""
    seen = listing.select("path", F.col("size").alias("now_size"), F.col("mtime").alias("now_mtime"))
    reason = F.when(F.col("now_size").isNull(), "vanished").when(F.col("now_size") != F.col("size"), "size").when(F.col("now_mtime") != F.col("mtime"), "mtime")
    return indexed.join(seen, "path", "left").withColumn("reason", reason).where("reason is not null").select("path", "reason")


def resolve(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """Where stored references stand now: (ref_id, status, start_line, finish_line).

    refs (ref_id, path, line_no, line_hash, end_line, end_hash), lines (path, line_no, line_hash). In place if the hashes
    agree there, else at the only other offset within REACH lines at which both ends agree.
    """
    lo = refs.join(lines.select("path", F.col("line_no").alias("at"), F.col("line_hash")), ["path", "line_hash"])
    lo = lo.select("ref_id", "path", (F.col("at") - F.col("line_no")).alias("shift"), "end_line", "end_hash").where(F.abs("shift") <= REACH)
    hi = lines.select("path", F.col("line_no").alias("end_at"), F.col("line_hash").alias("end_hash"))
    both = lo.join(hi, ["path", "end_hash"]).where(F.col("end_at") - F.col("end_line") == F.col("shift"))
    found = both.groupBy("ref_id").agg(F.max(F.col("shift") == 0).alias("here"), F.count_if(F.col("shift") != 0).alias("n"), F.max(F.when(F.col("shift") != 0, F.col("shift"))).alias("shift"))
    out = refs.join(found, "ref_id", "left").withColumn("status", F.when(F.col("here"), "in_place").when(F.col("n") == 1, "moved").otherwise("mismatch"))
    shift = F.when(F.col("status") == "in_place", 0).when(F.col("status") == "moved", F.col("shift"))
    return out.select("ref_id", "status", (F.col("line_no") + shift).alias("start_line"), (F.col("end_line") + shift).alias("finish_line"))


def resolve_block(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """(block_id, outcome, starts): where a block of whole lines stands in its file: ok, not_found or ambiguous.

    blocks: (block_id, path, k, text), k from 0.
    """
    size = blocks.groupBy("block_id").agg(F.count("*").alias("n"))
    hits = blocks.join(lines, ["path", "text"]).groupBy("block_id", "path", (F.col("line_no") - F.col("k")).alias("start")).agg(F.count("*").alias("m"))
    full = hits.join(size, "block_id").where("m = n").groupBy("block_id").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    n = F.coalesce(F.size("starts"), F.lit(0))
    return size.join(full, "block_id", "left").select(
        "block_id", F.when(n == 1, "ok").when(n > 1, "ambiguous").otherwise("not_found").alias("outcome"),
        F.coalesce("starts", F.array().cast("array<int>")).alias("starts"),
    )


def conflict_region(failed: DataFrame, lines: DataFrame, totals: DataFrame, around: int = 2, most: int = 40) -> DataFrame:
    """Current lines around failed targets (ref_id, path, line_no, end_line), clamped to the file."""
    rows = failed.join(totals, "path")
    first = F.greatest(F.lit(1), F.least(F.col("line_no"), F.col("total")) - around)
    last = F.least(F.col("total"), F.col("end_line") + around, first + most - 1)
    spots = rows.where("total > 0").select("ref_id", "path", first.alias("first"), last.alias("last")).where("first <= last")
    spots = spots.select("ref_id", "path", F.explode(F.sequence("first", "last")).alias("line_no"))
    return spots.join(lines, ["path", "line_no"]).select("ref_id", "path", "line_no", "text")


def line_refs(lines: DataFrame) -> DataFrame:
    """lines (path, line_no, text) with line_hash."""
    return lines.withColumn("line_hash", T.line_hash(F.col("text")))
