"""Inputs that Spark derives from the test tables, and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as there are cores, if their files have fewer; large tables are left as they are."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def doc_path(prefix: str = "docs") -> Column:
    return F.concat(F.lit(f"{prefix}/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".txt"))


def files_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, doc_id): one file for each document."""
    return spread(table(spark, sf_dir, "documents")).select(doc_path().alias("path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")


FILES_V1 = """files_v1 AS (SELECT 'docs/' || source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 7, '0') || '.txt' AS path,
  coalesce(text, '') AS content, doc_id FROM documents)"""


def edited(content: Column) -> Column:
    """Lines dropped (3 of 7), upper-cased (5 of 11) and inserted (after 4 of 9)."""
    lines = F.split(content, "\n", -1)

    def line(x: Column, i: Column) -> Column:
        n = i + 1
        kept = F.when(n % 7 == 3, F.array().cast("array<string>")).when(n % 11 == 5, F.array(F.translate(x, LOWER, LOWER.upper()))).otherwise(F.array(x))
        more = F.when(n % 9 == 4, F.array(F.concat(F.lit("inserted after "), n.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.concat(kept, more)

    return F.array_join(F.flatten(F.transform(lines, line)), "\n")


def files_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): files_v1 with removals, moves and edits, and new files."""
    docs = spread(table(spark, sf_dir, "documents")).where("doc_id % 17 <> 3")
    text = F.coalesce("text", F.lit(""))
    moved = F.col("doc_id") % 13 == 5
    kept = docs.select(
        F.when(moved, doc_path("archive")).otherwise(doc_path()).alias("path"),
        F.when(~moved & (F.col("doc_id") % 5 == 1), edited(text)).otherwise(text).alias("content"),
    )
    new = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("bench/"), F.lpad(F.col("item_id").cast("string"), 7, "0"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content")
    )
    return kept.unionByName(new)


FILES_V2 = """files_v2 AS (
  SELECT (CASE WHEN doc_id % 13 = 5 THEN 'archive/' ELSE 'docs/' END) || source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 7, '0') || '.txt' AS path,
    CASE WHEN doc_id % 13 <> 5 AND doc_id % 5 = 1 THEN array_to_string(flatten(list_transform(string_split(coalesce(text, ''), chr(10)),
      lambda x, n: list_concat(CASE WHEN n % 7 = 3 THEN []::VARCHAR[] WHEN n % 11 = 5 THEN [translate(x, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')] ELSE [x] END,
        CASE WHEN n % 9 = 4 THEN ['inserted after ' || n] ELSE []::VARCHAR[] END))), chr(10)) ELSE coalesce(text, '') END AS content
  FROM documents WHERE doc_id % 17 <> 3
  UNION ALL SELECT 'bench/' || lpad(item_id::VARCHAR, 7, '0') || '.txt', coalesce(text, '') FROM benchmark)"""


def files_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): files_v2 with later edits in a third of the files."""
    files = files_v2(spark, sf_dir)
    return files.select("path", F.when(F.crc32("path") % 3 == 0, edited(F.col("content"))).otherwise(F.col("content")).alias("content"))


def files_styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): files_v1 with CRLF endings, BOMs and NULs in some."""
    d = F.col("doc_id") % 23
    content = (
        F.when(d == 7, F.replace("content", F.lit("\n"), F.lit("\r\n")))
        .when(d == 11, F.concat(F.lit(T.BOM), "content"))
        .when(d == 19, F.concat("content", F.lit("\0")))
        .when(d == 3, F.concat("content", F.lit("\n")))
        .otherwise(F.col("content"))
    )
    return files_v1(spark, sf_dir).select("path", content.alias("content"))


FILES_STYLED = f"""{FILES_V1}, files_styled AS (SELECT path, CASE doc_id % 23 WHEN 7 THEN replace(content, chr(10), chr(13) || chr(10))
  WHEN 11 THEN chr(65279) || content WHEN 19 THEN content || chr(0) WHEN 3 THEN content || chr(10) ELSE content END AS content FROM files_v1)"""


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line_no, text) of files (path, content)."""
    return files.select("path", F.posexplode(T.split_lines(F.col("content"))).alias("i", "text")).select(
        "path", (F.col("i") + 1).alias("line_no"), "text"
    )


LINES_V1 = """lines AS (SELECT path, n AS line_no, ls[n] AS text FROM (
  SELECT path, ls, unnest(range(1, len(ls) + 1)) AS n FROM (
    SELECT path, CASE WHEN content = '' THEN [] WHEN ls0[len(ls0)] = '' THEN ls0[1:len(ls0)-1] ELSE ls0 END AS ls
    FROM (SELECT path, content, string_split(content, chr(10)) AS ls0 FROM files_v1))))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, ts, command, outcome, duration_us) from events."""
    outcomes = F.array(*[F.lit(x) for x in OUTCOMES])
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"), "ts", F.col("event_type").alias("command"),
        F.element_at(outcomes, (k % len(OUTCOMES) + 1).cast("int")).alias("outcome"),
        F.round(F.col("value") * 1000).cast("long").alias("duration_us"), "user_id",
    )


#: The outcomes that a call may have, and their exit codes.
OUTCOMES = {
    "ok": 0, "error": 1, "usage": 2, "conflict": 3, "not_found": 4, "ambiguous": 5, "denied": 6, "unavailable": 7,
}
CALLS = (
    "calls AS (SELECT event_id AS call_id, ts, event_type AS command, (["
    + ", ".join(f"'{x}'" for x in OUTCOMES)
    + f"])[(json_extract_string(props, '$.k')::INT % {len(OUTCOMES)}) + 1] AS outcome, round(value * 1000)::BIGINT AS duration_us, user_id FROM events)"
)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log from events: (change_id, time, source, author, path, op, from_path, undid, k)."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("change_id"), "ts", "user_id", "event_type", k.alias("k"))
    path = F.concat(F.lit("docs/f"), (F.col("user_id") % 40).cast("string"))
    kind = F.col("change_id") % 10
    return rows.select(
        "change_id", F.col("ts").alias("time"),
        F.when(F.col("event_type") == "error", "external").otherwise("tool").alias("source"),
        F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("author"), path.alias("path"),
        F.when(F.col("event_type") == "signup", "rollback").when(kind == 0, "create").when(kind == 1, "remove").when(kind == 2, "move").otherwise("edit").alias("op"),
        F.when((F.col("event_type") != "signup") & (kind == 2), F.concat(F.lit("docs/f"), ((F.col("user_id") + 3) % 40).cast("string"))).alias("from_path"),
        F.when((F.col("event_type") == "signup") & (F.col("change_id") - 1 - F.col("k") % 5 > 0), F.col("change_id") - 1 - F.col("k") % 5).alias("undid"),
        "k",
    )


CHANGES = """changes AS (SELECT event_id + 1 AS change_id, ts AS time, CASE WHEN event_type = 'error' THEN 'external' ELSE 'tool' END AS source,
  'u' || (user_id % 7) AS author, 'docs/f' || (user_id % 40) AS path,
  CASE WHEN event_type = 'signup' THEN 'rollback' WHEN (event_id + 1) % 10 = 0 THEN 'create' WHEN (event_id + 1) % 10 = 1 THEN 'remove'
    WHEN (event_id + 1) % 10 = 2 THEN 'move' ELSE 'edit' END AS op,
  CASE WHEN event_type <> 'signup' AND (event_id + 1) % 10 = 2 THEN 'docs/f' || ((user_id + 3) % 40) END AS from_path,
  CASE WHEN event_type = 'signup' AND event_id - (json_extract_string(props, '$.k')::INT % 5) > 0
    THEN event_id - (json_extract_string(props, '$.k')::INT % 5) END AS undid,
  json_extract_string(props, '$.k')::INT AS k FROM events)"""

ORDER_LI = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments from lineitem: (change_id, seq, pos, old_n, new_n), sorted and non-touching in each change."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER_LI)
    old = F.floor("l_quantity").cast("long") % 6
    gap = F.col("l_partkey") % 20
    rows = table(spark, sf_dir, "lineitem").withColumns({"seq": F.row_number().over(w), "old_n": old, "gap": gap})
    rows = rows.withColumn("new_n", F.col("l_suppkey") % 6 + F.when(F.col("old_n") == 0, 1).otherwise(0))
    before = F.coalesce(F.sum(F.col("old_n") + 1 + F.col("gap")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(F.col("l_orderkey").alias("change_id"), "seq", (before + F.col("gap")).alias("pos"), "old_n", "new_n")


FRAGMENTS = f"""fragments AS (SELECT l_orderkey AS change_id, seq, (coalesce(sum(old_n + 1 + gap) OVER (PARTITION BY l_orderkey ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap)::BIGINT AS pos, old_n, l_suppkey % 6 + CASE WHEN old_n = 0 THEN 1 ELSE 0 END AS new_n
  FROM (SELECT *, floor(l_quantity)::BIGINT % 6 AS old_n, l_partkey % 20 AS gap,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER_LI)}) AS seq FROM lineitem))"""


def file_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of changes of 500 files from orders: edits, moves over and away, removals, re-creations, binary changes."""
    slot, kind = F.col("o_orderkey") % 500, F.floor(F.col("o_orderkey") / 7) % 23
    version = lambda n: F.concat(F.lit("v"), n.cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("change_id"), F.concat(F.lit("f"), slot.cast("string")).alias("path"),
        F.when(kind == 3, F.concat(F.lit("f"), ((slot + 1 + F.col("o_custkey") % 50) % 500).cast("string"))).alias("from_path"),
        kind.isin(6, 7).alias("created"), (kind == 5).alias("removed"), (kind == 9).alias("binary"),
        version(F.col("o_custkey") % 2).alias("v_before"), version(F.floor(F.col("o_custkey") / 2) % 2).alias("v_after"),
    )


FILE_LOG = """file_log AS (SELECT o_orderkey AS change_id, 'f' || (o_orderkey % 500) AS path,
  CASE WHEN kind = 3 THEN 'f' || ((o_orderkey % 500 + 1 + o_custkey % 50) % 500) END AS from_path, kind IN (6, 7) AS created, kind = 5 AS removed, kind = 9 AS binary_,
  'v' || (o_custkey % 2) AS v_before, 'v' || (o_custkey // 2 % 2) AS v_after FROM (SELECT *, o_orderkey // 7 % 23 AS kind FROM orders))"""
