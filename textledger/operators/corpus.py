"""File tables: ingest, limits, trees, ignore rules, reading line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import text as T

READ_LIMIT = 500
LIST_LIMIT = 200
SIZE_LIMIT = 16 << 20


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, content) of every regular file below root; content is read only if selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^[a-z0-9]+:/*", "/")
    full = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    return files.select(F.replace(full, base, F.lit("")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def walked(files: DataFrame, rules: list[tuple[int, str, str]]) -> DataFrame:
    """(path, size) of the files (path, content) that no ignore rule leaves out."""
    kept = ignored(files.select("path", F.lit(False).alias("is_dir")), rules).where("not ignored").select("path")
    return files.join(kept, "path").select("path", F.octet_length("content").cast("long").alias("size"))


def digest(manifest: DataFrame) -> DataFrame:
    """(digest): of the set of (path, hash), in any order: sums of the parts of their hashes, so no task orders or holds it."""
    h = F.sha2(F.concat_ws(" ", "path", "hash"), 256)
    sums = [F.sum(F.conv(F.substring(h, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return manifest.agg(F.sha2(F.concat_ws(" ", F.count("*"), *sums), 256).alias("digest"))


def ingest(files: DataFrame, limit: int = SIZE_LIMIT) -> DataFrame:
    """(path, hash, size, lines, is_binary, content) of files (path, content).

    Files over the limit or not text keep their hash and size only.
    """
    rows = files.withColumn("size", F.octet_length("content").cast("long"))
    text = (F.col("size") <= limit) & T.is_text(F.col("content"))
    return rows.select(
        "path",
        F.sha2(F.col("content").cast("binary"), 256).alias("hash"),
        "size",
        F.when(text, T.line_count(F.col("content"))).otherwise(0).alias("lines"),
        (~text).alias("is_binary"),
        F.when(text, F.col("content")).otherwise("").alias("content"),
    )


def sample_until(files: DataFrame, cap: int) -> DataFrame:
    """Text files in path order while the lines before them are under the cap.

    Lines are summed by directory first; only the directory in which the cap is reached is ranked
    file by file, so no task sorts all paths.
    """
    rows = files.where(~F.col("path").rlike(r"(^|/)(\.|testdata/)") & ~F.col("is_binary"))
    rows = rows.withColumn("dir", F.regexp_extract("path", "^(.*)/", 1))
    by_dir = Window.orderBy("dir").rowsBetween(Window.unboundedPreceding, -1)
    dirs = rows.groupBy("dir").agg(F.sum("lines").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(by_dir), F.lit(0)))
    inside = Window.partitionBy("dir").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(dirs.where(F.col("before") < cap).select("dir", "before"), "dir")
    rows = rows.withColumn("start", F.col("before") + F.coalesce(F.sum("lines").over(inside), F.lit(0)))
    return rows.where(F.col("start") < cap).drop("dir", "before", "start")


def parents(path: Column) -> Column:
    """All directories above a path, the top ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def tree_rollup(files: DataFrame) -> DataFrame:
    """(dir, depth, files, lines, bytes) for every directory at every depth."""
    rows = files.select(F.explode(parents(F.col("path"))).alias("dir"), "lines", "size")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))).cast("int")
    return rows.groupBy("dir").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("size").alias("bytes")).withColumn("depth", depth)


def tree_order(path: Column) -> Column:
    """Sorts names depth-first: a directory's entries stand together."""
    return F.translate(path, "/", "\u0001")


def tree_list(files: DataFrame, depth: int, limit: int = LIST_LIMIT) -> DataFrame:
    """Files and directories down to a depth, in tree order, cut at the limit, with the total before the cut."""
    entries = files.select(F.explode(F.filter(F.concat(parents(F.col("path")), F.array("path")), lambda p: p != "")).alias("path"), F.col("path").alias("file"), "lines", "size")
    rolled = entries.groupBy("path").agg(F.max(F.col("path") != F.col("file")).alias("is_dir"), F.sum("lines").alias("lines"), F.sum("size").alias("bytes"))
    rolled = rolled.withColumn("depth", F.size(F.split("path", "/"))).where(F.col("depth") <= depth)
    total = rolled.agg(F.count("*").alias("total"))
    first = rolled.orderBy(tree_order(F.col("path"))).limit(limit)
    return first.crossJoin(F.broadcast(total))  # total is one row


def depth_hint(files: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The deepest depth whose entries, with all above, fit the limit; else the largest top directory."""
    parts = F.explode(F.filter(F.concat(parents(F.col("path")), F.array("path")), lambda p: p != ""))
    counts = files.select(parts.alias("p")).distinct().groupBy(F.size(F.split("p", "/")).alias("depth")).agg(F.count("*").alias("n"))
    run = counts.withColumn("so_far", F.sum("n").over(Window.orderBy("depth")))  # one row for each depth
    deepest = run.agg(F.max(F.when(F.col("so_far") <= limit, F.col("depth"))).alias("depth"))
    tops = files.groupBy(F.split("path", "/")[0].alias("dir")).agg(F.count("*").alias("files"))
    largest = tops.agg(F.max_by("dir", F.struct("files", "dir")).alias("largest_dir"))
    return deepest.crossJoin(largest)  # one row each


def below(path: Column, directory: str) -> Column:
    """Paths in a directory as a range that Parquet's statistics can prune ('0' follows '/')."""
    return (path >= f"{directory}/") & (path < f"{directory}0")


def matches_globs(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(globs.path_regex(p))
    return out


def ignored(paths: DataFrame, rules: list[tuple[int, str, str]]) -> DataFrame:
    """paths (path, is_dir) with ignored. rules: (layer, base directory, line), in file order.

    Of the rules that match a path or one of its parents the last decides: the higher layer, then the
    deeper base, then the later line. A path below an ignored directory is ignored.
    """
    spark = paths.sparkSession
    rows = []
    for n, (layer, base, line) in enumerate(rules):
        rule = globs.ignore_rule(line)
        if rule:
            rows.append((layer, base, n, rule["negate"], rule["dir_only"], rule["regex"]))
    table = spark.createDataFrame(rows, "layer int, base string, n int, negate boolean, dir_only boolean, regex string")
    one = F.explode(F.filter(F.concat(F.transform(parents(F.col("path")), lambda p: F.struct(p.alias("at"), F.lit(True).alias("dir"))), F.array(F.struct(F.col("path").alias("at"), F.col("is_dir").alias("dir")))), lambda x: x["at"] != ""))
    above = paths.select("path", "is_dir", one.alias("x")).select("path", "is_dir", "x.at", "x.dir")
    distinct = above.select("at", "dir").distinct()
    inside = (F.col("base") == "") | F.startswith("at", F.concat("base", F.lit("/")))
    # The rules are a fixed list in the caller's code, so broadcasting them is bounded.
    hits = distinct.join(F.broadcast(table), inside & (~F.col("dir_only") | F.col("dir")) & F.expr("rlike(CASE WHEN base = '' THEN at ELSE substring(at, length(base) + 2) END, regex)"))
    order = F.struct("layer", F.length("base"), "n")
    verdict = hits.groupBy("at", "dir").agg(F.max_by(~F.col("negate"), order).alias("hit"))
    return above.join(verdict, ["at", "dir"], "left").groupBy("path", "is_dir").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("ignored"))


def read_range(lines: DataFrame, totals: DataFrame, start: int, end: int, limit: int = READ_LIMIT) -> DataFrame:
    """Lines start..end of every file, cut at the limit, with where to go on. totals: (path, total)."""
    last = F.least(F.lit(end), F.col("total"))
    cut = last - start + 1 > limit
    rows = lines.join(totals, "path").where((F.col("line_no") >= start) & (F.col("line_no") <= F.least(last, F.lit(start + limit - 1))))
    return rows.select(
        "path", "line_no", "text", cut.alias("truncated"), F.when(cut, start + limit).alias("next_start"), F.when(cut, last).cast("int").alias("next_end")
    )
