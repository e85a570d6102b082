"""Queries over file tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from .fixtures import FILES_STYLED, FILES_V1, LINES_V1, files_styled, files_v1, lines_of

QUERIES, ORACLES = {}, {}
LIMIT = 8192
INGEST = f"""{FILES_STYLED}, i0 AS (SELECT path, content, sha256(content) AS hash, strlen(content)::BIGINT AS size, contains(content, chr(0)) AS bin,
    CASE WHEN starts_with(content, chr(65279)) THEN substr(content, 2) ELSE content END AS b FROM files_styled)"""
LINES = "length(b) - length(replace(b, chr(10), '')) + CASE WHEN b <> '' AND NOT ends_with(b, chr(10)) THEN 1 ELSE 0 END"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def ingested(spark, d):
    return C.ingest(files_v1(spark, d))


ING = f"{FILES_V1}, ing AS (SELECT path, hash, size, {LINES} AS lines FROM (SELECT path, sha256(content) AS hash, strlen(content)::BIGINT AS size, content AS b FROM files_v1))"


@query("ingest_files", f"WITH {INGEST} SELECT path, hash, size, CASE WHEN bin THEN 0 ELSE {LINES} END AS lines, bin AS is_binary, CASE WHEN bin THEN '' ELSE content END AS content FROM i0")
def ingest_files(spark, d):
    return C.ingest(files_styled(spark, d))


@query(
    "size_guard",
    f"WITH {INGEST} SELECT path, hash, size, CASE WHEN bin OR size > {LIMIT} THEN 0 ELSE {LINES} END AS lines, bin OR size > {LIMIT} AS is_binary, CASE WHEN bin OR size > {LIMIT} THEN '' ELSE content END AS content FROM i0",
)
def size_guard(spark, d):
    return C.ingest(files_styled(spark, d), LIMIT)


@query("corpus_sample", f"WITH {ING} SELECT path, hash, size, lines FROM (SELECT *, coalesce(sum(lines) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ing) WHERE s < 2000")
def corpus_sample(spark, d):
    return C.sample_until(ingested(spark, d), 2000).select("path", "hash", "size", "lines")


@query("corpus_manifest", f"WITH {ING} SELECT path, hash FROM ing")
def corpus_manifest(spark, d):
    return files_v1(spark, d).select("path", F.sha2("content", 256).alias("hash"))


@query(
    "corpus_digest",
    f"WITH {ING}, h AS (SELECT sha256(path || ' ' || hash) AS h FROM ing) SELECT sha256(count(*) || ' ' || "
    + " || ' ' || ".join(f"sum(('0x' || substr(h, {15 * k + 1}, 15))::BIGINT::HUGEINT)" for k in range(4))
    + ") AS digest FROM h",
)
def corpus_digest(spark, d):
    return C.digest(corpus_manifest(spark, d))


@query("corpus_totals", f"WITH {INGEST} SELECT count(*) AS files, sum(CASE WHEN bin THEN 0 ELSE {LINES} END)::BIGINT AS lines, sum(size)::BIGINT AS bytes, count(*) FILTER (bin) AS binary_files FROM i0")
def corpus_totals(spark, d):
    rows = C.ingest(files_styled(spark, d))
    return rows.agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("size").alias("bytes"), F.count_if("is_binary").alias("binary_files"))


PARENTS = """par AS (SELECT path, lines, size, array_to_string(p[1:n], '/') AS dir, n FROM (SELECT path, lines, size, p, unnest(range(0, len(p))) AS n
  FROM (SELECT *, string_split(path, '/') AS p FROM ing)))"""


@query("tree_rollup", f"WITH {ING}, {PARENTS} SELECT dir, n::INT AS depth, count(*) AS files, sum(lines)::BIGINT AS lines, sum(size)::BIGINT AS bytes FROM par GROUP BY dir, n")
def tree_rollup(spark, d):
    return C.tree_rollup(ingested(spark, d)).select("dir", "depth", "files", "lines", "bytes")


ENTRIES = f"""{PARENTS}, ent AS (SELECT dir AS path, n AS depth, true AS is_dir, lines, size FROM par WHERE n > 0
  UNION ALL SELECT path, len(string_split(path, '/')), false, lines, size FROM ing)"""


@query(
    "tree_list",
    f"""WITH {ING}, {ENTRIES}, r AS (SELECT path, bool_or(is_dir) AS is_dir, sum(lines)::BIGINT AS lines, sum(size)::BIGINT AS bytes, max(depth)::INT AS depth FROM ent GROUP BY path)
SELECT *, (SELECT count(*) FROM r WHERE depth <= 3) AS total FROM r WHERE depth <= 3 ORDER BY translate(path, '/', chr(1)) LIMIT 50""",
)
def tree_list(spark, d):
    return C.tree_list(ingested(spark, d), 3, 50)


@query(
    "tree_depth_hint",
    f"""WITH {ING}, {ENTRIES}, c AS (SELECT depth, count(DISTINCT path) AS n FROM ent GROUP BY depth), s AS (SELECT depth, sum(n) OVER (ORDER BY depth) AS so_far FROM c)
SELECT (SELECT max(depth) FROM s WHERE so_far <= 200)::INT AS depth, (SELECT p FROM (SELECT string_split(path, '/')[1] AS p, count(*) AS n FROM ing GROUP BY 1) ORDER BY n DESC, p DESC LIMIT 1) AS largest_dir""",
)
def tree_depth_hint(spark, d):
    return C.depth_hint(ingested(spark, d))


@query("filter_subtree", f"WITH {ING} SELECT path, size FROM ing WHERE starts_with(path, 'docs/src1/')")
def filter_subtree(spark, d):
    return ingested(spark, d).where(C.below(F.col("path"), "docs/src1")).select("path", "size")


GLOBS = ["docs/*/en", "*7.txt", "docs/src1?/**/*3.txt"]


@query(
    "filter_glob",
    f"WITH {ING} SELECT path FROM ing WHERE regexp_matches(path, '^docs/[^/]*/en(/.*)?$') OR regexp_matches(path, '^(.*/)?[^/]*7\\.txt(/.*)?$') OR regexp_matches(path, '^docs/src1[^/]/(.*/)?[^/]*3\\.txt(/.*)?$')",
)
def filter_glob(spark, d):
    return ingested(spark, d).where(C.matches_globs(F.col("path"), GLOBS)).select("path")


RULES = [
    (0, "", "# generated"), (0, "", "*1.txt"), (0, "", "/docs/src2/"), (0, "", "!docs/src3/**/*1.txt"), (0, "", "de/"), (0, "docs/src4", "*.txt"),
    (0, "docs/src4", "!en/*5.txt"), (0, "", "src?/fr/*2.txt"), (1, "", "!*21.txt"), (1, "docs/src5", "/es"),
]
#: The same rules as (layer, base, number, negate, dir only, RE2 pattern).
RULES_SQL = """(VALUES (0, '', 1, false, false, '^(.*/)?[^/]*1\\.txt$'), (0, '', 2, false, true, '^docs/src2$'), (0, '', 3, true, false, '^docs/src3/(.*/)?[^/]*1\\.txt$'),
  (0, '', 4, false, true, '^(.*/)?de$'), (0, 'docs/src4', 5, false, false, '^(.*/)?[^/]*\\.txt$'), (0, 'docs/src4', 6, true, false, '^en/[^/]*5\\.txt$'),
  (0, '', 7, false, false, '^src[^/]/fr/[^/]*2\\.txt$'), (1, '', 8, true, false, '^(.*/)?[^/]*21\\.txt$'), (1, 'docs/src5', 9, false, false, '^es$')) AS t(layer, base, n, negate, dir_only, re)"""


IGNORED = f"""{ING}, {ENTRIES}, a AS (SELECT DISTINCT i.path, e.pt, e.dir FROM ing i, (SELECT DISTINCT path AS pt, is_dir AS dir FROM ent) e WHERE i.path = e.pt OR starts_with(i.path, e.pt || '/')),
h AS (SELECT a.path, a.pt, arg_max(NOT negate, layer * 1000000 + length(base) * 1000 + n) AS hit FROM a JOIN (SELECT * FROM {RULES_SQL}) r
  ON (base = '' OR starts_with(pt, base || '/')) AND (NOT dir_only OR dir) AND regexp_matches(CASE WHEN base = '' THEN pt ELSE substr(pt, length(base) + 2) END, re) GROUP BY ALL)"""


@query("filter_ignored", f"WITH {IGNORED} SELECT ing.path, false AS is_dir, coalesce(bool_or(hit), false) AS ignored FROM ing LEFT JOIN h USING (path) GROUP BY ing.path")
def filter_ignored(spark, d):
    return C.ignored(files_v1(spark, d).select("path", F.lit(False).alias("is_dir")), RULES)


TOTALS = "tot AS (SELECT path, count(*) AS total FROM lines GROUP BY path)"


@query(
    "read_range",
    f"""WITH {FILES_V1}, {LINES_V1}, {TOTALS} SELECT path, line_no::INT AS line_no, text, least(40, total) - 4 > 20 AS truncated,
  CASE WHEN least(40, total) - 4 > 20 THEN 25 END AS next_start, CASE WHEN least(40, total) - 4 > 20 THEN least(40, total)::INT END AS next_end
FROM lines JOIN tot USING (path) WHERE line_no BETWEEN 5 AND least(40, total, 24)""",
)
def read_range(spark, d):
    files = files_v1(spark, d)
    totals = files.select("path", T.line_count(F.col("content")).alias("total"))
    return C.read_range(lines_of(files), totals, 5, 40, 20)


from .scalars import LINE_HASH  # noqa: E402


@query("read_anchored", f"WITH {FILES_V1}, {LINES_V1} SELECT path, line_no::INT AS line_no, line_no || ':' || {LINE_HASH} AS anchor, text FROM lines WHERE line_no BETWEEN 2 AND 6")
def read_anchored(spark, d):
    rows = lines_of(files_v1(spark, d)).where("line_no between 2 and 6")
    return rows.select("path", "line_no", F.concat_ws(":", "line_no", T.line_hash(F.col("text"))).alias("anchor"), "text")


@query("allowed_paths", f"WITH {ING} SELECT path FROM ing WHERE NOT (starts_with(path, 'docs/src1/') OR path = 'docs/src2/en/0000002.txt')")
def allowed_paths(spark, d):
    """Paths that no entry of an allow list covers; an entry is a file, or a directory ending in /."""
    allow = spark.createDataFrame([("docs/src1/",), ("docs/src2/en/0000002.txt",)], "allow string")
    names = files_v1(spark, d).select("path", F.explode(F.concat(F.transform(C.parents(F.col("path")), lambda p: F.concat(p, F.lit("/"))), F.array("path"))).alias("allow"))
    covered = names.join(F.broadcast(allow), "allow").select("path").distinct()  # the list is in the caller's code
    return files_v1(spark, d).select("path").join(covered, "path", "left_anti")


@query("scan_tree", f"WITH {IGNORED}, kept AS (SELECT ing.path, any_value(size) AS size, coalesce(bool_or(hit), false) AS gone FROM ing LEFT JOIN h USING (path) GROUP BY ing.path) SELECT path, size FROM kept WHERE NOT gone")
def scan_tree(spark, d):
    """The files that the ignore rules leave, with their sizes."""
    return C.walked(files_v1(spark, d), RULES)
