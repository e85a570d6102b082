"""Queries that compare two snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reconcile as R
from .fixtures import CHANGES, FILES_V1, FILES_V2, LINES_V1, files_v1, files_v2, lines_of
from .fixtures import changes as logged
from .scalars import LINE_HASH

QUERIES, ORACLES = {}, {}
BOTH = f"{FILES_V1}, {FILES_V2}, a AS (SELECT path, sha256(content) AS hash FROM files_v1), b AS (SELECT path, sha256(content) AS hash FROM files_v2)"
REC = f"""{BOTH}, rec AS (SELECT path, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'modified' ELSE 'unchanged' END AS op,
  a.hash AS old_hash, b.hash AS hash FROM a FULL JOIN b USING (path))"""
MOVES = f"""{REC}, g AS (SELECT path, old_hash AS h, row_number() OVER (PARTITION BY old_hash ORDER BY regexp_extract(path, '^(.*/)', 1), path) AS i FROM rec WHERE op = 'removed'),
n AS (SELECT path, hash AS h, row_number() OVER (PARTITION BY hash ORDER BY regexp_extract(path, '^(.*/)', 1), path) AS i FROM rec WHERE op = 'added'),
mv AS (SELECT n.path, g.path AS from_path, n.h AS hash FROM n JOIN g USING (h, i))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def manifests(spark, d):
    return tuple(f(spark, d).select("path", F.sha2("content", 256).alias("hash")) for f in (files_v1, files_v2))


def changes(spark, d):
    return R.reconcile(*manifests(spark, d))


@query("reconcile", f"WITH {REC} SELECT * FROM rec")
def reconcile(spark, d):
    return changes(spark, d)


@query("reconcile_summary", f"WITH {REC} SELECT count(*) FILTER (op = 'added') AS added, count(*) FILTER (op = 'modified') AS modified, count(*) FILTER (op = 'removed') AS removed, count(*) FILTER (op = 'unchanged') AS unchanged FROM rec")
def reconcile_summary(spark, d):
    return changes(spark, d).agg(*[F.count_if(F.col("op") == x).alias(x) for x in ("added", "modified", "removed", "unchanged")])


@query("detect_moves", f"WITH {MOVES} SELECT * FROM mv")
def detect_moves(spark, d):
    return R.moves(changes(spark, d))


@query("new_paths", f"WITH {BOTH} SELECT path FROM b EXCEPT SELECT path FROM a")
def new_paths(spark, d):
    old, new = manifests(spark, d)
    return new.select("path").join(old, "path", "left_anti")


@query("gone_paths", f"WITH {BOTH} SELECT path FROM a EXCEPT SELECT path FROM b")
def gone_paths(spark, d):
    old, new = manifests(spark, d)
    return old.select("path").join(new, "path", "left_anti")


@query("manifest_diff", f"WITH {BOTH} SELECT path, a.hash AS before, b.hash AS after FROM a FULL JOIN b USING (path) WHERE a.hash IS DISTINCT FROM b.hash")
def manifest_diff(spark, d):
    return changes(spark, d).where("not (old_hash <=> hash)").select("path", F.col("old_hash").alias("before"), F.col("hash").alias("after"))


@query("external_count", f"WITH {CHANGES} SELECT count(*) AS external_changes FROM changes WHERE source = 'external'")
def external_count(spark, d):
    """Recorded changes that came from outside the tool."""
    return logged(spark, d).where("source = 'external'").agg(F.count("*").alias("external_changes"))


@query(
    "stale_paths",
    f"""WITH {FILES_V1}, {FILES_V2}, i AS (SELECT path, strlen(content) AS size, doc_id % 7 AS mtime FROM files_v1),
l AS (SELECT path, strlen(content) AS size, regexp_extract(path, '([0-9]+)\\.txt$', 1)::BIGINT % 6 AS mtime FROM files_v2)
SELECT path, CASE WHEN l.path IS NULL THEN 'vanished' WHEN l.size <> i.size THEN 'size' ELSE 'mtime' END AS reason
FROM i LEFT JOIN l USING (path) WHERE l.path IS NULL OR l.size <> i.size OR l.mtime <> i.mtime""".replace("l.path IS NULL", "l.size IS NULL"),
)
def stale_paths(spark, d):
    indexed = files_v1(spark, d).select("path", F.octet_length("content").alias("size"), (F.col("doc_id") % 7).alias("mtime"))
    listing = files_v2(spark, d).select("path", F.octet_length("content").alias("size"), (F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long") % 6).alias("mtime"))
    return R.stale(indexed, listing)


@query("mark_ignored_removals", f"WITH {REC}, s AS (SELECT path FROM a WHERE regexp_matches(path, '1\\.txt$') OR path IN (SELECT path FROM b)) SELECT path, path IN (SELECT path FROM s) AS now_ignored FROM rec WHERE op = 'removed'")
def mark_ignored_removals(spark, d):
    """Removals whose file a raw scan still finds are newly ignored files, not removals."""
    old, new = manifests(spark, d)
    raw = old.where(F.col("path").rlike(r"1\.txt$")).select("path").union(new.select("path")).distinct()
    gone = R.reconcile(old, new).where("op = 'removed'").select("path")
    there = gone.join(raw, "path", "left_semi").withColumn("now_ignored", F.lit(True))
    return there.union(gone.join(raw, "path", "left_anti").withColumn("now_ignored", F.lit(False)))


@query("changed_paths", f"WITH {MOVES} SELECT path FROM rec WHERE op <> 'unchanged' UNION SELECT from_path FROM mv")
def changed_paths(spark, d):
    rows = changes(spark, d)
    return rows.where("op <> 'unchanged'").select("path").union(R.moves(rows).select("from_path")).distinct()


L1 = f"l1 AS (SELECT path, line_no, {LINE_HASH} AS line_hash FROM lines)"
L2 = f"l2 AS (SELECT path, line_no, text, {LINE_HASH} AS line_hash FROM ({LINES_V1.replace('files_v1', 'files_v2').removeprefix('lines AS ')}))"
REFS = f"""{FILES_V1}, {FILES_V2}, {LINES_V1}, {L1}, {L2}, refs AS (SELECT x.path || '#' || x.line_no AS ref_id, x.path, x.line_no, x.line_hash, y.line_no AS end_line, y.line_hash AS end_hash
  FROM l1 x JOIN l1 y ON x.path = y.path AND y.line_no = x.line_no + CASE WHEN x.line_no % 20 = 0 THEN 3 ELSE 0 END WHERE x.line_no % 10 = 0)"""


def refs(spark, d):
    """Every 10th line of the old snapshot, every 20th as a range of four lines."""
    lines = R.line_refs(lines_of(files_v1(spark, d))).select("path", "line_no", "line_hash")
    start = lines.where("line_no % 10 = 0").withColumn("end_line", F.col("line_no") + F.when(F.col("line_no") % 20 == 0, 3).otherwise(0))
    end = lines.select("path", F.col("line_no").alias("end_line"), F.col("line_hash").alias("end_hash"))
    return start.join(end, ["path", "end_line"]).withColumn("ref_id", F.concat_ws("#", "path", "line_no"))


@query(
    "resolve_anchors",
    f"""WITH {REFS}, m AS (SELECT ref_id, p.line_no - r.line_no AS s FROM refs r JOIN l2 p ON p.path = r.path AND p.line_hash = r.line_hash AND abs(p.line_no - r.line_no) <= 50
  JOIN l2 q ON q.path = r.path AND q.line_hash = r.end_hash AND q.line_no - r.end_line = p.line_no - r.line_no),
f AS (SELECT ref_id, bool_or(s = 0) AS here, count(*) FILTER (s <> 0) AS n, max(s) FILTER (s <> 0) AS s FROM m GROUP BY ref_id),
o AS (SELECT r.*, CASE WHEN here THEN 'in_place' WHEN n = 1 THEN 'moved' ELSE 'mismatch' END AS status, s FROM refs r LEFT JOIN f USING (ref_id))
SELECT ref_id, status, (line_no + CASE status WHEN 'in_place' THEN 0 WHEN 'moved' THEN s END)::INT AS start_line, (end_line + CASE status WHEN 'in_place' THEN 0 WHEN 'moved' THEN s END)::INT AS finish_line FROM o""",
)
def resolve_anchors(spark, d):
    return R.resolve(refs(spark, d), R.line_refs(lines_of(files_v2(spark, d))))


@query(
    "resolve_block",
    f"""WITH {FILES_V1}, {FILES_V2}, {LINES_V1}, {L2}, b AS (SELECT path || '@' || s AS block_id, path, l.line_no - s AS k, l.text FROM (SELECT DISTINCT path, line_no AS s FROM lines WHERE line_no % 15 = 1) JOIN lines l USING (path) WHERE l.line_no BETWEEN s AND s + 1),
z AS (SELECT block_id, count(*) AS n FROM b GROUP BY block_id),
h AS (SELECT block_id, l2.line_no - k AS start, count(*) AS m FROM b JOIN l2 ON l2.path = b.path AND l2.text = b.text GROUP BY ALL),
f AS (SELECT block_id, list(start::INT ORDER BY start) AS starts FROM h JOIN z USING (block_id) WHERE m = n GROUP BY block_id)
SELECT block_id, CASE WHEN starts IS NULL THEN 'not_found' WHEN len(starts) = 1 THEN 'ok' ELSE 'ambiguous' END AS outcome, coalesce(starts, []) AS starts FROM z LEFT JOIN f USING (block_id)""",
)
def resolve_block(spark, d):
    lines = lines_of(files_v1(spark, d))
    at = F.col("line_no") - (F.col("line_no") - 1) % 15
    blocks = lines.where("(line_no - 1) % 15 <= 1").select(F.concat_ws("@", "path", at).alias("block_id"), "path", (F.col("line_no") - at).alias("k"), "text")
    return R.resolve_block(blocks, lines_of(files_v2(spark, d)))


@query(
    "conflict_region",
    f"""WITH {REFS}, tot AS (SELECT path, max(line_no) AS total FROM l2 GROUP BY path),
s AS (SELECT ref_id, path, greatest(1, least(line_no, total) - 2) AS f, least(total, end_line + 2) AS e FROM refs JOIN tot USING (path))
SELECT ref_id, path, l2.line_no::INT AS line_no, text FROM s JOIN l2 USING (path) WHERE l2.line_no BETWEEN f AND least(e, f + 39)""",
)
def conflict_region(spark, d):
    files = files_v2(spark, d)
    totals = files.select("path", T.line_count(F.col("content")).alias("total"))
    return R.conflict_region(refs(spark, d), lines_of(files), totals)
