"""Queries over changes, fragments and versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import history as H
from ..operators import lifelines as L
from ..operators import reconcile as R
from ..operators import versions as V
from ..sources.tables import durable
from .fixtures import CHANGES, FILE_LOG, FILES_V1, FILES_V2, FRAGMENTS, changes, file_log, files_v1, files_v2, files_v3, fragments, lines_of, table
from .snapshots import MOVES

QUERIES, ORACLES = {}, {}
SHIFTED = f"""{FRAGMENTS}, sh AS (SELECT *, coalesce(sum(new_n - old_n) OVER (PARTITION BY change_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM fragments)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("fragment_ranges", f"WITH {SHIFTED} SELECT change_id, seq, pos + shift + 1 AS range_start, pos + shift + new_n AS range_end FROM sh")
def fragment_ranges(spark, d):
    return H.after_ranges(fragments(spark, d))


@query("diff_reverse", f"WITH {SHIFTED} SELECT change_id, seq, pos + shift AS pos, new_n AS old_n, old_n AS new_n FROM sh")
def diff_reverse(spark, d):
    return H.reversed_fragments(fragments(spark, d))


@query("fragment_shape", f"WITH {FRAGMENTS} SELECT change_id, count(*) AS ranges, sum(new_n)::BIGINT AS added, sum(old_n)::BIGINT AS removed FROM fragments GROUP BY change_id")
def fragment_shape(spark, d):
    return fragments(spark, d).groupBy("change_id").agg(F.count("*").alias("ranges"), F.sum("new_n").alias("added"), F.sum("old_n").alias("removed"))


def hop_refs(spark, d):
    """Three ranges for each order, one of them empty."""
    k = F.explode(F.array(F.lit(0), F.lit(7), F.lit(25))).alias("n")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("change_id"), k)
    lo = F.col("change_id") % 30
    return rows.select(F.concat_ws("-", "change_id", "n").alias("ref_id"), "change_id", lo.alias("lo"), (lo + F.col("n")).alias("hi"))


HOP_REFS = "hr AS (SELECT o_orderkey || '-' || n AS ref_id, o_orderkey AS change_id, o_orderkey % 30 AS lo, o_orderkey % 30 + n AS hi FROM orders, (SELECT unnest([0, 7, 25]) AS n))"
HOP = f"""{SHIFTED}, {HOP_REFS}, hop AS (SELECT ref_id, any_value(r.lo) AS lo0, any_value(r.hi) AS hi0,
  coalesce(bool_or(CASE WHEN r.lo = r.hi THEN (old_n > 0 AND pos < lo AND lo < pos + old_n) OR (old_n = 0 AND pos = lo) ELSE (old_n > 0 AND pos < hi AND pos + old_n > lo) OR (old_n = 0 AND lo < pos AND pos < hi) END), false) AS hit,
  coalesce(max(CASE WHEN pos < lo AND lo < pos + old_n THEN pos + shift END), any_value(r.lo) + coalesce(sum(CASE WHEN pos + old_n <= lo AND (old_n > 0 OR pos <= lo) THEN new_n - old_n ELSE 0 END), 0))::BIGINT AS lo1,
  coalesce(max(CASE WHEN pos < hi AND hi < pos + old_n THEN pos + shift + new_n END), any_value(r.hi) + coalesce(sum(CASE WHEN pos + old_n <= hi AND (old_n > 0 OR pos < hi) THEN new_n - old_n ELSE 0 END), 0))::BIGINT AS hi1
  FROM hr r LEFT JOIN sh USING (change_id) GROUP BY ref_id)"""


@query("map_range_hop", f"WITH {HOP} SELECT ref_id, lo1 AS lo, CASE WHEN lo0 = hi0 THEN lo1 ELSE hi1 END AS hi, hit FROM hop")
def map_range_hop(spark, d):
    return H.map_hop(hop_refs(spark, d), fragments(spark, d)).drop("by")


@query("overlapping_changes", f"WITH {HOP} SELECT ref_id, split_part(ref_id, '-', 1)::BIGINT AS change_id FROM hop WHERE hit")
def overlapping_changes(spark, d):
    hits = map_range_hop(spark, d).where("hit")
    return hits.select("ref_id", F.split("ref_id", "-")[0].cast("long").alias("change_id"))


@query("version_check")
def version_check(spark, d):
    """Edits asked for against the first snapshot's files, now in their second version.

    An edit is accepted if its file hasn't changed, or if its range maps untouched to where its lines
    stand now; otherwise it is a conflict, or its file is gone.
    """
    from .snapshots import refs

    asked = refs(spark, d).select("ref_id", "path", (F.col("line_no") - 1).cast("long").alias("lo"), F.col("end_line").cast("long").alias("hi"))
    frags = counted(H.line_diff(pairs(spark, d)))
    versions_ = [f(spark, d).select("path", T.content_version(F.col("content")).alias(v)) for f, v in ((files_v1, "v"), (files_v2, "now"))]
    files = versions_[0].join(versions_[1], "path", "left")
    mapped = H.map_hop(asked, frags, "path").select("ref_id", F.col("lo").alias("at"), F.col("hi").alias("end"), "hit")
    rows = asked.join(mapped, "ref_id").join(files, "path")
    verdict = F.when(F.col("now").isNull(), "gone").when(F.col("v") == F.col("now"), "current").when(F.col("hit"), "conflict").otherwise("mapped")
    ok = verdict.isin("current", "mapped")
    return rows.select("ref_id", verdict.alias("verdict"), F.when(ok, F.col("at") + 1).alias("start_line"), F.when(ok, F.col("end")).alias("finish_line"))


@query("map_range")
def map_range(spark, d):
    """References into 500 paths' first versions, carried through all changes of their path."""
    path = (F.col("change_id") % 500).cast("string").alias("path")
    frags = fragments(spark, d).select(path, "change_id", "seq", "pos", "old_n", "new_n")
    refs = hop_refs(spark, d).select("ref_id", path, F.col("change_id").alias("since"), "lo", "hi")
    return H.map_ranges(refs, frags)


LAMBDA = {
    "hit": "len(list_filter(fr, lambda f: CASE WHEN lo = hi THEN (f.o > 0 AND f.p < lo AND lo < f.p + f.o) OR (f.o = 0 AND f.p = lo) ELSE (f.o > 0 AND f.p < hi AND f.p + f.o > lo) OR (f.o = 0 AND lo < f.p AND f.p < hi) END)) > 0",
    "lo1": "coalesce(list_max(list_transform(list_filter(fr, lambda f: f.p < lo AND lo < f.p + f.o), lambda f: f.p + f.s)), lo + coalesce(list_sum(list_transform(list_filter(fr, lambda f: f.p + f.o <= lo AND (f.o > 0 OR f.p <= lo)), lambda f: f.n - f.o)), 0))::BIGINT",
    "hi1": "coalesce(list_max(list_transform(list_filter(fr, lambda f: f.p < hi AND hi < f.p + f.o), lambda f: f.p + f.s + f.n)), hi + coalesce(list_sum(list_transform(list_filter(fr, lambda f: f.p + f.o <= hi AND (f.o > 0 OR f.p < hi)), lambda f: f.n - f.o)), 0))::BIGINT",
}
#: Each step takes the next change of the path that a reference is at.
FOLLOW = f"""{FILE_LOG}, {SHIFTED}, {HOP_REFS},
spots AS (SELECT path, change_id FROM file_log UNION SELECT from_path, change_id FROM file_log WHERE from_path IS NOT NULL),
chain AS (SELECT path, change_id, lead(change_id) OVER (PARTITION BY path ORDER BY change_id) AS next FROM spots),
fr AS (SELECT change_id, list({{'p': pos, 'o': old_n, 'n': new_n, 's': shift}} ORDER BY seq) AS fr FROM sh GROUP BY change_id),
ev AS (SELECT l.*, coalesce(fr, []) AS fr, (SELECT min(c.change_id) FROM spots c WHERE c.path = l.path AND c.change_id > l.change_id) AS target_next FROM file_log l LEFT JOIN fr USING (change_id)),
walk AS (
  SELECT ref_id, path, chain.next AS cur, lo, hi, false AS removed, -1::BIGINT AS gone, '' AS gone_v, []::BIGINT[] AS ov
    FROM hr JOIN chain ON chain.change_id = hr.change_id AND chain.path = 'f' || (hr.change_id % 500)
  UNION ALL
  SELECT w.ref_id, CASE WHEN away THEN e.path ELSE w.path END, CASE WHEN away THEN target_next ELSE chain.next END,
    CASE WHEN edit THEN lo1 ELSE lo END, CASE WHEN edit THEN CASE WHEN lo = hi THEN lo1 ELSE hi1 END ELSE hi END,
    CASE WHEN w.removed OR drops THEN e.removed ELSE false END,
    CASE WHEN drops THEN e.change_id ELSE gone END, CASE WHEN drops THEN e.v_before ELSE gone_v END,
    CASE WHEN w.removed AND e.created AND NOT e.binary_ AND e.v_after = gone_v THEN list_filter(ov, lambda x: x <> gone)
      WHEN w.removed OR (NOT away AND (NOT edit OR hit)) THEN list_append(ov, e.change_id) ELSE ov END
  FROM (SELECT w.*, {LAMBDA['hit']} AS hit, {LAMBDA['lo1']} AS lo1, {LAMBDA['hi1']} AS hi1, e.from_path IS NOT DISTINCT FROM w.path AS away,
      NOT w.removed AND e.from_path IS NULL AND NOT e.binary_ AND NOT e.removed AS edit, NOT w.removed AND e.from_path IS NULL AND NOT e.binary_ AND e.removed AS drops
    FROM walk w JOIN ev e ON e.change_id = w.cur) w JOIN ev e ON e.change_id = w.cur JOIN chain ON chain.change_id = w.cur AND chain.path = w.path)"""


@query("map_range_moves", f'WITH RECURSIVE {FOLLOW} SELECT ref_id, path, lo, hi, ov AS "overlaps", removed FROM walk WHERE cur IS NULL')
def map_range_moves(spark, d):
    """References into versions of 500 files, carried through all later changes wherever the files went."""
    refs = hop_refs(spark, d).select("ref_id", F.concat(F.lit("f"), (F.col("change_id") % 500).cast("string")).alias("path"), F.col("change_id").alias("since"), "lo", "hi")
    return L.followed(refs, file_log(spark, d), fragments(spark, d))


def versions(spark, d):
    """(path, change_id, content, v_after, v_before): a conversation's turns as versions of one file."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = table(spark, d, "conversations").withColumn("i", F.row_number().over(w))
    rows = rows.withColumn("v_after", F.substring(F.sha2("text", 256), 1, 6)).withColumn("prev", F.lag("v_after").over(w))
    before = F.when((F.col("conv_id") % 5 == 0) & (F.col("i") % 4 == 3), "ffffff").otherwise(F.col("prev"))
    return rows.select(
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), (F.col("i") * 1000 + F.col("conv_id") % 1000).alias("change_id"),
        F.when(F.col("i") % 6 != 5, F.col("text")).alias("content"), before.alias("v_before"), "v_after",
    )


VERSIONS = """ver AS (SELECT 'conv/' || conv_id AS path, i * 1000 + conv_id % 1000 AS change_id, CASE WHEN i % 6 <> 5 THEN text END AS content,
  CASE WHEN conv_id % 5 = 0 AND i % 4 = 3 THEN 'ffffff' ELSE lag(v) OVER (PARTITION BY conv_id ORDER BY i) END AS v_before, v AS v_after
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, substr(sha256(text), 1, 6) AS v FROM conversations))"""


@query("version_chain", f"WITH {VERSIONS}, c AS (SELECT path, change_id, v_before, lag(v_after) OVER (PARTITION BY path ORDER BY change_id) AS prev, lag(content IS NULL) OVER (PARTITION BY path ORDER BY change_id) AS gone FROM ver) SELECT path, change_id, CASE WHEN gone THEN 'removed' ELSE 'version' END AS reason FROM c WHERE gone OR (prev IS NOT NULL AND v_before IS DISTINCT FROM prev)")
def version_chain(spark, d):
    """Where a walk back breaks: behind a removal, or a version before that isn't its predecessor's."""
    w = Window.partitionBy("path").orderBy("change_id")
    rows = versions(spark, d).withColumns({"prev": F.lag("v_after").over(w), "gone": F.coalesce(F.lag(F.col("content").isNull()).over(w), F.lit(False))})
    broken = rows.where(F.col("gone") | (F.col("prev").isNotNull() & ~F.col("v_before").eqNullSafe(F.col("prev"))))
    return broken.select("path", "change_id", F.when(F.col("gone"), "removed").otherwise("version").alias("reason"))


@query("version_validity", f"WITH {VERSIONS} SELECT path, v_after AS version, change_id AS valid_from, lead(change_id) OVER (PARTITION BY path ORDER BY change_id) AS valid_to FROM ver")
def version_validity(spark, d):
    w = Window.partitionBy("path").orderBy("change_id")
    return versions(spark, d).select("path", F.col("v_after").alias("version"), F.col("change_id").alias("valid_from"), F.lead("change_id").over(w).alias("valid_to"))


ASOF = f"{VERSIONS}, aso AS (SELECT path, max(change_id) AS change_id, arg_max(coalesce(content, chr(0)), change_id) AS c FROM ver WHERE change_id <= 3500 GROUP BY path)"


@query("asof_content", f"WITH {ASOF} SELECT path, change_id, nullif(c, chr(0)) AS content FROM aso")
def asof_content(spark, d):
    return H.as_of(versions(spark, d), 3500)


@query(
    "restore_point",
    f"""WITH {ASOF}, now AS (SELECT path, arg_max(coalesce(content, chr(0)), change_id) AS n FROM ver GROUP BY path), ch AS (SELECT DISTINCT path FROM ver WHERE change_id > 3500)
SELECT path, CASE WHEN nullif(c, chr(0)) IS NOT DISTINCT FROM nullif(n, chr(0)) THEN 'keep' WHEN nullif(c, chr(0)) IS NULL THEN 'remove' WHEN nullif(n, chr(0)) IS NULL THEN 'create' ELSE 'rewrite' END AS action
FROM ch JOIN now USING (path) LEFT JOIN aso USING (path)""",
)
def restore_point(spark, d):
    return H.restore(versions(spark, d), 3500)


def pairs(spark, d):
    """(path, old, new) lines of the files whose content differs between the snapshots."""
    old, new = files_v1(spark, d).select("path", F.col("content").alias("a")), files_v2(spark, d).select("path", F.col("content").alias("b"))
    return differing(old, new)


#: Most hashes of paths that are sent to all tasks: some 64 MB.
MOST_PATHS = 2_000_000


def differing(old, new):
    """(path, old, new) lines of the files whose contents differ; only contents of paths that may are shuffled."""
    a, b = (f.select("path", F.sha2(c, 256).alias("h")) for f, c in ((old, "a"), (new, "b")))
    paths = durable(a.join(b.withColumnRenamed("h", "now"), "path").where("h <> now").select(F.xxhash64("path").alias("key")).distinct())
    if paths.limit(MOST_PATHS + 1).count() <= MOST_PATHS:
        old, new = (f.join(F.broadcast(paths), F.xxhash64("path") == F.col("key"), "left_semi") for f in (old, new))
    both = old.join(new, "path").where("a <> b")
    return both.select("path", T.split_lines(F.col("a")).alias("old"), T.split_lines(F.col("b")).alias("new"))


def later_pairs(spark, d):
    """The same between the second snapshot and the third."""
    return differing(files_v2(spark, d).select("path", F.col("content").alias("a")), files_v3(spark, d).select("path", F.col("content").alias("b")))


@query("line_diff")
def line_diff(spark, d):
    return H.line_diff(pairs(spark, d))


@query(
    "diff_apply",
    f"WITH {FILES_V1}, {FILES_V2} SELECT path, sha256(array_to_string(CASE WHEN l[len(l)] = '' THEN l[1:len(l)-1] ELSE l END, chr(10))) AS hash, false AS mismatch FROM (SELECT path, string_split(b.content, chr(10)) AS l FROM files_v1 a JOIN files_v2 b USING (path) WHERE a.content <> b.content)",
)
def diff_apply(spark, d):
    changed = pairs(spark, d).select("path", F.posexplode("old").alias("i", "text")).select("path", (F.col("i") + 1).alias("line_no"), "text")
    after = H.apply_fragments(changed, H.line_diff(pairs(spark, d)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return after.groupBy("path").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"), F.max("mismatch").alias("mismatch"))


def counted(frags):
    return frags.withColumns({"old_n": F.size("old"), "new_n": F.size("new")})


def text_of(lines):
    """(path, text) of (path, line_no, text)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return lines.groupBy("path").agg(F.array_join(ordered, "\n").alias("text"))


@query("reconstruct_version")
def reconstruct_version(spark, d):
    """The first snapshot's files from the third's lines: later edits, moves and edits are taken back; whether each is right."""
    old, new = (f(spark, d).select("path", F.sha2("content", 256).alias("hash")) for f in (files_v1, files_v2))
    moved = R.moves(R.reconcile(old, new)).select("path", "from_path")
    steps = [H.line_diff(later_pairs(spark, d)), moved, H.line_diff(pairs(spark, d))]
    hashed = lambda lines: F.sha2(F.array_join(lines, "\n"), 256).alias("text")
    back = H.reconstruct(files_v3(spark, d).select("path", T.split_lines(F.col("content")).alias("lines")), steps)
    back = back.select("path", hashed(F.col("lines")), "mismatch")
    kept = new.select("path").join(moved, "path", "left").select(F.coalesce("from_path", "path").alias("path"))
    lines = T.split_lines(F.col("content"))
    was = files_v1(spark, d).select("path", T.content_version(F.array_join(lines, "\n")).alias("version"), hashed(lines).alias("was")).join(kept, "path", "left_semi")
    rows = was.join(back, "path", "left")
    same = ~F.coalesce("mismatch", F.lit(False)) & (F.coalesce("text", F.sha2(F.lit(""), 256)) == F.col("was"))
    return rows.select("path", "version", same.alias("same"))


def planned(spark, d):
    frags = H.line_diff(pairs(spark, d))
    return frags, H.undo_plan(frags, H.line_diff(later_pairs(spark, d)))


@query("undo_plan")
def undo_plan(spark, d):
    """An undo of the edits between the first two snapshots, after those that led to the third."""
    return planned(spark, d)[1]


def edit_log(spark, d):
    """The edits from the first snapshot to the second and on to the third as a log: (changes, fragments), two changes of a path at most."""
    parts = []
    for k, p in enumerate((pairs(spark, d), later_pairs(spark, d))):
        parts.append(H.line_diff(p).withColumn("change_id", 2 * F.crc32("path") + k))
    frags = durable(parts[0].unionByName(parts[1]))
    none, no = F.lit(None).cast("string"), F.lit(False)
    log = frags.select("change_id", "path", none.alias("from_path"), no.alias("created"), no.alias("removed"), no.alias("binary"), none.alias("v_before"), none.alias("v_after")).distinct()
    return log, frags.drop("path")


@query(
    "find_versions",
    f"""WITH {FILES_V1}, {FILES_V2}, m AS (SELECT a.path AS src, b.path AS path, a.content FROM files_v1 a JOIN files_v2 b ON b.path = 'archive' || a.path[5:]),
e AS (SELECT path, substr(sha256(a.content), 1, 6) AS v, a.content, a.content = b.content AS same FROM files_v1 a JOIN files_v2 b USING (path))
SELECT path AS req_id, CASE WHEN same THEN 'current' ELSE 'found' END AS status, path, sha256(content) AS hash FROM e
UNION ALL SELECT path, 'current', path, sha256(content) FROM m UNION ALL SELECT src, 'found', src, sha256(content) FROM m""",
)
def find_versions(spark, d):
    """The first snapshot's contents of the files that the second still has, moved or edited, by their versions.

    Each file is asked for where it is now; a moved one also by the path that it left.
    """
    old, new = files_v1(spark, d).select("path", "content"), files_v2(spark, d).select("path", "content")
    # The log and the requests are made of hashes; contents are joined only where they are changed or asked for.
    was, now = (f.select("path", F.sha2("content", 256).alias(h)) for f, h in ((old, "was"), (new, "now")))
    was = durable(was)
    moved = was.withColumn("to", F.concat(F.lit("archive"), F.substring("path", 5, 1 << 20))).join(new.select(F.col("path").alias("to")), "to")
    version = lambda c: F.substring(c, 1, 6)
    none, no = F.lit(None).cast("string"), F.lit(False)
    move_log = moved.select(F.col("to").alias("path"), F.col("path").alias("from_path"), version("was").alias("v_before"), version("was").alias("v_after"))
    edited = durable(was.join(now, "path"))
    edit_log = edited.where("was <> now").select("path", none.alias("from_path"), version("was").alias("v_before"), version("now").alias("v_after"))
    log = durable(move_log.unionByName(edit_log).withColumns({"created": no, "removed": no, "binary": no, "change_id": F.monotonically_increasing_id() + 1}))
    frags = H.line_diff(pairs(spark, d)).join(log.where("from_path is null").select("path", "change_id"), "path").drop("path")
    here = edited.select("path", version("was").alias("v")).unionByName(moved.select(F.col("to").alias("path"), version("was").alias("v")))
    asked = here.unionByName(moved.select("path", version("was").alias("v"))).withColumn("req_id", F.col("path"))
    found = V.reconstructed(asked, log, frags, new)
    return found.select("req_id", "status", "path", F.sha2("content", 256).alias("hash"))


@query("undo_plan_changes")
def undo_plan_changes(spark, d):
    """What an undo of each edit of a log would do to the third snapshot's files, conflicts by the numbers of later changes."""
    log, frags = edit_log(spark, d)
    return L.undo_plans(log, frags, lines_of(files_v3(spark, d)))


@query("undo_preview")
def undo_preview(spark, d):
    """Hunks of the undo before and after in files without a conflict, with the version that it gives."""
    frags, plan = (durable(x) for x in planned(spark, d))  # diffs are used several times
    todo = H.undo_fragments(plan, frags)
    lines = lines_of(files_v3(spark, d)).join(todo.select("path").distinct(), "path", "left_semi")
    after = text_of(H.apply_fragments(lines, todo)).select("path", T.content_version(F.col("text")).alias("version"))
    hunks = todo.select("path", "seq", (F.col("pos") + 1).alias("line_no"), F.array_join("old", "\n").alias("before"), F.array_join("new", "\n").alias("after"))
    return hunks.join(after, "path", "left")


@query(
    "record_changes",
    f"""WITH {MOVES} SELECT rec.path, CASE WHEN mv.path IS NULL THEN op ELSE 'moved' END AS op, mv.from_path,
  substr(CASE WHEN mv.path IS NULL THEN old_hash ELSE rec.hash END, 1, 6) AS v_before, substr(rec.hash, 1, 6) AS v_after
FROM rec LEFT JOIN mv ON mv.path = rec.path WHERE op <> 'unchanged' AND NOT (op = 'removed' AND rec.path IN (SELECT from_path FROM mv))""",
)
def record_changes(spark, d):
    """One record for each change between the snapshots: a move is one, with the path that it left."""
    old, new = (f(spark, d).select("path", F.sha2("content", 256).alias("hash")) for f in (files_v1, files_v2))
    rows = R.reconcile(old, new).where("op <> 'unchanged'")
    moved = R.moves(rows).select("path", "from_path")
    left = moved.select(F.col("from_path").alias("path"))
    rows = rows.join(left, "path", "left_anti").join(moved, "path", "left")
    here = F.col("from_path").isNotNull()
    before = F.when(here, F.col("hash")).otherwise(F.col("old_hash"))
    return rows.select("path", F.when(here, "moved").otherwise(F.col("op")).alias("op"), "from_path", F.substring(before, 1, 6).alias("v_before"), F.substring("hash", 1, 6).alias("v_after"))


@query("filter_history", f"WITH {CHANGES} SELECT change_id, author, path, op FROM changes WHERE (starts_with(path, 'docs/f1') OR starts_with(coalesce(from_path, ''), 'docs/f1')) AND time >= TIMESTAMP '2024-01-10' AND change_id < 9000 AND author = 'u3' ORDER BY change_id DESC LIMIT 50")
def filter_history(spark, d):
    here = F.startswith("path", F.lit("docs/f1")) | F.coalesce(F.startswith("from_path", F.lit("docs/f1")), F.lit(False))
    rows = changes(spark, d).where(here & (F.col("time") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("change_id") < 9000) & (F.col("author") == "u3"))
    return rows.orderBy(F.desc("change_id")).limit(50).select("change_id", "author", "path", "op")


KIND = "CASE op WHEN 'create' THEN 'added' WHEN 'remove' THEN 'removed' WHEN 'move' THEN 'moved' ELSE 'modified' END"


@query("change_kind", f"WITH {CHANGES} SELECT change_id, {KIND} AS kind FROM changes")
def change_kind(spark, d):
    return changes(spark, d).select("change_id", kind().alias("kind"))


def kind():
    return F.when(F.col("op") == "create", "added").when(F.col("op") == "remove", "removed").when(F.col("op") == "move", "moved").otherwise("modified")


@query("change_summary", f"WITH {CHANGES} SELECT change_id, CASE WHEN op = 'create' THEN 'created' WHEN op = 'remove' THEN 'removed' WHEN op = 'move' THEN 'moved from ' || from_path WHEN op = 'rollback' AND undid IS NOT NULL THEN 'undid ' || undid WHEN k % 3 = 0 THEN 'line ' || (k + 1) ELSE 'lines ' || (k + 1) || '-' || (k + 1 + k % 3) END AS summary FROM changes")
def change_summary(spark, d):
    op, k = F.col("op"), F.col("k")
    lines = F.when(k % 3 == 0, F.concat(F.lit("line "), (k + 1).cast("string"))).otherwise(F.concat(F.lit("lines "), (k + 1).cast("string"), F.lit("-"), (k + 1 + k % 3).cast("string")))
    text = (
        F.when(op == "create", "created").when(op == "remove", "removed").when(op == "move", F.concat(F.lit("moved from "), F.col("from_path")))
        .when((op == "rollback") & F.col("undid").isNotNull(), F.concat(F.lit("undid "), F.col("undid").cast("string"))).otherwise(lines)
    )
    return changes(spark, d).select("change_id", text.alias("summary"))


@query("history_page", f"WITH {CHANGES} SELECT change_id, author, path, op, (SELECT count(*) FROM changes WHERE change_id < 5000) > 25 AS more FROM changes WHERE change_id < 5000 ORDER BY change_id DESC LIMIT 25")
def history_page(spark, d):
    k = 25
    page = changes(spark, d).where("change_id < 5000").orderBy(F.desc("change_id")).limit(k + 1)
    rows = page.withColumn("r", F.row_number().over(Window.orderBy(F.desc("change_id")))).withColumn("n", F.count("*").over(Window.partitionBy()))  # k + 1 rows
    return rows.where(F.col("r") <= k).select("change_id", "author", "path", "op", (F.col("n") > k).alias("more"))


@query("changes_page", f"WITH {CHANGES}, f AS (SELECT * FROM changes WHERE change_id > 400 AND (regexp_matches(path, '^docs/f1[^/]*(/.*)?$') OR regexp_matches(coalesce(from_path, ''), '^docs/f1[^/]*(/.*)?$'))), p AS (SELECT * FROM f ORDER BY change_id LIMIT 100) SELECT change_id, path, op, CASE WHEN (SELECT count(*) FROM f) > 100 THEN (SELECT max(change_id) FROM p) ELSE greatest((SELECT max(change_id) FROM changes), 400) END AS next_cursor FROM p")
def changes_page(spark, d):
    since, k = 400, 100
    rows = changes(spark, d)
    here = F.col("path").rlike("^docs/f1[^/]*(/.*)?$") | F.coalesce(F.col("from_path").rlike("^docs/f1[^/]*(/.*)?$"), F.lit(False))
    page = rows.where((F.col("change_id") > since) & here).orderBy("change_id").limit(k + 1)
    page = page.withColumn("r", F.row_number().over(Window.orderBy("change_id")))  # k + 1 rows
    ends = page.agg(F.max("r").alias("n"), F.max(F.when(F.col("r") <= k, F.col("change_id"))).alias("last"))
    ends = ends.crossJoin(rows.agg(F.max("change_id").alias("latest")))  # one row each
    cursor = F.when(F.col("n") > k, F.col("last")).otherwise(F.greatest("latest", F.lit(since)))
    return page.where(F.col("r") <= k).crossJoin(ends).select("change_id", "path", "op", cursor.alias("next_cursor"))


@query("diff_page", f"WITH {FRAGMENTS}, r AS (SELECT *, old_n + new_n AS n, coalesce(sum(old_n + new_n) OVER (PARTITION BY change_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, sum(old_n + new_n) OVER (PARTITION BY change_id)::BIGINT AS total FROM fragments) SELECT change_id, seq, least(n, 12 - before) AS shown, total FROM r WHERE before < 12")
def diff_page(spark, d):
    """A change's hunks cut at 12 lines; the hunk that crosses the limit is clipped."""
    w = Window.partitionBy("change_id")
    rows = fragments(spark, d).withColumn("n", F.col("old_n") + F.col("new_n"))
    run = w.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"before": F.coalesce(F.sum("n").over(run), F.lit(0)), "total": F.sum("n").over(w)})
    return rows.where("before < 12").select("change_id", "seq", F.least("n", 12 - F.col("before")).alias("shown"), "total")


BYTES = "(SELECT change_id, sum(24 + 10 * (old_n + new_n))::BIGINT AS fb FROM fragments GROUP BY change_id)"
SIZES = f"{CHANGES}, {FRAGMENTS}, sz AS (SELECT change_id, time, (96 + length(path) + length(author) + length(coalesce(from_path, '')) + coalesce(fb, 0))::BIGINT AS size FROM changes LEFT JOIN {BYTES} USING (change_id))"


def sized(spark, d):
    held = fragments(spark, d).groupBy("change_id").agg(F.sum(24 + 10 * (F.col("old_n") + F.col("new_n"))).alias("fb"))
    rows = changes(spark, d).join(held, "change_id", "left")
    return rows.withColumn("size", H.change_size(F.coalesce("fb", F.lit(0))))


@query("prune_by_size", f"WITH {SIZES} SELECT change_id, size FROM (SELECT *, coalesce(sum(size) OVER (ORDER BY change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM sz) WHERE before < total - 1000000")
def prune_by_size(spark, d):
    """The oldest changes that must go so that at most a million bytes stay."""
    rows = sized(spark, d)
    total = rows.agg(F.sum("size").alias("total"))  # one row
    return H.cumulative(rows, "change_id", "size").crossJoin(total).where(F.col("before") < F.col("total") - 1_000_000).select("change_id", "size")


@query("prune_by_age", f"WITH {CHANGES} SELECT change_id FROM changes WHERE change_id <= (SELECT max(change_id) FROM changes WHERE time < TIMESTAMP '2024-01-16')")
def prune_by_age(spark, d):
    rows = changes(spark, d)
    cut = rows.where(F.col("time") < F.lit("2024-01-16").cast("timestamp_ntz")).agg(F.max("change_id").alias("cut"))  # one row
    return rows.crossJoin(cut).where("change_id <= cut").select("change_id")


@query("history_stats", f"WITH {SIZES} SELECT count(*) AS changes, sum(size)::BIGINT AS bytes, CASE WHEN count(*) >= 100 THEN round(sum(size)::DOUBLE * 1000 / count(*), 6) END AS bytes_per_1000 FROM sz")
def history_stats(spark, d):
    n = F.count("*")
    return sized(spark, d).agg(n.alias("changes"), F.sum("size").alias("bytes"), F.when(n >= 100, F.round(F.sum("size").cast("double") * 1000 / n, 6)).alias("bytes_per_1000"))


@query("assign_change_ids", f"WITH {CHANGES} SELECT change_id, (500 + row_number() OVER (ORDER BY time, change_id))::BIGINT AS seq FROM changes")
def assign_change_ids(spark, d):
    return H.numbered(changes(spark, d).select("change_id", "time"), 500, ["time", "change_id"]).select("change_id", "seq")


@query("changelog_sink", f"WITH {CHANGES}, a AS (SELECT path, op, change_id AS seq FROM changes WHERE change_id <= 1000), b AS (SELECT path, op, 1000 + row_number() OVER (ORDER BY time, change_id) AS seq FROM changes WHERE change_id > 1000) SELECT * FROM a UNION ALL SELECT * FROM b")
def changelog_sink(spark, d):
    """A batch appended to a stored log behind its largest number; the log is read back."""
    from ..sources.tables import overwrite_batch, work_path

    at, rows = work_path(spark, "changelog"), changes(spark, d)
    overwrite_batch(rows.where("change_id <= 1000").select("path", "op", F.col("change_id").alias("seq")), at, 0)
    last = spark.read.parquet(at).agg(F.max("seq")).first()[0] or 0
    fresh = H.numbered(rows.where("change_id > 1000").select("path", "op", "time", "change_id"), last, ["time", "change_id"])
    for _ in range(2):  # a repeated append replaces itself
        overwrite_batch(fresh.select("path", "op", "seq"), at, 1)
    return spark.read.parquet(at).select("path", "op", "seq")


@query("history_sink")
def history_sink(spark, d):
    """Changes with their fragments, written as partitions of a batch id; writing a batch again replaces it."""
    from ..sources.tables import overwrite_batch, work_path

    at = work_path(spark, "history")
    rows = changes(spark, d).join(fragments(spark, d).groupBy("change_id").agg(F.count("*").alias("fragments")), "change_id", "left")
    for batch in (1, 2, 2):
        overwrite_batch(rows.where(F.col("change_id") % 2 == batch % 2), at, batch)
    return spark.read.parquet(at).groupBy("batch_id").agg(F.count("*").alias("changes"), F.sum("fragments").alias("fragments"))


MV = "mv AS (SELECT DISTINCT 'docs/f' || l_partkey AS path, 'docs/f' || (l_partkey - l_partkey % 50 + l_suppkey % 50) AS from_path FROM lineitem)"


@query("move_closure", f"WITH RECURSIVE {MV}, e AS (SELECT path AS a, from_path AS b FROM mv UNION SELECT from_path, path FROM mv), r AS (SELECT 'docs/f1' AS path UNION SELECT e.b FROM r JOIN e ON r.path = e.a) SELECT path FROM r")
def move_closure(spark, d):
    f = lambda c: F.concat(F.lit("docs/f"), c.cast("string"))
    part = F.col("l_partkey")
    moves = table(spark, d, "lineitem").select(f(part).alias("path"), f(part - part % 50 + F.col("l_suppkey") % 50).alias("from_path"))
    return H.closure(spark.createDataFrame([("docs/f1",)], "path string"), moves)


ROUNDS = 24
LIVE = ", ".join(
    f"v{n} AS (SELECT change_id, undid, NOT EXISTS (SELECT 1 FROM v{n - 1} x WHERE x.undid = c.change_id AND x.live) AS live, coalesce((SELECT NOT x.undo FROM v{n - 1} x WHERE x.change_id = c.undid), false) AS undo FROM v0 c)"
    for n in range(1, ROUNDS)
)


@query(
    "undo_latest",
    f"WITH {CHANGES}, v0 AS (SELECT change_id, undid, true AS live, false AS undo FROM changes), {LIVE} SELECT author, max(change_id) AS change_id FROM changes JOIN v{ROUNDS - 1} USING (change_id) WHERE live AND NOT undo GROUP BY author"
)
def undo_latest(spark, d):
    return H.latest_undoable(changes(spark, d))


@query(
    "undo_plan_file",
    f"""WITH {CHANGES}, {FILES_V1}, f AS (SELECT DISTINCT 'docs/f' || (doc_id % 60) AS path FROM documents WHERE doc_id % 60 < 30), c AS (SELECT * FROM changes WHERE op IN ('create', 'remove', 'move'))
SELECT change_id, CASE op WHEN 'create' THEN CASE WHEN h THEN 'remove' ELSE 'conflict' END WHEN 'remove' THEN CASE WHEN h THEN 'conflict' ELSE 'restore' END
  ELSE CASE WHEN NOT h OR g THEN 'conflict' ELSE 'move_back' END END AS action
FROM (SELECT c.*, c.path IN (SELECT path FROM f) AS h, coalesce(c.from_path IN (SELECT path FROM f), false) AS g FROM c)""",
)
def undo_plan_file(spark, d):
    """Undo of creations, removals and moves against the files that exist now."""
    files = table(spark, d, "documents").where("doc_id % 60 < 30").select(F.concat(F.lit("docs/f"), (F.col("doc_id") % 60).cast("string")).alias("path")).distinct()
    here, there = files.withColumn("h", F.lit(True)), files.select(F.col("path").alias("from_path"), F.lit(True).alias("g"))
    rows = changes(spark, d).where("op in ('create', 'remove', 'move')").join(here, "path", "left").join(there, "from_path", "left")
    h, g = F.coalesce("h", F.lit(False)), F.coalesce("g", F.lit(False))
    action = (
        F.when(F.col("op") == "create", F.when(h, "remove").otherwise("conflict"))
        .when(F.col("op") == "remove", F.when(h, "conflict").otherwise("restore"))
        .otherwise(F.when(~h | g, "conflict").otherwise("move_back"))
    )
    return rows.select("change_id", action.alias("action"))


REQUESTS = f"""{FILES_V1}, rq AS (SELECT path, content, substr(sha256(content), 1, 6) AS version, (doc_id // 7) % 6 AS op, doc_id % 3 = 1 AS stale,
  CASE WHEN content = '' THEN [] ELSE (CASE WHEN ends_with(content, chr(10)) THEN string_split(content, chr(10))[1:len(string_split(content, chr(10)))-1] ELSE string_split(content, chr(10)) END) END AS l FROM files_v1 WHERE doc_id % 7 = 0)"""


@query(
    "apply_edits",
    f"""WITH {REQUESTS}, o AS (SELECT *, CASE WHEN stale THEN 'conflict' WHEN op IN (0, 2) AND len(l) < 2 THEN 'not_found' WHEN op = 1 AND len(l) < 1 THEN 'not_found' ELSE 'ok' END AS outcome FROM rq)
SELECT path, outcome, sha256(array_to_string(CASE WHEN outcome <> 'ok' THEN l WHEN op = 0 THEN list_concat(['edited'], l[3:]) WHEN op = 1 THEN list_concat(l[1:1], ['inserted'], l[2:])
  WHEN op = 2 THEN l[3:] WHEN op = 3 THEN list_concat(l, ['appended']) WHEN op = 4 THEN ['written'] ELSE [] END, chr(10))) AS hash, outcome = 'ok' AND op = 5 AS removed FROM o""",
)
def apply_edits(spark, d):
    files = files_v1(spark, d).select("path", "doc_id", T.content_version(F.col("content")).alias("version"), T.split_lines(F.col("content")).alias("lines"))
    k = (F.floor(F.col("doc_id") / 7) % 6).cast("int")
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), k + 1)
    requests = files.where("doc_id % 7 = 0").select(
        F.col("doc_id").alias("req_id"), "path", F.when(F.col("doc_id") % 3 == 1, "000000").otherwise(F.col("version")).alias("v"),
        pick("edit", "insert", "delete", "append", "write", "remove").alias("op"), F.lit(1).alias("start"), F.lit(2).alias("finish"),
        F.array(pick("edited", "inserted", "", "appended", "written", "")).alias("new"),
    )
    done = H.edit_lines(files.select("path", "version", "lines"), requests)
    return done.select("path", F.element_at("outcomes", 1).alias("outcome"), F.sha2(F.array_join("lines", "\n"), 256).alias("hash"), "removed")
