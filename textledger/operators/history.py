"""Versioned text: diffs, histories, range mapping, undo, retention."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import durable
from .carried import CARRIED, OWN, REF, carried

FRAGMENTS = "path string, seq int, pos int, old array<string>, new array<string>"
#: Most paths that are sent to all tasks at once.
MOST_SENT = 100_000


def middle(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """A place (i, j) halfway along a shortest edit of x to y, which differ at both ends: forward and backward search meet there.

    For each diagonal i - j the furthest place that so many edits reach is kept, all diagonals at once.
    """
    n, m = len(x), len(y)
    delta, none = n - m, -(1 << 40)
    zero = m + 1  # where diagonal 0 stands
    far = [np.full(n + m + 3, none), np.full(n + m + 3, none)]
    sides = (x, y), (x[::-1], y[::-1])
    for d in range((n + m + 1) // 2 + 1):
        k = np.arange(max(-d, -m + (m + d) % 2), min(d, n - (n + d) % 2) + 1, 2)
        for way, (a, b) in enumerate(sides):
            v, at = far[way], zero + k
            if d:
                right, down = v[at - 1], v[at + 1]
                i = np.maximum(np.where((right >= 0) & (right < n), right + 1, none), np.where((down >= 0) & (down - k <= m), down, none))
            else:
                i = np.zeros(1, np.int64)
            live = np.flatnonzero((i >= 0) & (i < n) & (i - k < m))
            while len(live := live[a[i[live]] == b[i[live] - k[live]]]):
                i[live] += 1
                live = live[(i[live] < n) & (i[live] - k[live] < m)]
            v[at] = i
            if (delta % 2 == 1) == (way == 0):
                other = zero + delta - k
                inside = (other >= 0) & (other < len(v))
                back = np.where(inside, far[1 - way][np.clip(other, 0, len(v) - 1)], none)
                met = np.flatnonzero((i >= 0) & (back >= 0) & (i + back >= n))
                if len(met):
                    p, q = int(i[met[0]]), int(i[met[0]] - k[met[0]])
                    return (p, q) if way == 0 else (n - p, m - q)
    raise AssertionError("the searches meet")


def matched(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (i, j, length) of equal lines that a shortest edit of x to y keeps, in order; memory grows with the lines, not with the edits."""
    out, work = [], [(0, len(x), 0, len(y))]
    while work:
        a, b, c, d = work.pop()
        n = min(b - a, d - c)
        unequal = np.flatnonzero(x[a : a + n] != y[c : c + n])
        head = int(unequal[0]) if len(unequal) else n
        if head:
            out.append((a, c, head))
        a, c = a + head, c + head
        n = min(b - a, d - c)
        unequal = np.flatnonzero(x[b - n : b][::-1] != y[d - n : d][::-1])
        tail = int(unequal[0]) if len(unequal) else n
        if tail:
            out.append((b - tail, d - tail, tail))
        b, d = b - tail, d - tail
        if a < b and c < d:
            i, j = middle(x[a:b], y[c:d])
            work += [(a, a + i, c, c + j), (a + i, b, c + j, d)]
    return sorted(out)


def line_fragments(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Maximal differing stretches (start, end, other start, other end) of a shortest edit of a to b.

    Lines are numbers; those that only one side has are in no match and are left out of the search.
    """
    number: dict[str, int] = {}
    x, y = (np.fromiter((number.setdefault(line, len(number)) for line in v), np.int64, len(v)) for v in (a, b))
    in_x, in_y = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    out, at, to = [], 0, 0
    kept = [(int(in_x[i + k]), int(in_y[j + k])) for i, j, n in matched(x[in_x], y[in_y]) for k in range(n)] if len(in_x) else []
    for i, j in [*kept, (len(a), len(b))]:
        if i > at or j > to:
            out.append((at, i, to, j))
        at, to = i + 1, j + 1
    return out


def line_diff(pairs: DataFrame) -> DataFrame:
    """Fragments of every pair of versions (path, old, new arrays of lines) that differ."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, old, new in zip(f["path"], f["old"], f["new"], strict=True):
                old, new = list(old), list(new)
                for n, (a, b, c, d) in enumerate(line_fragments(old, new)):
                    rows.append((path, n + 1, a, old[a:b], new[c:d]))
            yield pd.DataFrame(rows, columns=["path", "seq", "pos", "old", "new"])

    return pairs.select("path", "old", "new").mapInPandas(run, FRAGMENTS)


def shifts(fragments: DataFrame, key: str = "change_id") -> DataFrame:
    """Fragments (key, seq, pos, old_n, new_n) with shift: how far earlier fragments move theirs."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return fragments.withColumn("shift", F.coalesce(F.sum(F.col("new_n") - F.col("old_n")).over(w), F.lit(0)))


def after_ranges(fragments: DataFrame, key: str = "change_id") -> DataFrame:
    """Each fragment's lines in the new version, 1-based inclusive; end is start - 1 for a deletion."""
    start = F.col("pos") + F.col("shift") + 1
    return shifts(fragments, key).select(key, "seq", start.alias("range_start"), (start + F.col("new_n") - 1).alias("range_end"))


def reversed_fragments(fragments: DataFrame, key: str = "change_id") -> DataFrame:
    """Fragments that undo fragments."""
    rest = [c for c in ("old", "new") if c in fragments.columns]
    swap = {"old": "new", "new": "old"}
    return shifts(fragments, key).select(
        key, "seq", (F.col("pos") + F.col("shift")).alias("pos"), F.col("new_n").alias("old_n"), F.col("old_n").alias("new_n"),
        *[F.col(swap[c]).alias(c) for c in rest],
    )


def apply_fragments(lines: DataFrame, fragments: DataFrame) -> DataFrame:
    """(path, line_no, text, mismatch): lines (path, line_no, text) after fragments (path, seq, pos, old, new).

    Replaced lines are taken out by an equi-join on exploded positions, new lines are put in by
    (position, 0/1, k) order. mismatch: a replaced line isn't the one expected.
    """
    old = fragments.select("path", (F.col("pos") + 1).alias("pos"), F.posexplode("old").alias("k", "expected")).select("path", (F.col("pos") + F.col("k")).alias("line_no"), "expected")
    joined = lines.join(old, ["path", "line_no"], "left")
    bad = joined.where("expected is not null and expected <> text").select("path").distinct().withColumn("mismatch", F.lit(True))
    kept = joined.where("expected is null").select("path", F.col("line_no").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("k"), "text")
    new = fragments.select("path", (F.col("pos") + 1).alias("at"), F.lit(0).alias("kind"), F.posexplode("new").alias("k", "text"))
    order = Window.partitionBy("path").orderBy("at", "kind", "k")
    rows = kept.unionByName(new).withColumn("line_no", F.row_number().over(order))
    return rows.join(bad, "path", "left").select("path", "line_no", "text", F.coalesce("mismatch", F.lit(False)).alias("mismatch"))


def map_hop(ranges: DataFrame, fragments: DataFrame, key: str = "change_id") -> DataFrame:
    """Ranges (ref_id, key, lo, hi), half open from 0, carried through one change: (ref_id, lo, hi, hit, by).

    Each bound moves by the fragments before it; one that lies in a replaced stretch goes to its edge.
    by: the numbers of the fragments that hit the range.
    """
    f = shifts(fragments, key)
    p, o, n, lo, hi = (F.col(c) for c in ("pos", "old_n", "new_n", "lo", "hi"))
    d = n - o
    empty = lo == hi
    hit = F.when(empty, ((o > 0) & (p < lo) & (lo < p + o)) | ((o == 0) & (p == lo))).otherwise(
        ((o > 0) & (p < hi) & (p + o > lo)) | ((o == 0) & (lo < p) & (p < hi))
    )
    add_lo = F.when((p + o <= lo) & ((o > 0) | (p <= lo)), d).otherwise(0)
    add_hi = F.when((p + o <= hi) & ((o > 0) | (p < hi)), d).otherwise(0)
    in_lo = F.when((p < lo) & (lo < p + o), p + F.col("shift"))
    in_hi = F.when((p < hi) & (hi < p + o), p + F.col("shift") + n)
    rows = ranges.join(f, key, "left").groupBy("ref_id", "lo", "hi").agg(
        F.coalesce(F.max(hit), F.lit(False)).alias("hit"), F.array_sort(F.collect_set(F.when(hit, F.col("seq")))).alias("by"), F.coalesce(F.sum(add_lo), F.lit(0)).alias("a"),
        F.coalesce(F.sum(add_hi), F.lit(0)).alias("b"), F.max(in_lo).alias("x"), F.max(in_hi).alias("y"),
    )
    new_lo = F.coalesce("x", F.col("lo") + F.col("a"))
    return rows.select("ref_id", new_lo.alias("lo"), F.when(empty, new_lo).otherwise(F.coalesce("y", F.col("hi") + F.col("b"))).alias("hi"), "hit", "by")


def hop(fragments: list[tuple[int, int, int]], lo: int, hi: int) -> tuple[int, int, bool]:
    """map_hop for one range and the fragments (pos, old_n, new_n) of one change."""
    shift, hit, new_lo, new_hi, x, y = 0, False, lo, hi, None, None
    for p, o, n in fragments:
        if lo == hi:
            hit |= (o > 0 and p < lo < p + o) or (o == 0 and p == lo)
        else:
            hit |= (o > 0 and p < hi and p + o > lo) or (o == 0 and lo < p < hi)
        if p + o <= lo and (o > 0 or p <= lo):
            new_lo += n - o
        if p + o <= hi and (o > 0 or p < hi):
            new_hi += n - o
        if p < lo < p + o:
            x = p + shift
        if p < hi < p + o:
            y = p + shift + n
        shift += n - o
    new_lo = new_lo if x is None else x
    return new_lo, new_lo if lo == hi else (new_hi if y is None else y), hit


REFS_IN_TASK = 1 << 18
#: References that a task carries at a time, and of a group of small paths.
REFS_AT_ONCE = 1 << 14


def map_ranges(refs: DataFrame, fragments: DataFrame) -> DataFrame:
    """refs (ref_id, path, since, lo, hi) carried through all later changes of their path, in order.

    fragments (path, change_id, seq, pos, old_n, new_n). A path's refs are dealt over as many parts as
    hold REFS_IN_TASK each, and its fragments go to every part. Paths are numbered and put together to as many
    groups as there are tasks, or more of some REFS_AT_ONCE references. A part is read in blocks of changes, in order, and holds only its refs that have
    begun, so neither a path with most refs nor one with most changes is one group in memory (see carried).
    """
    n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = refs.groupBy("path").agg(F.count("*").alias("n"), F.ceil(F.count("*") / REFS_IN_TASK).cast("int").alias("parts"))
    parts = durable(parts.withColumn("segment", F.monotonically_increasing_id()))
    n = max(n, (parts.agg(F.sum("n")).first()[0] or 0) // REFS_AT_ONCE)
    parts = parts.drop("n")
    part = F.pmod(F.xxhash64("ref_id"), F.col("parts")).cast("int").alias("part")
    long = lambda c, name: F.col(c).cast("long").alias(name)
    zero = lambda *names: [F.lit(0).cast("long").alias(c) for c in names]
    root = F.pmod(F.xxhash64("segment"), F.lit(n)).cast("string").alias("root")
    mine = refs.join(parts, "path").select(root, part, long("since", "at"), F.lit(REF).alias("kind"), "segment", *zero("pos", "old_n", "new_n"), "ref_id", long("lo", "lo"), long("hi", "hi"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    moves = fragments.join(parts, "path").select(root, every, long("change_id", "at"), F.lit(OWN).alias("kind"), "segment", *[long(c, c) for c in ("pos", "old_n", "new_n")], F.lit("").alias("ref_id"), *zero("lo", "hi"))
    # A change moves the refs that began before it, so it stands ahead of those that begin with it.
    rows = moves.unionByName(mine).repartition("root", "part").sortWithinPartitions("root", "part", "at", "kind", "segment", "pos")
    return rows.mapInArrow(lambda batches: carried(batches, REFS_AT_ONCE), CARRIED).select("ref_id", "lo", "hi", F.col("overlaps").alias("touched"))


def undo_plan(fragments: DataFrame, later: DataFrame, key: str = "path") -> DataFrame:
    """Where an undo of fragments (key, seq, pos, old, new) would write, after the later ones: (key, seq, lo, hi, status, by).

    lo..hi are the lines that the change made, where they stand now. Lines that a later change touched
    are a conflict, and by names its fragments.
    """
    counts = lambda f: f.withColumns({"old_n": F.size("old"), "new_n": F.size("new")}).select(key, "seq", "pos", "old_n", "new_n")
    made = shifts(counts(fragments), key).select(key, "seq", (F.col("pos") + F.col("shift")).alias("lo"), (F.col("pos") + F.col("shift") + F.col("new_n")).alias("hi"))
    ranges = made.select(F.struct(key, "seq").alias("ref_id"), key, "lo", "hi")
    moved = map_hop(ranges, counts(later), key)
    status = F.when(F.col("hit"), "conflict").otherwise("ok")
    return moved.select(f"ref_id.{key}", "ref_id.seq", "lo", "hi", status.alias("status"), "by")


def undo_fragments(plan: DataFrame, fragments: DataFrame, key: str = "path") -> DataFrame:
    """The fragments (key, seq, pos, old, new) that carry out an undo plan, of files without a conflict."""
    clean = plan.groupBy(key).agg(F.max(F.col("status") == "conflict").alias("bad")).where("not bad").select(key)
    rows = plan.join(clean, key).join(fragments.select(key, "seq", "old", "new"), [key, "seq"])
    return rows.select(key, "seq", F.col("lo").cast("int").alias("pos"), F.col("new").alias("old"), F.col("old").alias("new"))


#: Most hashes of paths that are sent to all tasks to pick the files that changes touch: some 64 MB.
MOST_PICKED = 2_000_000


def picked(files: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (path, ...) that may be among paths (path), and the others; no content is shuffled for that if the paths are few."""
    keys = durable(paths.select(F.xxhash64("path").alias("key")).distinct())
    if keys.limit(MOST_PICKED + 1).count() > MOST_PICKED:
        return files, files.limit(0)
    keys, key = F.broadcast(keys), F.xxhash64("path") == F.col("key")
    return files.join(keys, key, "left_semi"), files.join(keys, key, "left_anti")


def replaced(lines: Column, spots: Column) -> tuple[Column, Column]:
    """lines after spots, an array of (seq, pos, old, new) in order or null, and whether the lines that they replace aren't those expected."""
    end = lambda f: F.coalesce(f["pos"] + F.size(f["old"]), F.lit(0))
    between = lambda first, to: F.slice(lines, first + 1, F.greatest(to - first, F.lit(0)))
    piece = lambda f, i: F.concat(between(F.when(i > 0, end(F.get(spots, i - 1))).otherwise(F.lit(0)), f["pos"]), f["new"])
    after = F.concat(F.flatten(F.transform(spots, piece)), between(end(F.get(spots, F.size(spots) - 1)), F.size(lines)))
    wrong = F.exists(spots, lambda f: between(f["pos"], f["pos"] + F.size(f["old"])) != f["old"])
    return F.coalesce(after, lines), F.coalesce(wrong, F.lit(False))


def reconstruct(files: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Files (path, lines) taken back through changes, newest first: (path, lines, mismatch).

    A step is fragments (path, seq, pos, old, new), which are reversed, or moves (path, from_path).
    mismatch: lines that a step replaced aren't those that it had made, so the chain is broken there.

    All steps of a file are brought together under its name now, so a file is a row that is shuffled once, and only if
    a step touches it.
    """
    plan, moves, moved = None, [], []

    def named_now(rows: DataFrame) -> DataFrame:
        for m in reversed(moves):
            rows = rows.join(m.select(F.col("from_path").alias("path"), F.col("path").alias("later")), "path", "left").withColumn("path", F.coalesce("later", "path")).drop("later")
        return rows

    columns = []
    for k, step in enumerate(steps):
        if "from_path" in step.columns:
            step = durable(step.select("path", "from_path"))
            moved.append(named_now(step.select("path")))
            moves.append(step)
            continue
        frags = named_now(step.select("path", "seq", "pos", "old", "new")).withColumns({"old_n": F.size("old"), "new_n": F.size("new")})
        spot = F.struct("seq", F.col("pos").cast("int").alias("pos"), "old", "new")
        spots = reversed_fragments(frags, "path").groupBy("path").agg(F.array_sort(F.collect_list(spot)).alias(f"spots{k}"))
        columns.append(f"spots{k}")
        plan = spots if plan is None else plan.join(spots, "path", "full_outer")
    if plan is None and not moved:
        return files.withColumn("mismatch", F.lit(False))
    for m in moved:
        plan = m.distinct() if plan is None else plan.join(m.distinct(), "path", "full_outer")
    plan = plan.withColumn("was", F.col("path"))
    for m in moves:
        plan = plan.join(m.select(F.col("path").alias("was"), "from_path"), "was", "left").withColumn("was", F.coalesce("from_path", "was")).drop("from_path")
    plan = durable(plan)
    mine, others = picked(files, plan.select("path"))
    rows = mine.join(plan, "path", "full_outer").withColumns({"lines": F.coalesce("lines", F.array().cast("array<string>")), "mismatch": F.lit(False)})
    for c in columns:
        lines, wrong = replaced(F.col("lines"), F.col(c))
        rows = rows.withColumn("mismatch", F.col("mismatch") | wrong).withColumn("lines", lines).drop(c)
    return rows.select(F.coalesce("was", "path").alias("path"), "lines", "mismatch").unionByName(others.select("path", "lines", F.lit(False).alias("mismatch")))


def as_of(versions: DataFrame, change_id: int) -> DataFrame:
    """(path, change_id, content) right after a change; versions (path, change_id, content), null content: removed."""
    last = versions.where(F.col("change_id") <= change_id).groupBy("path").agg(F.max(F.struct("change_id", "content")).alias("v"))
    return last.select("path", "v.change_id", "v.content")


def restore(versions: DataFrame, change_id: int) -> DataFrame:
    """(path, action): what brings the files changed since back: rewrite, create, remove or keep."""
    changed = versions.where(F.col("change_id") > change_id).select("path").distinct()
    now = versions.groupBy("path").agg(F.max(F.struct("change_id", "content")).alias("n")).select("path", F.col("n.content").alias("now"))
    rows = changed.join(now, "path").join(as_of(versions, change_id).select("path", F.col("content").alias("then")), "path", "left")
    action = F.when(F.col("then").eqNullSafe(F.col("now")), "keep").when(F.col("then").isNull(), "remove").when(F.col("now").isNull(), "create").otherwise("rewrite")
    return rows.select("path", action.alias("action"))


def closure(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """paths (path) and all that moves (path, from_path) connect them with, by widening until nothing is added.

    The moves are made distinct once and kept; a round looks only for the neighbours of what the last one added.
    """
    links = durable(moves.select(F.col("path").alias("a"), F.col("from_path").alias("b")).distinct())
    both = links.union(links.select("b", "a"))
    seen = added = durable(paths.select("path").distinct())
    while n := added.count():
        near = F.broadcast(added) if n <= MOST_SENT else added
        more = both.join(near, near["path"] == both["a"]).select(F.col("b").alias("path")).distinct()
        added = durable(more.join(seen, "path", "left_anti"))
        seen = durable(seen.union(added))
    return seen


def latest_undoable(changes: DataFrame) -> DataFrame:
    """Per author the newest change in effect that undo would take: (author, change_id).

    changes (change_id, author, op, undid). A change is out of effect if a rollback of it is in
    effect. A rollback of an ordinary change is an undo, which is passed over; a rollback of an undo is
    a redo, an ordinary change again. Both follow the chains of rollbacks, round by round.
    """
    links = durable(changes.where("op = 'rollback' and undid is not null").select("change_id", "undid"))
    flags = links.select("change_id").union(links.select(F.col("undid").alias("change_id"))).distinct()
    flags = durable(flags.withColumns({"live": F.lit(True), "undo": F.lit(False)}))
    while True:
        up = links.join(flags.where("live").select("change_id"), "change_id", "left_semi").select(F.col("undid").alias("change_id")).distinct().withColumn("hit", F.lit(True))
        target = links.join(flags.select(F.col("change_id").alias("undid"), F.col("undo").alias("of_undo")), "undid").select("change_id", (~F.col("of_undo")).alias("is_undo"))
        new = flags.join(up, "change_id", "left").join(target, "change_id", "left")
        new = durable(new.select(
            "change_id", F.col("hit").isNull().alias("live"), F.coalesce("is_undo", F.lit(False)).alias("undo"),
            ((F.col("hit").isNull() != F.col("live")) | (F.coalesce("is_undo", F.lit(False)) != F.col("undo"))).alias("moved"),
        ))
        flags = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    rows = changes.join(flags, "change_id", "left").where("coalesce(live, true) and not coalesce(undo, false)")
    return rows.groupBy("author").agg(F.max("change_id").alias("change_id"))


def cumulative(rows: DataFrame, key: str, size: str, parts: int = 4096) -> DataFrame:
    """rows with before: the sum of size over all smaller keys, from sums of `parts` equal ranges of keys and sums inside each."""
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    if ends.low is None:
        return rows.withColumn("before", F.lit(0).cast("long"))
    part = F.floor((F.col(key) - ends.low) / max(1, -(-(ends.high - ends.low + 1) // parts)))
    sums = rows.groupBy(part.alias("part")).agg(F.sum(size).alias("n"))
    sums = sums.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("part", part).join(sums.select("part", "start"), "part")
    return joined.withColumn("before", F.col("start") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("part", "start")


def change_size(fragments_bytes: Column) -> Column:
    """Logical bytes of a change: 96, its texts, and what its fragments hold."""
    texts = [F.length(F.coalesce(c, F.lit(""))) for c in ("path", "author", "from_path")]
    return F.lit(96) + texts[0] + texts[1] + texts[2] + fragments_bytes


def numbered(rows: DataFrame, start: int, order: list[str]) -> DataFrame:
    """rows with seq, dense from start + 1 in the given order.

    Counts of range partitions give each partition's offset, so nothing is ordered in one task.
    """
    sorted_ = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = sorted_.withColumn("_i", inside).join(counts.select("_part", "_start"), "_part")
    return out.withColumn("seq", F.lit(start) + F.col("_start") + F.col("_i")).drop("_part", "_i", "_start")


def edit_lines(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Applies batches of edit requests: (path, outcomes, lines, removed).

    files (path, version, lines), requests (req_id, path, v, op, start, finish, new). A path's
    requests are folded in order of req_id; each must name the version it is based on, the current one
    or, behind an earlier request of the batch, the one before the batch. Ops: edit, insert (behind line
    start, 0 for the top), delete, append, write, remove, and replace, which puts new for the lines `old`
    wherever they stand. Outcomes: ok, conflict, not_found, ambiguous.
    """
    if "old" not in requests.columns:
        requests = requests.withColumn("old", F.array().cast("array<string>"))
    mine = requests.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("req_id", "v", "op", "start", "finish", "new", "old"))).alias("reqs"))
    rows = mine.join(files, "path", "left").withColumn("there", F.col("lines").isNotNull())
    rows = rows.withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    first = F.struct(F.col("lines").alias("lines"), F.col("there").alias("there"), F.array().cast("array<string>").alias("outcomes"))

    def step(acc: Column, r: Column) -> Column:
        n = F.size(acc["lines"])
        behind = lambda at: F.slice(acc["lines"], at + 1, F.greatest(n - at, F.lit(0)))
        ahead = lambda at: F.slice(acc["lines"], F.lit(1), at)
        ranged = r["op"].isin("edit", "delete")
        block = F.size(r["old"])
        spots = F.when(
            (r["op"] == "replace") & (block > 0) & (block <= n),
            F.filter(F.sequence(F.lit(1), F.greatest(n - block + 1, F.lit(1))), lambda i: F.slice(acc["lines"], i, block) == r["old"]),
        ).otherwise(F.array().cast("array<int>"))
        outcome = (
            F.when(~acc["there"] & (r["op"] != "write"), "not_found")
            .when(acc["there"] & ~r["v"].eqNullSafe(F.col("version")), "conflict")
            .when(~acc["there"] & r["v"].isNotNull(), "conflict")
            .when((ranged & (r["finish"] > n)) | ((r["op"] == "insert") & (r["start"] > n)), "not_found")
            .when((r["op"] == "replace") & (F.size(spots) == 0), "not_found")
            .when((r["op"] == "replace") & (F.size(spots) > 1), "ambiguous")
            .otherwise("ok")
        )
        ok = outcome == "ok"
        lines = (
            F.when(~ok | (r["op"] == "remove"), F.when(ok, F.array().cast("array<string>")).otherwise(acc["lines"]))
            .when(r["op"] == "write", r["new"])
            .when(r["op"] == "append", F.concat(acc["lines"], r["new"]))
            .when(r["op"] == "insert", F.concat(ahead(r["start"]), r["new"], behind(r["start"])))
            .when(r["op"] == "replace", F.concat(ahead(F.get(spots, F.lit(0)) - 1), r["new"], behind(F.get(spots, F.lit(0)) + block - 1)))
            .when(r["op"] == "delete", F.concat(ahead(r["start"] - 1), behind(r["finish"])))
            .otherwise(F.concat(ahead(r["start"] - 1), r["new"], behind(r["finish"])))
        )
        there = F.when(ok, r["op"] != "remove").otherwise(acc["there"])
        return F.struct(lines.alias("lines"), there.alias("there"), F.concat(acc["outcomes"], F.array(outcome)).alias("outcomes"))

    done = rows.withColumn("done", F.aggregate("reqs", first, step))
    return done.select("path", F.col("done.outcomes").alias("outcomes"), F.col("done.lines").alias("lines"), (~F.col("done.there")).alias("removed"))
