"""Properties of what SQL doesn't express: diffs, range mapping, regex literals, streams."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textledger.functions import globs, literals, registered
from textledger.functions import text as T
from textledger.operators import history as H
from textledger.operators import metrics as M
from textledger.plans import fixtures, history, snapshots, streams
from textledger.plans.fixtures import fragments

SF = "/root/testdata/sf0.001"
LINES = st.lists(st.sampled_from("abcd"), max_size=14)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(LINES, LINES)
def test_line_fragments_apply_and_are_shortest(a, b):
    out, at, size = [], 0, 0
    last = None
    for s, e, u, v in H.line_fragments(a, b):
        out += a[at:s] + b[u:v]
        at, size = e, size + e - s + v - u
        assert last is None or s > last
        last = e
    assert out + a[at:] == b
    assert size == len(a) + len(b) - 2 * common(a, b)


def test_reconstruction_is_exact(spark):
    assert history.reconstruct_version(spark, SF).where("not same").count() == 0


def test_map_ranges_equals_repeated_hops(spark):
    mapped = {r.ref_id: (r.lo, r.hi, r.touched) for r in history.map_range(spark, SF).collect()}
    frags = {}
    for r in fragments(spark, SF).orderBy("change_id", "seq").collect():
        frags.setdefault(r.change_id, []).append((r.pos, r.old_n, r.new_n))
    for r in history.hop_refs(spark, SF).collect():
        lo, hi, touched = r.lo, r.hi, []
        for c in sorted(x for x in frags if x % 500 == r.change_id % 500 and x > r.change_id):
            lo, hi, hit = H.hop(frags[c], lo, hi)
            touched += [c] * hit
        assert mapped[r.ref_id] == (lo, hi, touched)


def texts(spark, files):
    return {r.path: r.lines for r in files(spark, SF).select("path", T.split_lines(F.col("content")).alias("lines")).collect()}


def test_undo_against_later_changes(spark):
    """The plan against diffs line by line: what an undo would write over, and which later fragments are in the way."""
    v1, v2, v3 = (texts(spark, f) for f in (fixtures.files_v1, fixtures.files_v2, fixtures.files_v3))
    plan = {(r.path, r.seq): r for r in history.undo_plan(spark, SF).collect()}
    want = set()
    for path in v1.keys() & v2.keys():
        first = H.line_fragments(v1[path], v2[path])
        later = H.line_fragments(v2[path], v3[path])
        frags = [(s, e - s, v - u) for s, e, u, v in later]
        for n, (_, _, lo, hi) in enumerate(first, 1):
            want.add((path, n))
            r = plan[path, n]
            at, end, hit = H.hop(frags, lo, hi)
            by = [k for k, f in enumerate(frags, 1) if H.hop([f], lo, hi)[2]]
            assert (r.lo, r.hi, r.status == "conflict", r.by) == (at, end, hit, by)
            if not hit:
                assert v3[path][r.lo : r.hi] == v2[path][lo:hi]
    assert set(plan) == want and {r.status for r in plan.values()} == {"ok", "conflict"}


def test_undo_preview_gives_the_version(spark):
    v1, v2, v3 = (texts(spark, f) for f in (fixtures.files_v1, fixtures.files_v2, fixtures.files_v3))
    rows = history.undo_preview(spark, SF).collect()
    untouched = {r.path for r in rows if v3[r.path] == v2[r.path]}
    assert untouched
    import hashlib

    for r in rows:
        if r.path in untouched:
            assert r.version == hashlib.sha256("\n".join(v1[r.path]).encode()).hexdigest()[:6]


def test_version_check(spark):
    v1, v2 = (texts(spark, f) for f in (fixtures.files_v1, fixtures.files_v2))
    verdicts = set()
    for r in history.version_check(spark, SF).collect():
        path, line = r.ref_id.rsplit("#", 1)
        lo, hi = int(line) - 1, int(line) + (3 if int(line) % 20 == 0 else 0)
        verdicts.add(r.verdict)
        if path not in v2:
            assert r.verdict == "gone"
        elif v1[path] == v2[path]:
            assert r.verdict == "current" and (r.start_line, r.finish_line) == (lo + 1, hi)
        else:
            at, end, hit = H.hop([(s, e - s, v - u) for s, e, u, v in H.line_fragments(v1[path], v2[path])], lo, hi)
            assert r.verdict == ("conflict" if hit else "mapped")
            assert hit or ((r.start_line, r.finish_line) == (at + 1, end) and v2[path][at:end] == v1[path][lo:hi])
    assert verdicts == {"gone", "current", "mapped", "conflict"}


def test_hot_paths_map_the_same(spark, monkeypatch):
    """A path whose references are dealt over many tasks."""
    monkeypatch.setattr(H, "REFS_IN_TASK", 3)
    rng = random.Random(1)
    frags, byc = [], {}
    for c in range(1, 60):
        pos = 0
        for seq in range(rng.randrange(1, 5)):
            pos += rng.randrange(1, 9)
            old, new = rng.randrange(0, 3), rng.randrange(0, 3)
            if old or new:
                frags.append(("p" if c % 4 else "q", c, seq, pos, old, new))
                byc.setdefault(("p" if c % 4 else "q", c), []).append((pos, old, new))
            pos += old + 1
    refs = [(f"r{i}", rng.choice("pq"), rng.randrange(0, 60), lo := rng.randrange(0, 40), lo + rng.choice([0, 1, 5])) for i in range(200)]
    got = {r.ref_id: (r.lo, r.hi, r.touched) for r in H.map_ranges(
        spark.createDataFrame(refs, "ref_id string, path string, since long, lo long, hi long"),
        spark.createDataFrame(frags, "path string, change_id long, seq long, pos long, old_n long, new_n long"),
    ).collect()}
    for i, path, since, lo, hi in refs:
        touched = []
        for c in range(since + 1, 60):
            if (path, c) in byc:
                lo, hi, hit = H.hop(byc[path, c], lo, hi)
                touched += [c] * hit
        assert got[i] == (lo, hi, touched)


def batches_of(times, quiet, most):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= quiet and t - out[-1][0] <= most:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


def test_stream_debounce_closes_by_timer(spark):
    """Every batch whose quiet time is over before the newest event comes out, once, whatever turn it began in."""
    quiet, most = 600_000_000, 1_800_000_000
    rows = spark.read.parquet(f"{SF}/events.parquet").select((F.col("user_id") % 50).alias("s"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()
    newest, want, open_ = max(r.us for r in rows), set(), set()
    for s in {r.s for r in rows}:
        for b in batches_of([r.us for r in rows if r.s == s], quiet, most):
            (want if b[1] + quiet + 1000 < newest else open_).add((s, *b))
    got = [(r.stream, r.first_us, r.last_us, r.n) for r in streams.stream_debounce(spark, SF).collect()]
    assert len(got) == len(set(got)) and want <= set(got) <= want | open_


def test_stream_windows_are_closed_days(spark):
    got = {(r.window_start.date().isoformat(), r.command, r.bucket): (r.n, r.total_us) for r in streams.stream_metrics_windows(spark, SF).collect()}
    rows = fixtures.calls(spark, SF).withColumn("bucket", M.bucket(F.col("duration_us"))).groupBy(F.to_date("ts").alias("day"), "command", "bucket").agg(F.count("*").alias("n"), F.sum("duration_us").alias("t"))
    want = {(r.day.isoformat(), r.command, r.bucket): (r.n, r.t) for r in rows.collect()}
    last = max(k[0] for k in want)
    assert got and got == {k: v for k, v in want.items() if k[0] < last}


def test_history_sink_replaces_batches(spark):
    rows = {r.batch_id: r.changes for r in history.history_sink(spark, SF).collect()}
    n = fixtures.changes(spark, SF).count()
    assert set(rows) == {1, 2} and sum(rows.values()) == n


def test_regex_literals():
    assert literals.required("abc.*def") == [frozenset({"abc", "def"})]
    assert literals.required("(abc|def)g") == [frozenset({"abcg"}), frozenset({"defg"})]
    assert literals.required("a.c.e") is None
    assert literals.required("x*") is None
    assert literals.required("(?:abc)?") is None
    assert literals.required("ab+c") is None
    for pattern in ("foo[ab]r?z", "(one|two) three", "(?:ab)+cde", "x{2,}yzw"):
        for text in ("fooarz fooaz", "two three", "ababcde", "xxxyzw"):
            if re.search(pattern, text):
                need = literals.required(pattern)
                assert need is None or any(all(w in text for w in clause) for clause in need)


def test_regex_literals_keep_every_alternative():
    words = [f"word{k:03d}" for k in range(300)]
    groups = [[f"{g}{k:02d}x" for k in range(16)] for g in "abc"]
    for pattern, texts in (
        (f"({'|'.join(words)}) foo", [f"{w} foo" for w in words]),
        (f"foo ({'|'.join(w[4:] + 'zz' for w in words)})", [f"foo {w[4:]}zz" for w in words]),
        (f"({'|'.join(words)}).*({'|'.join(words)})", [f"{w} {v}" for w, v in zip(words, reversed(words))]),
        (".*".join(f"({'|'.join(g)})" for g in groups), [f"{x} {y} {z}" for x in groups[0] for y in groups[1] for z in groups[2]]),
    ):
        need = literals.required(pattern)
        for text in texts:
            assert re.search(pattern, text) and (need is None or any(all(w in text for w in clause) for clause in need))


def test_globs():
    yes = [("a/*/c.txt", "a/b/c.txt"), ("*.txt", "x/y/z.txt"), ("a/**/z", "a/z"), ("a/**/z", "a/b/c/z"), ("src", "src/main.py"), ("[ab]?", "x/bz")]
    no = [("a/*/c.txt", "a/b/d/c.txt"), ("/x/*.txt", "y/x/a.txt"), ("[!ab]", "a"), ("a/**/z", "b/z")]
    assert all(re.search(globs.path_regex(g), p) for g, p in yes)
    assert not any(re.search(globs.path_regex(g), p) for g, p in no)


def test_split_and_join_round_trip(spark):
    texts = ["", "\n", "a", "a\n", "a\r\nb\r\n", "a\r\nb\nc", "﻿x\ny", "a\r", "\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("l", T.split_lines(F.col("t")))
    got = {r.t: r.l for r in rows.collect()}
    assert got[""] == [] and got["\n"] == [""] and got["a\r"] == ["a\r"] and got["a\r\nb\nc"] == ["a", "b", "c"] and got["\n\n"] == ["", ""]
    joined = rows.withColumn("j", T.join_lines(F.col("l"), T.line_format(F.col("t")))).where("t <> 'a\\r\\nb\\nc'")
    assert joined.where("j <> t").count() == 0


def test_streams_equal_batch(spark):
    batch = {r.path for r in snapshots.changes(spark, SF).where("op <> 'unchanged'").collect()}
    for f in (streams.stream_sync, streams.stream_bulk_escalation, streams.stream_late):
        assert {r.path for r in f(spark, SF).collect()} == batch


def test_registered_functions(spark):
    registered.register(spark)
    texts = ["", "fooBar HTTPServer2 x", "Ünïcode wordÄbc don't", "line\nnext"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, f in (("words_text", T.words_text), ("word_tokens", T.word_tokens), ("content_version", T.content_version), ("trigrams", T.trigrams)):
        assert [r[0] for r in rows.select(f(F.col("t"))).collect()] == [r[0] for r in rows.selectExpr(f"{name}(t)").collect()]


def test_block_edits(spark):
    files = spark.createDataFrame([("a", "v1", ["1", "x", "y", "2", "x", "z"])], "path string, version string, lines array<string>")
    requests = spark.createDataFrame(
        [(1, "a", "v1", "replace", 1, 1, ["new"], ["x", "y"]), (2, "a", "v1", "insert", 0, 0, ["top"], []), (3, "a", "v1", "replace", 1, 1, ["n"], ["q"]),
         (4, "a", "v1", "append", 1, 1, ["x", "z"], []), (5, "a", "v1", "replace", 1, 1, ["n"], ["x", "z"]), (6, "a", "v1", "replace", 1, 1, ["n"], [])],
        "req_id long, path string, v string, op string, start int, finish int, new array<string>, old array<string>",
    )
    got = H.edit_lines(files, requests).collect()[0]
    assert got.outcomes == ["ok", "ok", "not_found", "ok", "ambiguous", "not_found"]
    assert got.lines == ["top", "1", "new", "2", "x", "z", "x", "z"]


def test_several_edits_on_one_path(spark):
    files = spark.createDataFrame([("a", "v1", ["1", "2", "3"]), ("b", "v1", ["x"])], "path string, version string, lines array<string>")
    requests = spark.createDataFrame(
        [(1, "a", "v1", "insert", 1, 1, ["new"]), (2, "a", "v1", "delete", 3, 4, [""]), (3, "a", "old", "append", 1, 1, ["no"]), (4, "b", "v1", "remove", 1, 1, [""]),
         (5, "b", None, "write", 1, 1, ["again"]), (6, "c", None, "write", 1, 1, ["c"]), (7, "d", "v1", "edit", 1, 1, ["d"])],
        "req_id long, path string, v string, op string, start int, finish int, new array<string>",
    )
    got = {r.path: (r.outcomes, r.lines, r.removed) for r in H.edit_lines(files, requests).collect()}
    assert got["a"] == (["ok", "ok", "conflict"], ["1", "new"], False)
    assert got["b"] == (["ok", "ok"], ["again"], False)
    assert got["c"] == (["ok"], ["c"], False)
    assert got["d"] == (["not_found"], [], True)
