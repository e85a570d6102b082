"""References and undo plans over random logs with moves, removals and re-creations, against a walk change by change."""

import random

import pytest

from textledger.operators import history as H
from textledger.operators import lifelines as L

CHANGE = "change_id long, path string, from_path string, created boolean, removed boolean, binary boolean, v_before string, v_after string"


def log_of(seed, n=160, paths="abcdef", version=lambda lines: str(hash(tuple(lines)))):
    """Changes with fragments of lines, and the files that they lead to."""
    rng, files, changes, frags = random.Random(seed), {}, [], {}
    for c in range(1, n):
        path = rng.choice(paths)
        v = lambda lines: None if lines is None else version(lines)
        old = files.get(path)
        kind = rng.random()
        row = dict(change_id=c, path=path, from_path=None, created=False, removed=False, binary=False, v_before=v(old), v_after=None)
        if old is None:
            gone = [x for x in changes if x["removed"] and x["path"] == path]
            lines = list(frags[gone[-1]["change_id"]][0][1]) if gone and rng.random() < 0.6 else [f"l{c}.{k}" for k in range(rng.randrange(1, 30))]
            row |= dict(created=True, v_after=v(lines))
            frags[c], files[path] = [(0, [], lines)], lines
        elif kind < 0.12 and (source := rng.choice([p for p in files])) != path:
            row |= dict(from_path=source, v_before=v(files[source]), v_after=v(files[source]))
            files[path] = files.pop(source)
        elif kind < 0.16 and (free := [p for p in paths if p not in files]):
            row |= dict(path=free[0], from_path=path, v_after=v(old))
            files[free[0]] = files.pop(path)
        elif kind < 0.24:
            row |= dict(removed=True)
            frags[c] = [(0, old, [])]
            del files[path]
        elif kind < 0.28:
            row |= dict(binary=True, v_after=v(old))
        else:
            lines = []
            for k, x in enumerate(old):
                lines += [] if rng.random() < 0.06 else [f"e{c}.{k}"] if rng.random() < 0.06 else [x]
                lines += [f"i{c}.{k}"] if rng.random() < 0.05 else []
            frags[c] = [(s, old[s:e], lines[a:b]) for s, e, a, b in H.line_fragments(old, lines)]
            row |= dict(v_after=v(lines))
            files[path] = lines
        changes.append(row)
    return changes, frags, files


def walk(changes, frags, path, since, lo, hi):
    removed, gone, overlaps = False, None, []
    for c in changes:
        if c["change_id"] <= since or path not in (c["path"], c["from_path"]):
            continue
        n = c["change_id"]
        if removed:
            if c["created"] and not c["binary"] and c["v_after"] and c["v_after"] == gone["v_before"]:
                overlaps.remove(gone["change_id"])
            else:
                overlaps.append(n)
            removed = c["removed"]
            path = c["path"] if c["from_path"] == path else path
        elif c["from_path"] == path:
            path = c["path"]
        elif c["from_path"] or c["binary"]:
            overlaps.append(n)
        elif c["removed"]:
            overlaps.append(n)
            removed, gone = True, c
        else:
            lo, hi, hit = H.hop([(p, len(o), len(w)) for p, o, w in frags.get(n, [])], lo, hi)
            overlaps += [n] * hit
    return path, lo, hi, overlaps, removed


def tables(spark, changes, frags):
    rows = [(c, k, p, o, n) for c, fs in frags.items() for k, (p, o, n) in enumerate(fs, 1)]
    return spark.createDataFrame([tuple(c.values()) for c in changes], CHANGE).repartition(3), spark.createDataFrame(rows, "change_id long, seq int, pos int, old array<string>, new array<string>").repartition(2)


@pytest.mark.parametrize("seed", range(3))
def test_followed_equals_a_walk(spark, monkeypatch, seed):
    monkeypatch.setattr(L, "REFS_IN_TASK", 7)
    monkeypatch.setattr(L, "BUCKETS", 5)
    changes, frags, _ = log_of(seed)
    rng = random.Random(seed)
    refs = [(f"r{k}", rng.choice("abcdefz"), rng.randrange(0, 160), lo := rng.randrange(0, 25), lo + rng.choice([0, 1, 6])) for k in range(300)]
    log, pieces = tables(spark, changes, frags)
    counts = pieces.selectExpr("change_id", "seq", "pos", "size(old) AS old_n", "size(new) AS new_n")
    got = {r.ref_id: tuple(r)[1:] for r in L.followed(spark.createDataFrame(refs, "ref_id string, path string, since long, lo long, hi long"), log, counts).collect()}
    assert len(got) == len(refs)
    for i, *ref in refs:
        assert got[i] == walk(changes, frags, *ref), (i, ref)
    assert any(got[i][0] != path for i, path, *_ in refs)


def test_move_then_remove(spark):
    """A reference follows its file to the new name; the removal is then an overlap; written back as it was, it isn't; otherwise both are."""
    base = [(1, "old", None, True, False, False, None, "v1"), (2, "new", "old", False, False, False, "v1", "v1"), (3, "new", None, False, False, False, "v1", "v2")]
    frags = spark.createDataFrame([(1, 1, 0, 0, 4), (3, 1, 0, 0, 1), (5, 1, 0, 0, 5)], "change_id long, seq int, pos int, old_n int, new_n int")
    ref = spark.createDataFrame([("r", "old", 1, 1, 3)], "ref_id string, path string, since long, lo long, hi long")
    gone = (4, "new", None, False, True, False, "v2", None)
    for more, want in (
        ([], ("new", 2, 4, [], False)), ([gone], ("new", 2, 4, [4], True)),
        ([gone, (5, "new", None, True, False, False, None, "v2")], ("new", 2, 4, [], False)), ([gone, (5, "new", None, True, False, False, None, "v3")], ("new", 2, 4, [4, 5], False)),
    ):
        assert tuple(L.followed(ref, spark.createDataFrame(base + more, CHANGE), frags).collect()[0])[1:] == want


def test_undo_plans(spark):
    changes, frags, files = log_of(11)
    changes[100]["binary"] = True
    spoilt = next(c for c in reversed(changes) if not (c["created"] or c["removed"] or c["from_path"] or c["binary"]) and c["path"] in files and any(f[2] for f in frags[c["change_id"]]))
    last = {c["path"]: c for c in changes}
    gone = next(p for p, c in last.items() if p in files and p != spoilt["path"] and not (c["created"] or c["from_path"]))
    changes.append(dict(changes[-1], change_id=200, path=gone, from_path=None, created=False, removed=True, binary=False))
    frags[200] = [(0, files.pop(gone), [])]
    lines = [(p, k, x if x not in {y for f in frags[spoilt["change_id"]] for y in f[2]} else "spoilt") for p, f in files.items() for k, x in enumerate(f, 1)]
    log, pieces = tables(spark, changes, frags)
    got = {r.change_id: r for r in L.undo_plans(log, pieces, spark.createDataFrame(lines, "path string, line_no int, text string")).collect()}
    now = {}
    for p, k, x in lines:
        now.setdefault(p, {})[k] = x
    seen = set()
    for c in changes:
        if c["created"] or c["removed"] or c["from_path"]:
            assert c["change_id"] not in got
            continue
        r, shift, by, removed, wrong, hunks = got[c["change_id"]], 0, set(), False, False, []
        for seq, (p, o, n) in enumerate(frags.get(c["change_id"], []), 1):
            path, lo, hi, overlaps, gone = walk(changes, frags, c["path"], c["change_id"], p + shift, p + shift + len(n))
            shift += len(n) - len(o)
            by |= set(overlaps)
            removed |= gone
            wrong |= any(now.get(path, {}).get(lo + k + 1) != x for k, x in enumerate(n))
            hunks.append((seq, lo, hi))
        want = "refused" if c["binary"] else "removed" if removed else "conflict" if by else "unrecorded" if wrong else "ok"
        seen.add(want)
        assert r.status == want
        if not c["binary"] and hunks:
            assert (r.path, list(r.by), [tuple(h) for h in r.hunks]) == (path, sorted(by), hunks)
    assert seen == {"refused", "removed", "conflict", "unrecorded", "ok"}


def test_undo_plan_query(spark):
    """The registered plans against the one-hop plan of the same edits."""
    from textledger.plans import history

    sf = "/root/testdata/sf0.001"
    got = {r.path: r for r in history.undo_plan_changes(spark, sf).collect() if r.change_id % 2 == 0}
    want = {}
    for r in history.undo_plan(spark, sf).collect():
        want.setdefault(r.path, []).append(r)
    assert set(got) == set(want)
    for path, rows in want.items():
        assert got[path].status == ("conflict" if any(r.status == "conflict" for r in rows) else "ok")
        assert [tuple(h) for h in got[path].hunks] == [(r.seq, r.lo, r.hi) for r in sorted(rows, key=lambda r: r.seq)]


def test_changes_are_not_sent_to_a_part_for_each_few_references(spark, monkeypatch):
    """A change is one row of a part, of at most as many parts as there are tasks, and only of those with a reference before it."""
    changes, frags, _ = log_of(9)
    asked = [(f"{c['change_id']}-{k}", c["path"], c["change_id"], k, k + 3) for c in changes for k in range(4)]
    refs = spark.createDataFrame(asked, "ref_id string, path string, since long, lo long, hi long")

    def streamed(batches, *more):
        import pyarrow as pa

        for b in batches:
            t = pa.Table.from_batches([b]).select(["kind", "root", "part", "at"]).to_pylist()
            rows = [{"ref_id": str(r["kind"]), "path": r["root"], "lo": r["part"], "hi": r["at"], "overlaps": None, "removed": None} for r in t]
            kinds = [("ref_id", pa.string()), ("path", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("overlaps", pa.list_(pa.int64())), ("removed", pa.bool_())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    monkeypatch.setattr(L, "carried", streamed)
    monkeypatch.setattr(L, "REFS_IN_TASK", 8)
    counts = tables(spark, changes, frags)
    pieces = counts[1].selectExpr("change_id", "seq", "pos", "size(old) old_n", "size(new) new_n")
    got = [(r.ref_id, r.path, r.lo, r.hi) for r in L.followed(refs, counts[0], pieces).collect()]
    since = {}
    for kind, root, part, at in got:
        if kind == str(L.REF):
            since[root, part] = min(since.get((root, part), at), at)
    own = [x for x in got if x[0] == str(L.OWN)]
    assert sum(x[0] == str(L.REF) for x in got) == len(asked)
    assert len(own) == len(set(own)) <= 4 * len(changes)
    starts = {r: sorted(s for (x, _), s in since.items() if x == r) for r, _ in since}
    assert all(sum(s <= at for s in starts[root]) >= 1 for _, root, _, at in own)
