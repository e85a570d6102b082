"""Versions taken back through random logs, against a walk back change by change."""

import pytest

from test_lifelines import log_of, tables
from textledger.functions import text as T
from textledger.operators import versions as V


def styled(lines):
    """The lines in a style that depends on how many they are."""
    k = len(lines)
    end = "\r\n" if k % 4 == 1 else "\n"
    return (T.BOM if k % 4 == 2 else "") + end.join(lines) + (end if k % 3 and lines else "")


def version(lines):
    return V.version_of(styled(lines))


def walk_back(changes, files, path, v):
    if path in files and version(files[path]) == v:
        return "current", path, None
    for c in reversed(changes):
        if path not in (c["path"], c["from_path"]):
            continue
        if c["binary"]:
            return "not_found", path, None
        if c["from_path"]:
            path = c["from_path"]
        if not c["created"] and c["v_before"] == v:
            return "found", path, c["change_id"]
    return "not_found", path, None


class Broken(Exception):
    pass


def taken_back(changes, frags, files, state, c, follow):
    """(path, lines) as it was before a change; lines None: no file."""
    path, lines = state
    if c["from_path"]:
        if c["path"] == path:
            if lines is None:
                raise Broken
            return (c["from_path"], lines) if follow else (path, None)
        there = (c["path"], files.get(c["path"]))
        for later in reversed(changes):
            if later["change_id"] > c["change_id"] and c["path"] in (later["path"], later["from_path"]):
                there = taken_back(changes, frags, files, there, later, False)
        return path, there[1]
    if c["binary"] or (lines is None) != c["removed"]:
        raise Broken
    out, shift = list(lines or []), 0
    for p, old, new in frags.get(c["change_id"], []):
        if out[p : p + len(new)] != new:
            raise Broken
        out[p : p + len(new)] = old
    return path, None if c["created"] else out


def strict(changes, frags, files, path, v):
    """As walk_back, but with contents, and given up where the chain breaks."""
    state = path, files.get(path)
    if state[1] is not None and version(state[1]) == v:
        return "current", path, None
    try:
        for c in reversed(changes):
            if state[0] in (c["path"], c["from_path"]):
                state = taken_back(changes, frags, files, state, c, True)
                if state[1] is not None and c["v_before"] == v:
                    return "found", state[0], c["change_id"]
    except Broken:
        pass
    return "not_found", path, None


@pytest.mark.parametrize("seed", [5, 6])
def test_every_version(spark, seed):
    changes, frags, files = log_of(seed, version=version)
    asked = sorted({(p, v) for c in changes for p in "abcdefz" for v in (c["v_before"], c["v_after"]) if v} | {("a", "000000")})
    requests = spark.createDataFrame([(k, *x) for k, x in enumerate(asked)], "req_id long, path string, v string")
    now = spark.createDataFrame([(p, styled(x)) for p, x in files.items()], "path string, content string")
    got = {r.req_id: r for r in V.reconstructed(requests, *tables(spark, changes, frags), now).collect()}
    assert len(got) == len(asked)
    log_by_id = {c["change_id"]: c for c in changes}
    for k, (path, v) in enumerate(asked):
        r = got[k]
        status, where, change = strict(changes, frags, files, path, v)
        assert r.status == status or status == "not_found" == walk_back(changes, files, path, v)[0] or r.status == "found", (path, v, r, status)
        if r.status == "found":  # perhaps behind a break, by what another path holds
            assert V.version_of(r.content) == v and log_by_id[r.change_id]["v_before"] == v
            assert status == "not_found" or (r.path, r.change_id) == (where, change)
    assert {r.status for r in got.values()} == {"current", "found", "not_found"} and any(r.path != asked[k][0] for k, r in got.items() if r.status == "found")


def test_mixed_line_ends_and_a_broken_chain(spark):
    first, second, third = "a\r\nb\nc\r\n", "a\r\nB\nc\r\n", "a\r\nB\nd\r\n"
    v = V.version_of
    rows = [(1, "f", None, True, False, False, None, v(first)), (2, "f", None, False, False, False, v(first), v(second)), (3, "f", None, False, False, False, v(second), v(third))]
    frags = [(1, 1, 0, [], ["a", "b", "c"]), (2, 1, 1, ["b"], ["B"]), (3, 1, 2, ["c"], ["d"])]
    log = spark.createDataFrame(rows, "change_id long, path string, from_path string, created boolean, removed boolean, binary boolean, v_before string, v_after string")
    asked = spark.createDataFrame([(1, "f", v(second)), (2, "f", v(third)), (3, "g", v(third)), (4, "f", v("c\n"))], "req_id long, path string, v string")
    for content, want in ((third, ["found", "current", "not_found", "not_found"]), ("a\r\nB\nspoilt\r\n", ["not_found"] * 4)):
        pieces = spark.createDataFrame(frags, "change_id long, seq int, pos int, old array<string>, new array<string>")
        got = V.reconstructed(asked, log, pieces, spark.createDataFrame([("f", content)], "path string, content string"))
        assert [r.status for r in got.orderBy("req_id").collect()] == want
