"""An index that follows edits, against scans of the files and an index made anew."""

import random

import pytest
from pyspark.sql import functions as F

from textledger.operators import search as S
from textledger.operators import stored_search
from textledger.operators.index_updates import FollowedIndex
from textledger.sources.tables import work_path

FILES = "path string, content string"


def started(spark, files):
    rows = spark.createDataFrame(files, FILES)
    base = stored_search.write_trigrams(S.chunks_of(rows), work_path(spark, "test-base"))
    return FollowedIndex.start(base, rows, work_path(spark, "test-updates"))


def pairs(rows):
    return sorted(map(tuple, rows.collect()))


def lines_of(content):
    out = (content or "").split("\n")
    return out[:-1] if out[-1] == "" else out


def check(spark, index, files):
    """Chunks cover every file's lines in order and without overlap; trigrams and hits are those of the lines."""
    chunks = index.placed().collect()
    by_path = {}
    for c in sorted(chunks, key=lambda c: (c.path, c.first)):
        have = by_path.setdefault(c.path, [])
        assert c.first == len(have) and 0 < len(c.lines) <= S.CHUNK * 3 // 2
        have += c.lines
    assert by_path == {p: lines_of(t) for p, t in files if lines_of(t)}
    kept = index.postings().join(index.added("gone"), ["path", "chunk_no"], "left_anti").select("tri", "path", "chunk_no")
    assert pairs(kept) == pairs(S.trigram_index(index.placed()).select("tri", "path", "chunk_no"))
    asked = spark.createDataFrame([(1, "line 7"), (2, "new"), (3, "zzz"), (4, "ine 29")], "query_id long, text string")
    words = {1: "line 7", 2: "new", 3: "zzz", 4: "ine 29"}
    expected = sorted((q, p, n, t) for p, c in files for n, t in enumerate(lines_of(c), 1) for q, w in words.items() if w in t)
    assert pairs(stored_search.search_literal(asked, index)) == expected
    return {(c.path, c.chunk_no): c for c in chunks}


def test_random_edits(spark):
    rng = random.Random(2)
    files = {f"f{k}": "\n".join(f"line {i}" for i in range(n)) for k, n in enumerate((0, 1, 255, 256, 257, 900))}
    index = started(spark, list(files.items()))
    check(spark, index, list(files.items()))
    for step in range(3):
        for name in list(files):
            lines = lines_of(files[name])
            at, cut = rng.randrange(len(lines) + 1), rng.choice([0, 0, 1, 5, 300])
            lines[at : at + cut] = [rng.choice(["new", "line 7", "", "ΟΔΟΣ new"]) for _ in range(rng.choice([0, 1, 3, 400]))]
            files[name] = "\n".join(lines) + rng.choice(["", "\n"])
        files[f"g{step}"] = "zzz\nnew"
        if step == 1:
            del files["f5"], files["g0"]
            files["f1"] = None
        if step == 2:
            files["f5"] = "line 7\nback again"
        assert index.update(spark.createDataFrame(list(files.items()), FILES))
        check(spark, index, list(files.items()))
    assert not index.update(spark.createDataFrame(list(files.items()), FILES))
    merged = index.compact(work_path(spark, "test-merged"), work_path(spark, "test-updates"))
    assert len(merged.commits()) == 1
    before = check(spark, index, list(files.items()))
    assert check(spark, merged, list(files.items())) == before
    files["f2"] = "new\n" + files["f2"]
    assert merged.update(spark.createDataFrame(list(files.items()), FILES))
    check(spark, merged, list(files.items()))


@pytest.mark.parametrize("place", ["top", "end"])
def test_a_line_costs_one_chunk(spark, place):
    lines = [f"line {i}" for i in range(100_000)]
    index = started(spark, [("big", "\n".join(lines)), ("other", "line 7")])
    lines = ["new", *lines] if place == "top" else [*lines, "new"]
    index.update(spark.createDataFrame([("big", "\n".join(lines)), ("other", "line 7")], FILES))
    fresh = index.added("chunks").collect()
    assert len(fresh) == 1 and len(fresh[0].lines) <= S.CHUNK + 1 and index.added("gone").count() == 1
    queries = spark.createDataFrame([(1, "line 99999"), (2, "new")], "query_id long, text string")
    found = {(r.query_id, r.line_no) for r in stored_search.search_literal(queries, index).collect()}
    assert found == {(1, 100_001 if place == "top" else 100_000), (2, 1 if place == "top" else 100_001)}


def test_patterns_that_are_scanned(spark):
    index = started(spark, [("a", "x1\ny\nfoo bar"), ("b", "y")])
    index.update(spark.createDataFrame([("a", "new\nx1\ny\nfoo bar"), ("c", "y2")], FILES))
    asked = [(1, "[xy]\\d"), (2, "foo.*r"), (3, "^y$")]
    found = stored_search.search_regex(spark.createDataFrame(asked, "query_id long, text string"), asked, index)
    assert pairs(found.select("query_id", "path", "line_no")) == [(1, "a", 2), (1, "c", 1), (2, "a", 4), (3, "a", 3)]


def test_an_update_that_died_never_was(spark, monkeypatch):
    files = [("a", "line 7\nline 8"), ("b", "line 7")]
    index = started(spark, files)
    later = [("a", "new\nline 7\nline 8")]

    def broken(postings, at, key):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr("textledger.operators.index_updates.write_frequencies", broken)
        with pytest.raises(RuntimeError, match="lost"):
            index.update(spark.createDataFrame(later, FILES))
    again = FollowedIndex(index, index.updates)
    check(spark, again, files)
    assert again.update(spark.createDataFrame(later, FILES))
    check(spark, again, later)
    assert FollowedIndex(index, index.updates).added("files").where(F.col("n") == 1).count() == 2
