"""Work that is done once, not in each round or for each path alone."""

from textledger.operators import history as H
from textledger.streaming import feeds


def test_closure_reads_moves_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    moves = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(8)] + [("x", "y")], "path string, from_path string").mapInArrow(counted, "path string, from_path string")
    found = H.closure(spark.createDataFrame([("f3",)], "path string"), moves)
    assert sorted(r.path for r in found.collect()) == [f"f{i}" for i in range(9)]
    assert read.value == 9


def test_versions_in_turns(spark):
    parts = [[("a", "h1" * 4, 0), ("b", "h2" * 4, 0)], [("a", "h1" * 4, 1), ("b", "h3" * 4, 1), ("c", "h4" * 4, 1), ("c", "h5" * 4, 2)], [("b", "h3" * 4, 3)]]
    frames = [spark.createDataFrame(p, "path string, hash string, seq int") for p in parts]
    found = sorted(map(tuple, feeds.versions(frames).collect()))
    h = [(f"h{k}" * 4)[:6] for k in range(6)]
    assert found == [("a", h[1], "added"), ("a", h[1], "unchanged"), ("b", h[2], "added"), ("b", h[3], "modified"), ("b", h[3], "unchanged"), ("c", h[4], "added"), ("c", h[5], "modified")]
