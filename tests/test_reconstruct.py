"""Files taken back through fragments and moves."""

from textledger.operators import history as H
from textledger.plans import history

SF = "/root/testdata/sf0.001"


def test_files_are_taken_back_through_moves(spark, monkeypatch):
    files = spark.createDataFrame([("b", list("aXcdeZ")), ("q", ["1"]), ("gone", []), ("broken", ["x"]), ("short", ["x"])], "path string, lines array<string>")
    pieces = "path string, seq int, pos int, old array<string>, new array<string>"
    later = spark.createDataFrame([("b", 1, 1, ["b"], ["X"]), ("b", 2, 5, [], ["Z"]), ("broken", 1, 0, ["w"], ["y"]), ("short", 1, 0, ["w"], ["x", "y"])], pieces)
    moves = spark.createDataFrame([("b", "a")], "path string, from_path string")
    first = spark.createDataFrame([("a", 1, 0, ["0"], []), ("a", 2, 4, ["D", "D"], ["d"]), ("gone", 1, 0, ["g", "h"], [])], pieces)
    for most in (H.MOST_PICKED, 0):
        monkeypatch.setattr(H, "MOST_PICKED", most)
        got = {r.path: (r.lines, r.mismatch) for r in H.reconstruct(files, [later, moves, first]).collect()}
        assert {p: got.pop(p)[1] for p in ("broken", "short")} == {"broken": True, "short": True}
        # The first step's fragments are from before the move, so they are of a.
        assert got == {"a": (list("0abcDDe"), False), "q": (["1"], False), "gone": (["g", "h"], False)}


def test_lines_are_not_dealt_one_by_one(spark, monkeypatch):
    plans, durable = [], H.durable
    monkeypatch.setattr(H, "durable", lambda df: plans.append(df) or durable(df))
    plans.append(history.reconstruct_version(spark, SF))
    assert not any("Generate" in df._jdf.queryExecution().executedPlan().toString() for df in plans)
