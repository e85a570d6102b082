"""Contents are joined only for paths whose hashes differ."""

from textledger.plans import history


def test_differing_shuffles_only_changed_contents(spark, monkeypatch):
    old = spark.createDataFrame([("p", "x\ny"), ("q", "same"), ("gone", "z")], "path string, a string")
    new = spark.createDataFrame([("p", "x\nz"), ("q", "same"), ("fresh", "z")], "path string, b string")
    found = history.differing(old, new)
    expected = [("p", ["x", "y"], ["x", "z"])]
    assert [tuple(r) for r in found.collect()] == expected
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(history, "MOST_PATHS", 0)
    assert [tuple(r) for r in history.differing(old, new).collect()] == expected
