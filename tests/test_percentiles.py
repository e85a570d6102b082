"""Percentiles by selection against sorted values."""

import math
import random

from textledger.operators import metrics as M


def test_percentiles_equal_sorted_values(spark):
    rng = random.Random(4)
    edge = [0, -1, 1, 65_535, 65_536, -65_536, 2**31, -(2**63), 2**63 - 1]
    rows = [("hot", rng.choice([rng.randrange(-(10**12), 10**12), rng.choice(edge), 5])) for _ in range(900)]
    rows += [("one", 7), ("edge", None), *(("edge", e) for e in edge), ("none", None), (None, 3), (None, 4), (None, None)]
    qs = [0.0, 0.25, 0.5, 0.95, 1.0]
    found = {(r.key, r.q): r.value for r in M.percentiles(spark.createDataFrame(rows, "k0 string, v long"), "k0", "v", qs).collect()}
    expected = {}
    for k in {k for k, _ in rows}:
        values = sorted(v for key, v in rows if key == k and v is not None)
        for q in qs:
            expected[k, q] = values[max(1, math.ceil(q * len(values))) - 1] if values else None
    assert found == expected
    assert M.percentiles(spark.createDataFrame([], "k0 string, v long"), "k0", "v", qs).count() == 0
