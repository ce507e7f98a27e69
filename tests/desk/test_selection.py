import random

import numpy as np
import pytest

from wardlight.operators import selection


@pytest.mark.parametrize("buckets", [4, 4096])
def test_percentiles_equal_those_of_a_sorted_list(spark, monkeypatch, buckets):
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    rng = random.Random(buckets)
    ps = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    columns = {
        "long": [[rng.randrange(-50, 50) for _ in range(301)], [7] * 20, [rng.randrange(2**62) for _ in range(64)] + [2**63 - 1, -(2**63)], [5]],
        "double": [[rng.gauss(0, 1) for _ in range(200)], [10.0 ** rng.randrange(-300, 300) for _ in range(80)] + [-0.0, 0.0], [2.0, 3.0]],
    }
    for kind, lists in columns.items():
        for values in lists:
            df = spark.createDataFrame([(v,) for v in [*values, None]], f"v {kind}")
            got = selection.percentiles(df, "v", ps, ps)
            ordered = sorted(values)
            assert got["n"] == len(values) and got["nearest"] == {p: ordered[max(0, int(np.ceil(len(values) * p)) - 1)] for p in ps}
            for p in ps:
                assert got["between"][p] == pytest.approx(float(np.percentile(np.array(values, dtype=float), 100 * p)), rel=1e-9, abs=1e-12)
    assert selection.percentiles(spark.createDataFrame([(None,)], "v long"), "v", [0.5], [0.9]) == {"n": 0, "between": {0.5: None}, "nearest": {0.9: None}}


def test_many_values(spark):
    df = spark.range(2_000_000).selectExpr("(id * 48271) % 1999993 AS v")
    got = selection.percentiles(df, "v", [0.5], [0.9])
    values = np.sort((np.arange(2_000_000, dtype=np.int64) * 48271) % 1999993)
    assert got["between"][0.5] == np.median(values) and got["nearest"][0.9] == values[1_800_000 - 1]


def test_infinities(spark):
    df = spark.createDataFrame([(float(v),) for v in ("-inf", "1", "2", "3", "inf", "nan", "inf")], "v double")
    assert selection.percentiles(df, "v", [], [0.1, 0.3, 0.5, 1.0])["nearest"] == {0.1: float("-inf"), 0.3: 1.0, 0.5: 2.0, 1.0: float("inf")}
