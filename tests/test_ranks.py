"""One percentile path for small and large groups, odd numbers included."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.plans.ranks import percentiles, rank_within

POINTS = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
INF, NAN = math.inf, math.nan
GROUPS = {
    "one": [3.0], "small": [1.0, 2.0, 4.0, 8.5], "ties": [2.0] * 9 + [1.0] * 3, "signs": [-1.5, 0.0, -0.0, 7.0, -300.25, 2.0],
    "tiny": [5e-324, 1e-310, 2.2e-308, -5e-324, 0.0, 3e-320], "huge": [1.7e308, 1e300, -1e308, 4.0], "nan": [float(k) for k in range(100)] + [NAN] * 20,
    "inf": [1.0, 2.0, INF, INF, INF, 3.0], "both": [-INF, -INF, 0.0, 1.0, INF],
}


def wanted(values, p: float) -> float:
    if any(math.isnan(v) for v in values):
        return NAN
    ordered, at = sorted(values), p * (len(values) - 1)
    low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
    return low if low == high or at == math.floor(at) else low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("copies", [1, 700])
def test_odd_numbers(spark, copies):
    rows = [(g, v) for g, vs in GROUPS.items() for v in vs] + [("small", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("k")
    got = {r["g"]: r for r in percentiles(df, ["g"], "v", POINTS).collect()}
    assert set(got) == set(GROUPS)
    for g, values in GROUPS.items():
        for name, p in POINTS.items():
            want = wanted(values * copies, p)
            assert got[g][name] == pytest.approx(want, rel=1e-12, abs=0) or (math.isnan(want) and math.isnan(got[g][name])), (g, name)
            if np.isfinite(values).all():
                assert want == pytest.approx(float(np.percentile(np.array(values * copies), 100 * p)), rel=1e-12, abs=1e-320)


def test_zeros_that_are_not_stored(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", -1.0), ("b", 2.0)], "g string, v double")
    zeros = spark.createDataFrame([("a", 6), ("b", 0), ("c", 3)], "g string, zeros long")
    got = {r["g"]: r for r in percentiles(df, ["g"], "v", POINTS, zeros).collect()}
    for g, values in {"a": [5.0, -1.0] + [0.0] * 6, "b": [2.0], "c": [0.0] * 3}.items():
        for name, p in POINTS.items():
            assert got[g][name] == pytest.approx(float(np.percentile(values, 100 * p)))


@pytest.mark.parametrize("rows", [1, 7, 65536])
def test_positions_of_sparse_and_dense_orders(spark, rows):
    numbers = [k * k * 7919 % 10**12 - 5 * 10**11 for k in range(300)] + list(range(50))
    data = sorted({(k % 3, v) for k, v in enumerate(numbers)} | {(9, -(2**62)), (9, 2**62)})
    df = spark.createDataFrame(data, "g int, o long").repartition(4)
    got = {(r["g"], r["o"]): r["n"] for r in rank_within(df, ["g"], "o", "n", rows).collect()}
    want = {}
    for g, o in data:
        want[g, o] = sum(1 for h, p in data if h == g and p <= o)
    assert got == want
