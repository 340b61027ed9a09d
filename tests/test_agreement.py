"""Coefficients of long continuous columns and their p-values against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import agreement, ordered


def exact_p(r, n):
    """Two-sided p by a fine midpoint sum of cos ** (n - 3)."""
    m, low = n - 3, math.asin(min(1.0, abs(r)))
    top = min(math.pi / 2, 40 / math.sqrt(max(m, 1)))

    def area(a):
        t = a + (np.arange(400_000) + 0.5) * (max(top, a) - a) / 400_000
        return float(np.sum(np.exp(m * np.log(np.cos(t))))) * (max(top, a) - a)

    return area(low) / area(0.0)


def test_p_value_is_a_column(spark):
    cases = [(r, n) for n in (3, 4, 5, 7, 10, 30, 101, 1000, 60_000) for r in (0.0, 1e-9, 0.003, -0.02, 0.1, -0.5, 0.9, 0.999999)]
    rows = [(r, n) for r, n in cases] + [(None, 9), (float("nan"), 9), (1.0, 5), (-1.0, 5), (0.5, 2)]
    df = spark.createDataFrame(rows, "r double, n long").select("r", "n", agreement.p_value("r", "n").alias("p"))
    got = [r["p"] for r in df.collect()]
    assert got[-5:] == [None, None, 0.0, 0.0, None]
    for (r, n), p in zip(cases, got):
        want = exact_p(r, n)
        assert math.isclose(p, want, rel_tol=2e-6, abs_tol=1e-14), (r, n, p, want)
    assert "Python" not in df._jdf.queryExecution().toString() and "Pandas" not in df._jdf.queryExecution().toString()


def test_p_value_next_to_one(spark):
    """n = 4: p is 1 - |r|."""
    rows = [(1 - 10.0**-k, 4) for k in range(1, 16)] + [(1 - 10.0**-k, 9) for k in range(1, 16)]
    got = [x["p"] for x in spark.createDataFrame(rows, "r double, n long").select(agreement.p_value("r", "n").alias("p")).collect()]
    assert all(math.isclose(p, 1 - r, rel_tol=1e-3) for p, (r, _) in zip(got[:12], rows)) and all(p < 1e-12 for p in got[12:15])
    assert all(p > q for p, q in zip(got[15:], got[16:]))


def test_p_value_of_very_many_pairs(spark):
    """z = 2 of ten thousand million pairs: 0.0455 as for the normal distribution."""
    r = 2 / math.sqrt(10**10)
    p = spark.createDataFrame([(r, 10**10)], "r double, n long").select(agreement.p_value("r", "n")).first()[0]
    assert math.isclose(p, 0.0455002639, rel_tol=1e-6)


def brute_kendall(pairs):
    s = sum(np.sign(x1 - x2) * np.sign(y1 - y2) for i, (x1, y1) in enumerate(pairs) for x2, y2 in pairs[:i])
    n = len(pairs)
    n0 = n * (n - 1) / 2
    tie = lambda k: sum(t * (t - 1) / 2 for t in np.unique([p[k] for p in pairs], return_counts=True)[1])
    below = (n0 - tie(0)) * (n0 - tie(1))
    return (s / math.sqrt(below) if below else None), n, float(s)


@pytest.mark.parametrize("levels", [1, 2, 5, 40, 10**6])
@pytest.mark.parametrize("ranges", [1, 3, 256])
def test_kendall_values(spark, monkeypatch, levels, ranges):
    """Continuous values, few levels, one side constant, a tie with a third of the rows, nulls."""
    monkeypatch.setattr(agreement, "RANGES", ranges)
    rng = random.Random(levels + ranges)
    pairs = [(rng.randrange(levels) / 7, rng.choice([rng.randrange(levels), rng.randrange(levels) + 3 * levels // 2]) / 3) for _ in range(250)]
    pairs += [(0.5, rng.random()) for _ in range(120)]
    df = spark.createDataFrame([*pairs, (None, 1.0), (1.0, None)], "x double, y double").repartition(3)
    got, (tau, n, s) = agreement.kendall_values(df, "x", "y").first(), brute_kendall(pairs)
    assert (got["n"], got["s"]) == (n, s) and math.isclose(got["tau"], tau)
    few = agreement.kendall(df, "x", "y").first()
    assert all(math.isclose(got[c], few[c], rel_tol=1e-9) for c in ("tau", "s", "z"))


def test_kendall_of_nothing(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert tuple(agreement.kendall_values(empty, "x", "y").first()) == (None, 0, 0.0, None)
    same = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    assert tuple(agreement.kendall_values(same, "x", "y").first())[:3] == (None, 5, 0.0)


def test_inversions():
    rng = np.random.default_rng(1)
    for n, levels in ((0, 1), (1, 1), (2, 2), (300, 3), (300, 10**6)):
        y, c = rng.integers(0, levels, n), rng.integers(1, 50, n)
        want = sum(int(c[i] * c[j]) for j in range(n) for i in range(j) if y[i] > y[j])
        assert agreement.inversions(y, c) == want
        assert agreement.inversions(y, c * 10**11) == want * 10**22  # beyond 64 bits


def test_no_side_is_collected(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5003).cast("double").alias("x"), (F.col("id") * 91 % 4999).cast("double").alias("y"))
    ranks = agreement.average_ranks(df, "x", "r")
    plan = ranks._jdf.queryExecution().toString()
    assert "collect_list" not in plan and ranks.agg(F.min("r"), F.max("r"), F.sum("r")).first() == (1.0, 5000.0, 5000 * 5001 / 2)
    tied = spark.createDataFrame([(2.0,), (1.0,), (2.0,), (None,), (2.0,)], "x double")
    assert sorted(r["r"] for r in agreement.average_ranks(tied, "x", "r").collect()) == [1.0, 3.0, 3.0, 3.0]


def test_places(spark):
    df = spark.createDataFrame([(float(v),) for v in range(-1, 8)], "v double")
    got = [r[0] for r in df.select(ordered.place(F.col("v"), [0.0, 2.5, 6.0])).collect()]
    assert got == [0, 1, 2, 2, 4, 4, 4, 5, 6] and df.select(ordered.place(F.col("v"), [])).distinct().collect() == [(0,)]
