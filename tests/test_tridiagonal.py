"""Tridiagonal systems and splines in blocks against dense solves."""

import numpy as np
import pytest
from orrery.operators.series import cubic_second_derivatives
from orrery.operators.tridiagonal import solve, solve_rows, spline
from pyspark.sql import functions as F


def dense(low, mid, high):
    return np.diag(mid) + np.diag(low[1:], -1) + np.diag(high[:-1], 1)


@pytest.mark.parametrize("n, block", [(1, 4), (2, 1), (50, 7), (64, 8), (30, 100), (9, 1)])
def test_blocks_give_the_whole(spark, n, block):
    rng = np.random.default_rng(n)
    low, high, rhs = rng.normal(size=(3, n))
    mid = 3 + np.abs(low) + np.abs(high)
    rows = [(i, float(low[i]), float(mid[i]), float(high[i]), float(rhs[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "idx long, low double, mid double, high double, rhs double").repartition(3)
    want = np.linalg.solve(dense(low, mid, high), rhs)
    np.testing.assert_allclose([r["x"] for r in sorted(solve(df, block).collect())], want, atol=1e-12)
    np.testing.assert_allclose(solve_rows(low, mid, high, rhs), want, atol=1e-12)
    assert solve(df.where("false"), block).count() == 0


def test_what_raises(spark):
    row = "idx long, low double, mid double, high double, rhs double"
    with pytest.raises(Exception, match="zero pivot"):
        solve(spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0)], row)).collect()
    with pytest.raises(Exception, match="missing value"):
        solve(spark.createDataFrame([(0, 0.0, 1.0, 0.0, None)], row)).collect()
    two = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 2.0), (2, 3.0, 1.0)], "idx long, t double, x double")
    with pytest.raises(Exception, match="times must rise"):
        spline(two, 1.0).collect()
    with pytest.raises(ValueError, match="outside"):
        spline(two, 1.0, 2)
    with pytest.raises(ValueError, match="no such rule"):
        spline(two, 1.0, 2, "wrap")


@pytest.mark.parametrize("outside, block", [("clamp", 4), ("linear", 4), ("linear", 1), ("linear", 100)])
def test_splines(spark, outside, block):
    rng = np.random.default_rng(3)
    t, x = np.cumsum(rng.uniform(0.2, 2, 23)) + 5, rng.normal(size=23)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x, strict=True))], "idx long, t double, x double").repartition(4)
    got = {round(r["t"], 9): r["y"] for r in spline(df, 0.5, 3, outside, block).collect()}
    a = np.zeros((23, 23))
    h, s = np.diff(t), np.diff(x) / np.diff(t)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, 22):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
    m = np.linalg.solve(a, np.concatenate([[0], 6 * np.diff(s), [0]]))
    np.testing.assert_allclose(cubic_second_derivatives(t, x), m, atol=1e-10)
    grid = np.arange(np.ceil(t[0] / 0.5) - 3, np.floor(t[-1] / 0.5) + 4) * 0.5
    assert sorted(got) == [round(g, 9) for g in grid]
    for g in grid:
        if g < t[0] or g > t[-1]:
            k, slope = (0, s[0]) if g < t[0] else (-1, s[-1])
            want = x[k] + (slope * (g - t[k]) if outside == "linear" else 0)
        else:
            i = min(np.searchsorted(t, g, side="right") - 1, 21)
            u = (g - t[i]) / h[i]
            want = (1 - u) * x[i] + u * x[i + 1] + h[i] ** 2 / 6 * (((1 - u) ** 3 - (1 - u)) * m[i] + (u**3 - u) * m[i + 1])
        assert abs(got[round(g, 9)] - want) < 1e-9


def test_one_sample(spark):
    one = spark.createDataFrame([(0, 2.0, 7.0)], "idx long, t double, x double")
    assert {r["t"]: r["y"] for r in spline(one, 1.0, 1, "linear").collect()} == {1.0: 7.0, 2.0: 7.0, 3.0: 7.0}
    assert spline(one.where(F.lit(False)), 1.0, 1, "clamp").count() == 0
