"""Decimal rationals, empty clusters, fast transforms and Toeplitz systems."""

import math
from fractions import Fraction

import numpy as np
import pytest
from orrery.functions import scalar as S
from orrery.operators import cluster, spectral
from pyspark.sql import functions as F


def test_decimal_text_is_an_exact_rational(spark):
    texts = ["0.5", "1.4/2", "-0.125", "6/8", "5", "+.25", "7.", "-3/0.75", "12345678901234567890/10", "0.0", " 1.10 / 2 "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.rational_text(S.rational_of(F.col("t")))).collect()]
    want = [Fraction(a) / Fraction(b or "1") for a, _, b in (t.replace(" ", "").partition("/") for t in texts)]
    assert got == [str(w) for w in want]
    assert spark.range(1).select(S.rational_of(F.lit(None).cast("string"))).first()[0] is None
    for bad in ("", "a", "1/2/3", "1e3", "0x1", "1/", "1/0.0", "--1"):
        with pytest.raises(Exception, match="rational|zero"):
            spark.range(1).select(S.rational_of(F.lit(bad))).collect()


def test_gcd_in_short_and_long_numbers(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(2**62), 2**62, (40, 2))] + [(0, 0), (0, 7), (2**63 - 1, 2**62), (10**37, 10**20 * 3), (-(10**30), 15), (12200160415121876738, 7540113804746346429)]
    rows = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string")
    assert [int(r[0]) for r in rows.select(S.gcd(F.col("a").cast(S.WIDE), F.col("b").cast(S.WIDE))).collect()] == [math.gcd(a, b) for a, b in pairs]


def test_empty_clusters_take_different_points(spark):
    spots = [(0.0, 0.0)] * 30 + [(10.0, 0.0), (0.0, 10.0), (10.0, 10.0)]
    points = spark.createDataFrame([(i, list(p)) for i, p in enumerate(spots)], "pid long, p array<double>")
    model = cluster.fit_kmeans(points, "p", "pid", 4, seed=1, restarts=1)
    assert len({tuple(c) for c in model.centers.tolist()}) == 4 and model.inertia < 1e-9


@pytest.mark.parametrize("kind", list(spectral.KERNELS))
def test_fast_transforms_follow_the_definition(spark, kind):
    rng = np.random.default_rng(6)
    rows = [(u, i, float(x)) for u, n in enumerate((1, 2, 3, 8, 13)) for i, x in enumerate(rng.normal(size=n))]
    series = spark.createDataFrame(rows, "u int, idx long, x double")
    want = {(r["u"], r["k"]): r["y"] for r in spectral.trigonometric(series, ["u"], kind).collect()}
    got = {(r["u"], r["k"]): r["y"] for r in spectral.fast_trigonometric(series, ["u"], kind).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_levinson_solves_as_the_dense_system():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 7, 40):
        column, row, right = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
        column[0] = row[0] = 5 + n
        dense = np.array([[column[i - j] if i >= j else row[j - i] for j in range(n)] for i in range(n)])
        assert np.allclose(spectral.solve_toeplitz(column, row, right), np.linalg.solve(dense, right))
    assert np.allclose(spectral.solve_toeplitz(np.array([0.0, 1.0]), np.array([0.0, 2.0]), np.array([2.0, 3.0])), [3.0, 1.0])
