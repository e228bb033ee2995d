"""Chirp transforms against numpy and by definition; the bootstrap in blocks against the theory and against itself."""

from fractions import Fraction

import numpy as np
import pytest
from orrery.operators import stats
from orrery.operators.chirp import chirp_z, long_fft, next_prime
from pyspark.sql import functions as F


def series(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx long, x double").repartition(3)


def complex_of(df, at="k"):
    rows = sorted((r[at], complex(r["re"], r["im"])) for r in df.collect())
    assert [k for k, _ in rows] == list(range(len(rows)))
    return np.array([z for _, z in rows])


@pytest.mark.parametrize("n, bins, first, step", [(97, 97, Fraction(0), Fraction(1, 97)), (50, 13, Fraction(1, 7), Fraction(3, 400)), (1, 4, Fraction(0), Fraction(1, 9)), (20, 1, Fraction(-1, 3), Fraction(1, 5)), (33, 70, Fraction(2, 5), Fraction(-7, 90))])
def test_any_length_and_grid(spark, n, bins, first, step):
    x = np.random.default_rng(n).normal(size=n)
    got = complex_of(chirp_z(series(spark, x), bins, first, step))
    f = float(first) + np.arange(bins) * float(step)
    np.testing.assert_allclose(got, np.exp(-2j * np.pi * np.outer(f, np.arange(n))) @ x, atol=1e-9 * max(1, n))


def test_gaps_and_nothing(spark):
    x = series(spark, np.arange(20.0))
    got = complex_of(chirp_z(x.where("idx % 3 <> 1"), 20, Fraction(0), Fraction(1, 20), 20))
    np.testing.assert_allclose(got, np.fft.fft([v if v % 3 != 1 else 0 for v in range(20)]), atol=1e-9)
    assert np.allclose(complex_of(chirp_z(x.where("false"), 3, Fraction(0), Fraction(1, 3))), 0)
    with pytest.raises(Exception, match="a missing value"):
        chirp_z(x.select("idx", F.lit(None).cast("double").alias("x")), 3, Fraction(0), Fraction(1, 3)).collect()
    with pytest.raises(ValueError, match="64 bits"):
        chirp_z(x, 3, Fraction(0), Fraction(1, 2**31))


@pytest.mark.parametrize("inverse", [False, True])
def test_two_passes(spark, inverse):
    z = np.random.default_rng(2).normal(size=(32, 2)) @ [1, 1j]
    df = spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(z)], "idx long, re double, im double")
    np.testing.assert_allclose(complex_of(long_fft(df, 5, inverse), "idx"), np.fft.ifft(z) * 32 if inverse else np.fft.fft(z), atol=1e-9)


def test_primes():
    assert [next_prime(n) for n in (0, 2, 8, 10_000)] == [2, 2, 11, 10_007]


def test_bootstrap_in_blocks(spark):
    """Over several blocks the intervals are those of the theory, the same again in other partitions, and close to one block's."""
    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in rng.normal(0, 2, 900)] + [("b", float(v)) for v in rng.normal(1, 3, 700)] + [("c", 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "arm string, x double").repartition(6)
    run = lambda d, block: d.first() if (d := stats.bootstrap_mean_difference(d, "arm", "x", "a", "b", 7, 800, block=block)) else None
    many, again, one = run(df, 64), run(df.repartition(2), 64), run(df, 10_000)
    np.testing.assert_allclose(tuple(many), tuple(again), rtol=1e-12)
    a, b = (np.array([v for k, v in rows if k == name and v is not None]) for name in "ab")
    spread = np.sqrt(a.var() / len(a) + b.var() / len(b))
    for got in (many, one):
        assert abs(got["effect"] - (b.mean() - a.mean())) < 1e-9 and got["resamples"] == 800
        assert abs(got["low"] - (got["effect"] - 1.96 * spread)) < 0.3 * spread and abs(got["high"] - (got["effect"] + 1.96 * spread)) < 0.3 * spread


def test_draws_are_shared_whole():
    counts = np.full(50, 1000)
    parts = [stats._shared(counts, b, 7, (10, 65), 3, 1) for b in range(7)]
    assert (sum(parts) == 1000).all()
    means = [p.mean() for p in parts]
    assert all(abs(m - 1000 * size / 65) < 12 for m, size in zip(means, [10] * 6 + [5], strict=True))
