"""Quotients of 38 digits, continued fractions near integers, sums of tight denominators, signs of zeros."""

from fractions import Fraction

import pytest
from orrery.functions import scalar as S
from pyspark.sql import functions as F


def wide(n):
    return F.lit(str(n)).cast(S.WIDE)


def test_quotients(spark):
    cases = [(a, b) for a in (10**38 - 1, -(10**38) + 1, 10**35 + 1, 7, -7, 0, 2**63, 10**19) for b in (1, -1, 2, 3, -3, 999_999, 10**7, 10**18 + 9, 10**37 + 1)]
    got = spark.range(1).select(*[S.quotient(wide(a), wide(b)).alias(f"q{i}") for i, (a, b) in enumerate(cases)]).first()
    assert [int(x) for x in got] == [a // b for a, b in cases]


@pytest.mark.parametrize("num, den, want", [(9999999, 10000000, [0, 1, 9999999]), (19999999, 10000000, [1, 1, 9999999]), (2999999999, 1000000000, [2, 1, 999999999]), (10**37 - 1, 10**37, [0, 1, 10**37 - 1]), (-7, 3, [-3, 1, 2]), (5, 1, [5])])
def test_fraction_coefficients(spark, num, den, want):
    got = spark.range(1).select(S.fraction_coefficients(wide(num), wide(den))).first()[0]
    assert [int(x) for x in got] == want


def test_rationals_of_38_digits(spark):
    r = lambda a, b: S.rational(wide(a), wide(b))
    cases = [(r(10**35 + 1, 1), Fraction(10**35 + 1)), (r(-(10**37), 10**30), Fraction(-(10**7))), (r(10**38 - 1, -(10**38 - 3)), Fraction(10**38 - 1, -(10**38) + 3)), (S.rational_add(r(1, 10**18 + 9), r(1, 2 * (10**18 + 9))), Fraction(3, 2 * (10**18 + 9))), (S.rational_sub(r(10**36, 7), r(1, 7)), Fraction(10**36 - 1, 7))]
    got = spark.range(1).select(*[S.rational_text(c).alias(f"r{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(got) == [str(x) for _, x in cases]


def test_negative_zero(spark):
    z = S.complex_of(F.lit(-0.0), F.lit(-0.0))
    assert spark.range(1).select(S.complex_text(z)).first()[0] == "0.0+0.0i"
