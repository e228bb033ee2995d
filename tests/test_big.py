"""Integers and rationals of any size against Python's."""

import math
import random
from fractions import Fraction

import pytest
from orrery.functions import big as B
from pyspark.sql import functions as F

random.seed(7)


def cut(a, b):
    q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    return q, a - q * b


def numbers():
    out = [0, 1, -1, 10**9, 10**9 - 1, -(10**18), 10**18 - 1, 10**27, 999_999_999 * 10**9, 2**64, -(2**127), 10**200, 10**200 - 1]
    return out + [random.choice([1, -1]) * random.randrange(10 ** random.choice([1, 8, 9, 10, 18, 19, 30, 60, 200])) for _ in range(40)]


@pytest.fixture(scope="module")
def pairs(spark):
    values = numbers()
    both = [(a, b) for a in values[:13] for b in values[:13]] + [(random.choice(values), random.choice(values)) for _ in range(150)]
    # quotients whose first estimate is one too large
    both += [(10**27 - 1, 10**18 - 1), (10**36 - 1, (10**9 - 1) * 10**9 + 10**9 - 1), (10**45 - 10**18, 10**36 - 1), ((10**9 - 1) * 10**36, 10**27 + 10**9 - 1), (10**36, 10**27 - 1)]
    frame = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(both)], "i int, x string, y string")
    return both, frame.repartition(4).select("i", B.parse(F.col("x")).alias("a"), B.parse(F.col("y")).alias("b")).cache()


def test_ring(pairs):
    both, df = pairs
    a, b = F.col("a"), F.col("b")
    made = df.select("i", a.alias("said"), B.add(a, b).alias("added"), B.subtract(a, b).alias("taken"), B.multiply(a, b).alias("times"), B.multiply(a, b, 2).alias("halved"), B.power(b, 3).alias("cube"), B.magnitude(a).alias("size"), B.compare(a, b).alias("order"))
    got = made.select("i", "order", *[B.text(F.col(c)).alias(c) for c in ("said", "added", "taken", "times", "halved", "cube", "size")])
    for r in got.collect():
        x, y = both[r["i"]]
        assert (int(r["said"]), int(r["added"]), int(r["taken"]), int(r["times"]), int(r["halved"]), int(r["cube"]), int(r["size"])) == (x, x + y, x - y, x * y, x * y, y**3, abs(x))
        assert r["order"] == (x > y) - (x < y) and r["said"] == str(x)


def test_division(pairs):
    both, df = pairs
    got = df.where("b.sign <> 0").select("i", B.divide(F.col("a"), F.col("b")).alias("d")).select("i", B.text(F.col("d.quotient")).alias("q"), B.text(F.col("d.rest")).alias("r"))
    rows = got.collect()
    assert len(rows) == sum(y != 0 for _, y in both)
    for r in rows:
        assert (int(r["q"]), int(r["r"])) == cut(*both[r["i"]]), both[r["i"]]


def test_gcd(pairs):
    both, df = pairs
    for r in df.where("i % 3 = 0").select("i", B.text(B.gcd(F.col("a"), F.col("b"))).alias("g")).collect():
        assert int(r["g"]) == math.gcd(*both[r["i"]])


def test_rationals(pairs):
    both, df = pairs
    some = df.where("b.sign <> 0 AND i % 6 = 0").select("i", B.rational(F.col("a"), F.col("b")).alias("r"), B.rational(B.add(F.col("b"), B.of(F.lit(1))), B.magnitude(F.col("b"))).alias("s"))
    r, s = F.col("r"), F.col("s")
    made = some.select("i", r.alias("said"), B.rational_add(r, s).alias("added"), B.rational_sub(r, s).alias("taken"), B.rational_mul(r, s).alias("times"), B.rational_neg(r).alias("negated"), B.rational_compare(r, s).alias("order"))
    names = ["said", "added", "taken", "times", "negated"]
    for row in B.reduced(made, *names).select("i", "order", *[B.rational_text(F.col(c)).alias(c) for c in names]).collect():
        x, y = both[row["i"]]
        a, b = Fraction(x, y), Fraction(y + 1, abs(y))
        assert [row[k] for k in (*names, "order")] == [str(a), str(a + b), str(a - b), str(a * b), str(-a), (a > b) - (a < b)]
    over = B.reduced(some.where("s.num.sign <> 0").select("i", B.rational_div(r, s).alias("over")), "over").select("i", B.rational_text(F.col("over")).alias("over"))
    for row in over.collect():
        x, y = both[row["i"]]
        assert row["over"] == str(Fraction(x, y) / Fraction(y + 1, abs(y)))


def test_sums_past_32_digits(spark):
    whole = lambda v: B.parse(F.lit(str(v)))
    for a, b, c, d in [(1, 10**20 + 39, 1, 10**19 + 51), (10**35 + 1, 1, 1, 3)]:
        df = spark.range(1).select(B.rational(whole(a), whole(b)).alias("x"), B.rational(whole(c), whole(d)).alias("y")).select(B.rational_add(F.col("x"), F.col("y")).alias("z"))
        assert B.reduced(df, "z").select(B.rational_text(F.col("z"))).first()[0] == str(Fraction(a, b) + Fraction(c, d))


def test_long_products(spark):
    x, y = random.randrange(10**5000), random.randrange(10**4000)
    df = spark.createDataFrame([(B_text(x), B_text(y))], "x string, y string").select(B.parse(F.col("x")).alias("a"), B.parse(F.col("y")).alias("b"))
    made = df.select(B.multiply(F.col("a"), F.col("b")).alias("plain"), B.multiply(F.col("a"), F.col("b"), 3).alias("halved"))
    plain, halved = made.select(B.text(F.col("plain")), B.text(F.col("halved"))).first()
    assert plain == halved == B_text(x * y)


def B_text(n):
    """str(n) past Python's limit of digits."""
    parts = []
    while n:
        n, low = divmod(n, 10**4000)
        parts.append(str(low))
    return parts[-1] + "".join(p.zfill(4000) for p in reversed(parts[:-1]))


def test_totals(spark):
    rows = [(k % 4, str(v)) for k, v in enumerate(numbers())] + [(9, None), (5, "5"), (5, str(-(10**50))), (6, "7"), (6, "-7"), (None, "3"), (None, None)]
    df = spark.createDataFrame(rows, "k int, v string")
    got = {r["k"]: r["t"] for r in B.total(df.select("k", B.parse(F.col("v")).alias("v")), ["k"], F.col("v")).select("k", B.text(F.col("total")).alias("t")).collect()}
    want = {}
    for k, v in rows:
        want[k] = want.get(k, 0) + int(v or 0)
    assert got == {k: str(v) for k, v in want.items()}


def test_what_raises_and_nulls(spark):
    one = spark.range(1)
    for bad, say in ((B.parse(F.lit("1.5")), "not an integer"), (B.parse(F.lit("")), "not an integer"), (B.divide(B.of(F.lit(1)), B.of(F.lit(0))), "division by zero"), (B.rational(B.of(F.lit(1)), B.of(F.lit(0))), "zero denominator"), (B.parse(F.lit("1" + "0" * 90_000)), "more than 262144 bits"), (B.multiply(B.parse(F.lit("1" + "0" * 60), 128), B.of(F.lit(1))), "more than 128 bits")):
        with pytest.raises(Exception, match=say):
            one.select(bad.alias("x")).collect()
    null, three = B.parse(F.lit(None).cast("string")), B.of(F.lit(3))
    got = one.select(null, B.add(null, three), B.multiply(three, null), B.divide(three, null), B.gcd(null, three), B.rational(three, null), B.text(null), B.negate(null), B.compare(null, three), B.text(B.parse(F.lit("+007"))), B.text(B.parse(F.lit("-0"))), B.text(B.power(three, 0))).first()
    assert list(got) == [None] * 9 + ["7", "0", "1"]
    with pytest.raises(ValueError, match="negative exponent"):
        B.power(three, -1)
