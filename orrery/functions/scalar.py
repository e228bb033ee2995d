"""Scalar arithmetic over integers that widen, rationals, complex numbers, floats and booleans, as Column expressions.

Integers are widened to DECIMAL(38,0) before they are combined, so no result within 38 digits overflows; beyond, Spark raises.
A rational is struct(num, den) in lowest terms with den > 0; a complex number is struct(re, im).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
#: Steps that Euclid's algorithm may need for numbers of 38 digits.
EUCLID = 185
SOON = 16


def wide(c: Column) -> Column:
    return c.cast(WIDE)


def fold(op, first: Column, *rest: Column) -> Column:
    return reduce(op, rest, first)


def add(*c: Column) -> Column:
    return fold(lambda a, b: (a + b).cast(WIDE), *map(wide, c))


def sub(*c: Column) -> Column:
    return fold(lambda a, b: (a - b).cast(WIDE), *map(wide, c))


def mul(*c: Column) -> Column:
    return fold(lambda a, b: (a * b).cast(WIDE), *map(wide, c))


def neg(c: Column) -> Column:
    """A product, as Spark's unary minus (and abs) keep 34 digits of a decimal only."""
    return (wide(c) * F.lit(-1)).cast(WIDE)


def size(c: Column) -> Column:
    return F.when(wide(c) < 0, neg(c)).otherwise(wide(c))


def rem(a: Column, b: Column) -> Column:
    """Truncating remainder, sign of the dividend; raises on 0."""
    return wide(a) % wide(b)


def power(a: Column, n: Column) -> Column:
    """Exact, for integers n >= 0; raises for negative n."""
    times = F.when(n < 0, F.raise_error(F.lit("negative exponent of an integer")).cast("int")).otherwise(n.cast("int"))
    ones = F.when(times == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), times))
    return F.aggregate(ones, F.lit(1).cast(WIDE), lambda acc, _: (acc * wide(a)).cast(WIDE))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; raises on NaN."""
    nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return F.when(nan, F.raise_error(F.lit("NaN has no order")).cast("int")).when(a < b, -1).when(a == b, 0).otherwise(1)


def product(values: Column) -> Column:
    """Exact product of an array; 1 if it is empty."""
    return F.aggregate(values, F.lit(1).cast(WIDE), lambda acc, x: (acc * wide(x)).cast(WIDE))


def divide(a: Column, b: Column) -> Column:
    """Float division by the IEEE rules: x / 0 is an infinity or NaN."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


# ---- rationals


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps, in 64 bits where both numbers fit (short decimals otherwise take most of the time)."""
    return F.when(fits(a, b), _euclid(F.abs(a.cast("bigint")), F.abs(b.cast("bigint")), "bigint").cast(WIDE)).otherwise(_euclid(size(a), size(b), WIDE))


#: The greatest number of 64 bits whose negative has 64 bits too.
MOST = 2**63 - 1


def fits(*c: Column) -> Column:
    """Whether the numbers' sizes are within 64 bits."""
    return reduce(Column.__and__, [x.between(-MOST, MOST) for x in c])


def _euclid(a: Column, b: Column, kind: str) -> Column:
    """Of numbers that are not negative."""
    pair = F.struct(a.cast(kind).alias("a"), b.cast(kind).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).cast(kind).alias("b")))
    run = lambda p, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), p, step)
    # most pairs are done after few steps; the others go on
    return F.transform(F.array(run(pair, SOON)), lambda p: F.when(p["b"] == 0, p["a"]).otherwise(run(p, EUCLID - SOON)["a"]))[0]


#: Divisors from which on a quotient of 38 digits has at most 32, as many as Spark's division of such decimals keeps before the point.
LONG_DIVISOR = 10**7


def exact_quotient(a: Column, b: Column) -> Column:
    """a / b for a multiple a of b, for all of 38 digits, without a lambda of its own (the analyzer goes through a limited number)."""
    a, b, most, unit = wide(a), wide(b), 2**63 - 1, F.lit("1" + "0" * 19).cast(WIDE)
    ratio = lambda x, y: (x / y).cast(WIDE)
    high, low = ratio(a - a % unit, unit), a % unit  # short divisors take the number in two parts
    rest = high % b
    parts = (ratio(high - rest, b) * unit).cast(WIDE) + ratio((rest * unit).cast(WIDE) + low, b)
    fits = a.between(-most, most) & b.between(-most, most)
    return F.when(fits, F.call_function("div", a.cast("bigint"), b.cast("bigint")).cast(WIDE)).when((b >= LONG_DIVISOR) | (b <= -LONG_DIVISOR), ratio(a, b)).otherwise(parts.cast(WIDE))


def quotient(a: Column, b: Column) -> Column:
    """floor(a / b) exactly, for all of 38 digits; null for b = 0."""
    a, b = wide(a), wide(b)
    rest = a % b
    below = F.when((rest != 0) & ((rest < 0) != (b < 0)), 1).otherwise(0)
    return F.when(b != 0, (exact_quotient(a - rest, b) - below).cast(WIDE))


def rational(num: Column, den: Column) -> Column:
    """In lowest terms; raises on den = 0."""

    def lowest(n: Column, d: Column, kind: str, over) -> Column:
        """In 64 bits or decimals throughout."""
        steps = _euclid(F.abs(n), F.abs(d), kind) if kind == "bigint" else _euclid(size(n), size(d), kind)
        common = F.when(d == 0, F.raise_error(F.lit("zero denominator")).cast(kind)).otherwise(steps) * F.when(d < 0, -1).otherwise(1)
        return F.transform(F.array(common.cast(kind)), lambda g: F.struct(over(n, g).cast(WIDE).alias("num"), over(d, g).cast(WIDE).alias("den")))[0]

    def reduced(s: Column) -> Column:
        short = lowest(s["num"].cast("bigint"), s["den"].cast("bigint"), "bigint", lambda x, g: F.call_function("div", x, g))
        return F.when(fits(s["num"], s["den"]), short).otherwise(lowest(s["num"], s["den"], WIDE, exact_quotient))

    return F.transform(F.array(F.struct(wide(num).alias("num"), wide(den).alias("den"))), reduced)[0]  # evaluates both once


DECIMAL = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"


def rational_of(text: Column) -> Column:
    """'6/8', '5', '0.5' or '-1.4/2', exactly (decimals are digits over a power of ten); raises on anything else and on a zero denominator."""
    parts = F.split(F.trim(text), "/")
    good = (F.size(parts) <= 2) & F.forall(parts, lambda p: F.regexp_like(F.trim(p), F.lit(DECIMAL)))

    def number(part: Column) -> tuple[Column, Column]:
        part = F.trim(part)
        places = F.length(F.regexp_extract(part, r"\.([0-9]*)$", 1))
        return wide(F.translate(part, ".", "")), wide(F.concat(F.lit("1"), F.repeat(F.lit("0"), places)))

    top, top_unit = number(parts[0])
    low, low_unit = number(F.coalesce(F.get(parts, F.lit(1)), F.lit("1")))
    form = rational((top * low_unit).cast(WIDE), (low * top_unit).cast(WIDE))
    bad = F.raise_error(F.concat(F.lit("not a rational: "), text)).cast(f"struct<num:{WIDE},den:{WIDE}>")
    return F.when(text.isNotNull(), F.when(good, form).otherwise(bad))


def rational_add(a: Column, b: Column) -> Column:
    """Like all of these within 38 digits before it is reduced; `functions.big` goes on from there."""
    return rational(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def rational_sub(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"])


def rational_mul(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["num"], a["den"] * b["den"])


def rational_div(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"], a["den"] * b["num"])


def rational_power(a: Column, n: int) -> Column:
    top, bottom = (a["num"], a["den"]) if n >= 0 else (a["den"], a["num"])
    return rational(power(top, F.lit(abs(n))), power(bottom, F.lit(abs(n))))


def rational_neg(a: Column) -> Column:
    return F.struct(neg(a["num"]).alias("num"), a["den"].alias("den"))


def rational_text(a: Column) -> Column:
    said = lambda r: F.when(r["den"] == 1, r["num"].cast("string")).otherwise(F.concat_ws("/", r["num"].cast("string"), r["den"].cast("string")))
    return F.transform(F.array(a), said)[0]  # evaluates `a` once


def rational_value(a: Column) -> Column:
    return a["num"].cast("double") / a["den"].cast("double")


# ---- complex numbers


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def complex_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def complex_sub(a: Column, b: Column) -> Column:
    return complex_of(a["re"] - b["re"], a["im"] - b["im"])


def complex_mul(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_div(a: Column, b: Column) -> Column:
    size = b["re"] * b["re"] + b["im"] * b["im"]
    return complex_of(divide(a["re"] * b["re"] + a["im"] * b["im"], size), divide(a["im"] * b["re"] - a["re"] * b["im"], size))


def complex_neg(a: Column) -> Column:
    return complex_of(-a["re"], -a["im"])


def complex_abs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


# ---- booleans: add is OR, mul is AND, sub is XOR


def bool_add(a: Column, b: Column) -> Column:
    return a | b


def bool_mul(a: Column, b: Column) -> Column:
    return a & b


def bool_sub(a: Column, b: Column) -> Column:
    return a != b


# ---- continued fractions: arrays of coefficients a0, a1, …


def fraction_value(coefficients: Column) -> Column:
    """a0 + 1 / (a1 + 1 / …), evaluated backwards."""
    back = F.reverse(coefficients)
    rest = F.slice(back, F.lit(2), F.greatest(F.size(back) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(back, 1).cast("double"), lambda acc, x: x.cast("double") + divide(F.lit(1.0), acc))


def fraction_convergent(coefficients: Column) -> Column:
    """The same exactly, as a rational."""
    start = F.struct(F.lit(1).cast(WIDE).alias("h1"), F.lit(0).cast(WIDE).alias("h0"), F.lit(0).cast(WIDE).alias("k1"), F.lit(1).cast(WIDE).alias("k0"))
    step = lambda s, x: F.struct((wide(x) * s["h1"] + s["h0"]).cast(WIDE).alias("h1"), s["h1"].alias("h0"), (wide(x) * s["k1"] + s["k0"]).cast(WIDE).alias("k1"), s["k1"].alias("k0"))
    end = F.aggregate(coefficients, start, step)
    return rational(end["h1"], end["k1"])


def fraction_coefficients(num: Column, den: Column, most: int = 64) -> Column:
    """Coefficients of num / den by Euclid's algorithm, in 64 bits where both numbers fit."""

    def short(a: Column, b: Column) -> Column:
        """floor(a / b); the remainders of numbers of 64 bits have 64 bits."""
        rest = a % b
        return F.call_function("div", a, b) - F.when((rest != 0) & ((rest < 0) != (b < 0)), 1).otherwise(0)

    def euclid(kind: str, over) -> Column:
        start = F.struct(num.cast(kind).alias("a"), den.cast(kind).alias("b"), F.array().cast(f"array<{kind}>").alias("out"))

        def step(s, _):
            taken = lambda whole: F.struct(s["b"].alias("a"), (s["a"] - whole * s["b"]).cast(kind).alias("b"), F.array_append(s["out"], whole).alias("out"))
            return F.when(s["b"] == 0, s).otherwise(F.transform(F.array(over(s["a"], s["b"])), taken)[0])

        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["out"].cast(f"array<{WIDE}>")

    return F.when(fits(wide(num), wide(den)), euclid("bigint", short)).otherwise(euclid(WIDE, quotient))


#: Terms that go on by rule after these first ones (fixed values; the tail of pi is 1 for ever, an approximation).
FRACTION_STARTS = {"sqrt2": [1], "phi": [1], "e": [2], "pi": [3, 7, 15, 1, 292]}


def fraction_constant(name: str, terms: Column) -> Column:
    """The first `terms` coefficients of sqrt2, phi, e or pi; raises below one term."""
    start = FRACTION_STARTS[name]
    later = {
        "sqrt2": lambda i: F.lit(2),
        "e": lambda i: F.when(i % 3 == 1, 2 * F.floor(i / 3) + 2).otherwise(1),
    }.get(name, lambda i: F.lit(1))
    n = F.when(terms < 1, F.raise_error(F.lit("a continued fraction has a first term")).cast("int")).otherwise(terms.cast("int"))
    first = F.array(*map(F.lit, start))
    rest = F.when(n > len(start), F.transform(F.sequence(F.lit(0), n - len(start) - 1), lambda i: later(i).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.slice(first, F.lit(1), F.least(n, F.lit(len(start)))), rest)


COMPLEX = r"^([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)(?:([+-](?:[0-9.]+(?:[eE][+-]?[0-9]+)?)?)i)?$"


def complex_parse(text: Column) -> Column:
    """'1.5-2i', '3+i' or '4'; raises on anything else."""
    said = F.trim(text)
    im = F.regexp_extract(said, COMPLEX, 2)
    form = complex_of(F.regexp_extract(said, COMPLEX, 1), F.when(im == "", "0").when(im.isin("+", "-"), F.concat(im, F.lit("1"))).otherwise(im))
    bad = F.raise_error(F.concat(F.lit("not a complex number: "), text)).cast("struct<re:double,im:double>")
    return F.when(text.isNotNull(), F.when(F.regexp_like(said, F.lit(COMPLEX)), form).otherwise(bad))


def complex_text(a: Column) -> Column:
    """Real part, sign, imaginary part, i; a negative zero is written as zero."""
    re, im = (F.when(a[part] == 0, 0.0).otherwise(a[part]) for part in ("re", "im"))
    return F.concat(re.cast("string"), F.when(im < 0, "").otherwise("+"), im.cast("string"), F.lit("i"))
