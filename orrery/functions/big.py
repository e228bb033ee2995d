"""Integers and rationals of any size as Columns: arrays of limbs, with carries in higher-order functions.

An integer is struct(sign, limbs): sign -1, 0 or 1, limbs below `BASE`, the lowest first, none of them zero at the top (zero has no limbs).
A rational is struct(num, den) of two integers in lowest terms with den > 0. Numbers past `most_bits` (by default 262144) raise, as do
zero divisors and texts that are no integers; a null operand gives null.

Each `select` can hold several of these one inside the other, but not any number: the analyzer stops after 100 passes, and a call takes
20 to 50 of them. Put steps into selects of their own.

A product of two limbs is split into its lower and upper half before it is summed, so that columns of any height stay within 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.arrays import let

DIGITS = 9
BASE = 10**DIGITS
LIMBS = "array<bigint>"
BIG = f"struct<sign:int,limbs:{LIMBS}>"
MOST_BITS = 262_144
WIDE = "decimal(38,0)"
#: Euclid's algorithm takes at most this many steps a limb of the smaller number (Lamé), and two more.
STEPS_A_LIMB = 44


def _none() -> Column:
    return F.array().cast(LIMBS)


def _count(first: Column | int, last: Column) -> Column:
    """first … last; empty if last < first."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def _trimmed(limbs: Column) -> Column:
    used = lambda x: F.coalesce(F.array_max(F.transform(x, lambda v, i: F.when(v != 0, i + 1))), F.lit(0))
    return let(lambda x: F.slice(x, F.lit(1), used(x)), limbs)


def _carried(columns: Column) -> Column:
    """struct(limbs, carry): columns of any size and sign brought below BASE; a negative total leaves a negative carry."""
    start = F.struct(_none().alias("limbs"), F.lit(0).cast("bigint").alias("carry"))

    def step(state: Column, column: Column) -> Column:
        lower = F.pmod(state["carry"] + column, F.lit(BASE))
        return F.struct(F.array_append(state["limbs"], lower).alias("limbs"), _div(state["carry"] + column - lower, BASE).alias("carry"))

    return F.aggregate(columns, start, step)


def _closed(columns: Column) -> Column:
    """Limbs of non-negative columns, the carry among them."""
    ended = lambda s: F.when(s["carry"] < BASE, F.array_append(s["limbs"], s["carry"])).otherwise(F.concat(s["limbs"], F.array(F.pmod(s["carry"], F.lit(BASE)), _div(s["carry"], BASE))))
    return _trimmed(let(ended, _carried(columns)))


def _plus(a: Column, b: Column) -> Column:
    return _closed(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))


def _minus(a: Column, b: Column) -> Column:
    """Of a >= b."""
    return _trimmed(_carried(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))["limbs"])


def _order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: arrays of one length compare from their first element on."""
    more, less = F.reverse(a), F.reverse(b)
    return F.when(F.size(a) < F.size(b), -1).when(F.size(a) > F.size(b), 1).when(less > more, -1).when(more > less, 1).otherwise(0)


def _columns(a: Column, b: Column, levels: int) -> Column:
    """Columns of a product, not carried yet: by the schoolbook, below `levels` of Karatsuba's three products of halves."""

    def schoolbook(a: Column, b: Column) -> Column:
        def column(k: Column, half) -> Column:
            first, last = F.greatest(F.lit(0), k - F.size(b) + 1), F.least(k, F.size(a) - 1)
            return F.aggregate(_count(first, last), F.lit(0).cast("bigint"), lambda s, i: s + half(a[i] * b[k - i]))

        # a column takes the lower halves of its own products and the upper halves of those of the column below
        return F.transform(_count(0, F.size(a) + F.size(b) - 1), lambda k: column(k, lambda p: p % BASE) + column(k - 1, lambda p: _div(p, BASE)))

    def halved(a: Column, b: Column, h: Column) -> Column:
        low, high = (lambda x: F.slice(x, F.lit(1), h)), (lambda x: F.slice(x, h + 1, F.greatest(F.size(x) - h, F.lit(0))))
        # sums of halves are below 2 BASE, whose products still fit; further down they must be carried
        both = lambda x: _plus(low(x), high(x)) if levels > 1 else F.zip_with(low(x), high(x), lambda u, v: F.coalesce(u, F.lit(0)) + F.coalesce(v, F.lit(0)))

        def joined(lows: Column, highs: Column, crossed: Column) -> Column:
            at = lambda x, k: F.when(k >= 0, F.coalesce(F.get(x, k), F.lit(0))).otherwise(0)
            return F.transform(_count(0, F.size(a) + F.size(b) + 3), lambda k: at(lows, k) + at(highs, k - 2 * h) + at(crossed, k - h) - at(lows, k - h) - at(highs, k - h))

        return let(joined, _columns(low(a), low(b), levels - 1), _columns(high(a), high(b), levels - 1), _columns(both(a), both(b), levels - 1))

    if not levels:
        return let(schoolbook, a, b)
    larger = F.greatest(F.size(a), F.size(b)) + 1
    return let(lambda a, b, h: F.when(F.least(F.size(a), F.size(b)) < 8, schoolbook(a, b)).otherwise(halved(a, b, h)), a, b, F.floor(larger / 2).cast("int"))


def _times(a: Column, b: Column, levels: int) -> Column:
    return _closed(_columns(a, b, levels))


def _divided(a: Column, b: Column) -> Column:
    """struct(quotient, rest) of limbs, b without top zeros and not empty: long division by estimates from three limbs over two, which
    are never too small and at most one too large."""

    def long_division(a: Column, b: Column) -> Column:
        n = F.size(b)
        start = F.struct(F.array_append(F.slice(a, F.size(a) - n + 2, n - 1), F.lit(0).cast("bigint")).alias("rest"), _none().alias("quotient"))
        leading = b[n - 1] * BASE + b[n - 2]

        def step(state: Column, limb: Column) -> Column:
            def taken(rest: Column) -> Column:
                top = (rest[n].cast(WIDE) * F.lit(BASE**2).cast(WIDE)).cast(WIDE) + (rest[n - 1] * BASE + rest[n - 2]).cast(WIDE)
                guess = F.least(_div(top.cast(WIDE), leading.cast(WIDE)), F.lit(BASE - 1))

                def corrected(q: Column) -> Column:
                    left = _carried(F.transform(rest, lambda x, i: x - q * F.coalesce(F.get(b, i), F.lit(0))))
                    again = lambda s: _carried(F.transform(s["limbs"], lambda x, i: x + F.coalesce(F.get(b, i), F.lit(0))))["limbs"]
                    made = lambda limbs, q: F.struct(F.slice(limbs, F.lit(1), n).alias("rest"), F.array_append(state["quotient"], q).alias("quotient"))
                    return let(lambda s: F.when(s["carry"] < 0, made(again(s), q - 1)).otherwise(made(s["limbs"], q)), left)

                return let(corrected, guess)

            return let(taken, F.concat(F.array(limb), state["rest"]))

        ended = F.aggregate(F.reverse(F.slice(a, F.lit(1), F.size(a) - n + 1)), start, step)
        return let(lambda s: F.struct(_trimmed(F.reverse(s["quotient"])).alias("quotient"), _trimmed(s["rest"]).alias("rest")), ended)

    def whole(a: Column, b: Column) -> Column:
        zero = lambda x: F.concat(F.array(F.lit(0).cast("bigint")), x)
        # a divisor of one limb: both get a zero below, which the rest gives back
        one = let(lambda s: F.struct(s["quotient"].alias("quotient"), F.slice(s["rest"], F.lit(2), F.greatest(F.size(s["rest"]) - 1, F.lit(0))).alias("rest")), let(long_division, zero(a), zero(b)))
        short = F.struct(_none().alias("quotient"), a.alias("rest"))
        return F.when(F.size(a) < F.size(b), short).when(F.size(b) == 1, one).otherwise(long_division(a, b))

    return let(whole, a, b)


def _made(sign: Column, limbs: Column, most_bits: int = MOST_BITS) -> Column:
    most = most_bits * 1000 // 3322 // DIGITS + 1
    checked = lambda x: F.when(F.size(x) > most, F.raise_error(F.lit(f"an integer of more than {most_bits} bits")).cast(LIMBS)).otherwise(x)
    return let(lambda s, x: F.when(s.isNotNull() & x.isNotNull(), F.struct(F.when(F.size(x) == 0, 0).otherwise(s).cast("int").alias("sign"), checked(x).alias("limbs"))), sign, limbs)


def parse(text: Column, most_bits: int = MOST_BITS) -> Column:
    """'-12345678901234567890' of any length; raises on anything else."""

    def limbs(digits: Column) -> Column:
        n = F.ceil(F.length(digits) / DIGITS).cast("int")
        piece = lambda i: F.substring(digits, F.greatest(F.length(digits) - (i + 1) * DIGITS + 1, F.lit(1)), F.least(F.lit(DIGITS), F.length(digits) - i * DIGITS))
        return _trimmed(F.transform(_count(0, n - 1), lambda i: piece(i).cast("bigint")))

    bad = F.raise_error(F.concat(F.lit("not an integer: "), F.substring(text, 1, 40))).cast(BIG)
    good = F.regexp_like(text, F.lit("^[+-]?[0-9]+$"))
    form = _made(F.when(F.substring(text, 1, 1) == "-", -1).otherwise(1), limbs(F.regexp_replace(text, "^[+-]", "")), most_bits)
    return F.when(text.isNotNull(), F.when(good, form).otherwise(bad))


def of(c: Column) -> Column:
    """From an integer or decimal column."""
    return parse(c.cast("string"))


def text(a: Column) -> Column:
    said = lambda x: F.concat(F.when(x["sign"] < 0, "-").otherwise(""), F.array_join(F.transform(F.reverse(x["limbs"]), lambda v, i: F.when(i == 0, v.cast("string")).otherwise(F.lpad(v.cast("string"), DIGITS, "0"))), ""))
    return let(lambda x: F.when(x["sign"] == 0, "0").otherwise(said(x)), a)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return let(lambda x, y: F.when(x["sign"] != y["sign"], F.signum(x["sign"] - y["sign"]).cast("int")).otherwise(x["sign"] * _order(x["limbs"], y["limbs"])), a, b)


def negate(a: Column) -> Column:
    return let(lambda x: F.when(x.isNotNull(), F.struct((-x["sign"]).alias("sign"), x["limbs"].alias("limbs"))), a)


def magnitude(a: Column) -> Column:
    return let(lambda x: F.when(x.isNotNull(), F.struct(F.abs(x["sign"]).alias("sign"), x["limbs"].alias("limbs"))), a)


def add(a: Column, b: Column) -> Column:
    def mixed(x: Column, y: Column) -> Column:
        first, second = (x["sign"], x["limbs"]), (y["sign"], y["limbs"])
        order = _order(first[1], second[1])
        apart = F.when(order >= 0, F.struct(first[0].alias("sign"), _minus(first[1], second[1]).alias("limbs"))).otherwise(F.struct(second[0].alias("sign"), _minus(second[1], first[1]).alias("limbs")))
        return F.when(first[0] == 0, y).when(second[0] == 0, x).when(first[0] == second[0], F.struct(first[0].alias("sign"), _plus(first[1], second[1]).alias("limbs"))).otherwise(apart)

    return let(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), let(lambda s: _made(s["sign"], s["limbs"]), mixed(x, y))), a, b)


def subtract(a: Column, b: Column) -> Column:
    return add(a, negate(b))


def multiply(a: Column, b: Column, levels: int = 0) -> Column:
    """`levels`: of Karatsuba's method, for numbers of thousands of digits."""
    return let(lambda x, y: _made(x["sign"] * y["sign"], _times(x["limbs"], y["limbs"], levels)), a, b)


def divide(a: Column, b: Column) -> Column:
    """struct(quotient, rest): the quotient cut towards zero, the rest with the sign of `a`; raises on a zero divisor."""

    def signed(x: Column, y: Column) -> Column:
        zero = F.raise_error(F.lit("division by zero")).cast(f"struct<quotient:{LIMBS},rest:{LIMBS}>")
        parts = F.when(y["sign"] == 0, zero).otherwise(_divided(x["limbs"], y["limbs"]))
        named = lambda s: F.struct(_made(x["sign"] * y["sign"], s["quotient"]).alias("quotient"), _made(x["sign"], s["rest"]).alias("rest"))
        return F.when(x.isNotNull() & y.isNotNull(), let(named, parts))

    return let(signed, a, b)


def power(a: Column, n: int, levels: int = 0) -> Column:
    """By squaring; raises for negative n."""
    if n < 0:
        raise ValueError("negative exponent of an integer")

    def raised(x: Column, n: int) -> Column:
        if n == 1:
            return x
        square = let(lambda h: multiply(h, h, levels), raised(x, n // 2))
        return multiply(square, x, levels) if n % 2 else square

    return let(lambda x: F.when(x.isNotNull(), of(F.lit(1))) if n == 0 else raised(x, n), a)


def gcd(a: Column, b: Column) -> Column:
    """By Euclid's algorithm on limbs; at most Lamé's number of steps, of which those after the end cost nothing."""

    def euclid(x: Column, y: Column) -> Column:
        start = F.struct(x["limbs"].alias("a"), y["limbs"].alias("b"))
        step = lambda s, _: F.when(F.size(s["b"]) == 0, s).otherwise(F.struct(s["b"].alias("a"), _divided(s["a"], s["b"])["rest"].alias("b")))
        steps = STEPS_A_LIMB * F.least(F.size(x["limbs"]), F.size(y["limbs"])) + 2
        return F.when(x.isNotNull() & y.isNotNull(), _made(F.lit(1), F.aggregate(F.sequence(F.lit(1), steps), start, step)["a"]))

    return let(euclid, a, b)


def total(df: DataFrame, keys: list[str], value: Column, name: str = "total") -> DataFrame:
    """Sum of big integers a group: limbs are summed by place, which combines before the shuffle, then carried. 2**33 rows a group at
    most; a group without values sums to zero."""
    placed = df.select(*keys, value.alias("_v")).select(*keys, F.col("_v.sign").alias("_sign"), F.posexplode_outer("_v.limbs").alias("_place", "_limb"))
    by_place = placed.groupBy(*keys, "_place").agg(F.sum(F.coalesce(F.col("_limb") * F.col("_sign"), F.lit(0))).alias("_sum"))
    lists = by_place.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("_place").isNotNull(), F.struct("_place", "_sum")))).alias("_parts"))

    def summed(parts: Column) -> Column:
        columns = F.transform(parts, lambda p: p["_sum"])
        down = lambda s: F.when(s["carry"] < 0, F.struct(F.lit(-1).alias("sign"), _closed(F.transform(columns, lambda x: -x)).alias("limbs"))).otherwise(F.struct(F.lit(1).alias("sign"), _closed(columns).alias("limbs")))
        return let(lambda s: _made(s["sign"], s["limbs"]), let(down, _carried(columns)))

    return lists.select(*keys, let(summed, F.col("_parts")).alias(name))


# ---- rationals


def rational(num: Column, den: Column) -> Column:
    """In lowest terms; raises on a zero denominator."""

    def reduced(n: Column, d: Column) -> Column:
        return F.when(n.isNotNull() & d.isNotNull(), let(lambda g: _over(n, d, g), _common(n, d)))

    return let(reduced, num, den)


def _common(num: Column, den: Column) -> Column:
    """The greatest common divisor with the sign of `den`."""
    signed = lambda g, d: F.when(g.isNotNull(), F.struct(d["sign"].alias("sign"), g["limbs"].alias("limbs")))
    return F.when(den["sign"] == 0, F.raise_error(F.lit("zero denominator")).cast(BIG)).otherwise(let(signed, gcd(num, den), den))


def _over(num: Column, den: Column, common: Column) -> Column:
    parts = F.struct(divide(num, common)["quotient"].alias("num"), divide(den, common)["quotient"].alias("den"))
    return F.when(common.isNotNull(), parts)


def reduced(df: DataFrame, *names: str) -> DataFrame:
    """`df` with the rationals of these columns in lowest terms, denominators positive. In two steps of their own, as the analyzer
    goes through a fixed number of nested expressions only."""
    common = df.withColumns({f"_common_{n}": _common(F.col(n)["num"], F.col(n)["den"]) for n in names})
    return common.withColumns({n: _over(F.col(n)["num"], F.col(n)["den"], F.col(f"_common_{n}")) for n in names}).select(*df.columns)


def _pair(num: Column, den: Column) -> Column:
    return let(lambda n, d: F.when(n.isNotNull() & d.isNotNull(), F.struct(n.alias("num"), d.alias("den"))), num, den)


def rational_add(a: Column, b: Column) -> Column:
    """Like the other operations on rationals not in lowest terms: see `reduced`."""
    return _pair(add(multiply(a["num"], b["den"]), multiply(b["num"], a["den"])), multiply(a["den"], b["den"]))


def rational_sub(a: Column, b: Column) -> Column:
    return _pair(subtract(multiply(a["num"], b["den"]), multiply(b["num"], a["den"])), multiply(a["den"], b["den"]))


def rational_mul(a: Column, b: Column) -> Column:
    return _pair(multiply(a["num"], b["num"]), multiply(a["den"], b["den"]))


def rational_div(a: Column, b: Column) -> Column:
    return _pair(multiply(a["num"], b["den"]), multiply(a["den"], b["num"]))


def rational_neg(a: Column) -> Column:
    return _pair(negate(a["num"]), a["den"])


def rational_compare(a: Column, b: Column) -> Column:
    """Of rationals with positive denominators."""
    return compare(multiply(a["num"], b["den"]), multiply(b["num"], a["den"]))


def rational_text(a: Column) -> Column:
    one = lambda x: (F.size(x["den"]["limbs"]) == 1) & (x["den"]["limbs"][0] == 1)
    return let(lambda x: F.when(one(x), text(x["num"])).otherwise(F.concat_ws("/", text(x["num"]), text(x["den"]))), a)
