"""Tensors as Column expressions: struct(shape array<int>, data array<double>), row-major; built from higher-order functions.

These serve tensors that fit in a row. Larger ones are cell tables (orrery.operators.tensor).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(use: Callable[..., Column], *values: Column) -> Column:
    """`use` of values that are evaluated once each, however often it names them: without this, nested expressions multiply."""
    named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(named), lambda s: use(*[s[f"v{i}"] for i in range(len(values))]))[0]


def tensor(shape: Column, data: Column) -> Column:
    """Raises unless the shape holds as many cells as there are."""

    def checked(shape: Column, data: Column) -> Column:
        cells = F.aggregate(shape, F.lit(1), lambda a, d: a * d)
        good = F.when(cells == F.size(data), shape).otherwise(F.raise_error(F.lit("shape and cells differ")).cast("array<int>"))
        return F.struct(good.alias("shape"), F.transform(data, lambda x: x.cast("double")).alias("data"))

    return let(checked, shape, data)


def vec(data: Column) -> Column:
    return let(lambda d: F.struct(F.array(F.size(d)).alias("shape"), F.transform(d, lambda x: x.cast("double")).alias("data")), data)


def mat(data: Column, rows: int, columns: int) -> Column:
    return tensor(F.array(F.lit(rows), F.lit(columns)), data)


def scalar(c: Column) -> Column:
    return F.struct(F.array().cast("array<int>").alias("shape"), F.array(c.cast("double")).alias("data"))


def zeros(*shape: int) -> Column:
    return full(0.0, *shape)


def ones(*shape: int) -> Column:
    return full(1.0, *shape)


def full(value: float, *shape: int) -> Column:
    n = 1
    for d in shape:
        n *= d
    return F.struct(F.array(*map(F.lit, shape)).alias("shape"), F.array_repeat(F.lit(value), n).alias("data"))


def eye(n: int) -> Column:
    return F.struct(F.array(F.lit(n), F.lit(n)).alias("shape"), F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.when(i % (n + 1) == 0, 1.0).otherwise(0.0)).alias("data"))


def index(t: Column, *at: int) -> Column:
    """One cell; raises outside the bounds."""

    def cell(t: Column) -> Column:
        offset, inside = F.lit(0), F.size(t["shape"]) == len(at)
        for d, i in enumerate(at):
            offset = offset * F.get(t["shape"], F.lit(d)) + i
            inside = inside & (F.lit(i) >= 0) & (F.lit(i) < F.get(t["shape"], F.lit(d)))
        return F.when(inside, F.element_at(t["data"], offset + 1)).otherwise(F.raise_error(F.lit("index out of bounds")).cast("double"))

    return let(cell, t)


def reshape(t: Column, *shape: int) -> Column:
    return tensor(F.array(*map(F.lit, shape)), t["data"])


def block(t: Column, starts: list[int], lengths: list[int]) -> Column:
    """An n-d slice: cells whose every coordinate lies in its range."""
    rank = len(starts)

    def inside(t: Column, i: Column) -> Column:
        ok, rest = F.lit(True), i
        for d in range(rank - 1, -1, -1):
            c = rest % t["shape"][d]
            ok = ok & (c >= starts[d]) & (c < starts[d] + lengths[d])
            rest = F.floor(rest / t["shape"][d]).cast("int")
        return ok

    return let(lambda t: tensor(F.array(*map(F.lit, lengths)), F.filter(t["data"], lambda x, i: inside(t, i))), t)


def each(t: Column, f: Callable[[Column], Column]) -> Column:
    return let(lambda t: F.struct(t["shape"].alias("shape"), F.transform(t["data"], f).alias("data")), t)


def broadcasted(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Element by element, shapes aligned at their last axes; an axis of length 1 repeats. Raises if axes differ otherwise."""

    def padded(t: Column, rank: Column) -> Column:
        return F.concat(F.array_repeat(F.lit(1), rank - F.size(t["shape"])), t["shape"])

    def joined(x: Column, y: Column) -> Column:
        return F.when((x == y) | (y == 1), x).when(x == 1, y).otherwise(F.raise_error(F.lit("shapes don't match")).cast("int"))

    def place(flat: Column, shape: Column, own: Column) -> Column:
        start = F.struct(flat.cast("int").alias("rest"), F.lit(1).alias("stride"), F.lit(0).alias("at"))
        axes = F.reverse(F.zip_with(shape, own, lambda s, o: F.struct(s.alias("s"), o.alias("o"))))
        step = lambda acc, x: F.struct(F.floor(acc["rest"] / x["s"]).cast("int").alias("rest"), (acc["stride"] * x["o"]).alias("stride"), (acc["at"] + F.when(x["o"] == 1, 0).otherwise(acc["rest"] % x["s"]) * acc["stride"]).alias("at"))
        return F.aggregate(axes, start, step)["at"]

    def cells(a: Column, b: Column, pa: Column, pb: Column, shape: Column) -> Column:
        n = F.aggregate(shape, F.lit(1), lambda x, d: x * d)
        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        data = F.transform(every, lambda i: op(F.element_at(a["data"], place(i, shape, pa) + 1), F.element_at(b["data"], place(i, shape, pb) + 1)))
        return F.struct(shape.alias("shape"), data.alias("data"))

    def shaped(a: Column, b: Column) -> Column:
        rank = F.greatest(F.size(a["shape"]), F.size(b["shape"]))
        return let(lambda pa, pb: let(lambda shape: cells(a, b, pa, pb, shape), F.zip_with(pa, pb, joined)), padded(a, rank), padded(b, rank))

    return let(shaped, a, b)


def total(t: Column) -> Column:
    return F.aggregate(t["data"], F.lit(0.0), lambda a, x: a + x)


def _poisoned(t: Column, c: Column) -> Column:
    """NaN if a cell is NaN; raises on an empty tensor."""
    return F.when(F.exists(t["data"], F.isnan), F.lit(float("nan"))).when(F.size(t["data"]) == 0, F.raise_error(F.lit("empty tensor")).cast("double")).otherwise(c)


def least(t: Column) -> Column:
    return let(lambda t: _poisoned(t, F.array_min(t["data"])), t)


def most(t: Column) -> Column:
    return let(lambda t: _poisoned(t, F.array_max(t["data"])), t)


def norm(t: Column) -> Column:
    return F.sqrt(F.aggregate(t["data"], F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    summed = lambda a, b: F.aggregate(F.zip_with(a["data"], b["data"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return let(lambda a, b: F.when(a["shape"] == b["shape"], summed(a, b)).otherwise(F.raise_error(F.lit("lengths differ")).cast("double")), a, b)


def matmul(a: Column, b: Column) -> Column:
    """Of two matrices in one row."""

    def cells(a: Column, b: Column) -> Column:
        n, k, m = a["shape"][0], a["shape"][1], b["shape"][1]
        cell = lambda i: F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda s, j: s + F.element_at(a["data"], (F.floor(i / m) * k + j + 1).cast("int")) * F.element_at(b["data"], (j * m + i % m + 1).cast("int")))
        return F.struct(F.array(n, m).alias("shape"), F.transform(F.sequence(F.lit(0), n * m - 1), cell).alias("data"))

    return let(cells, a, b)


def transpose(t: Column) -> Column:
    def cells(t: Column) -> Column:
        n, m = t["shape"][0], t["shape"][1]
        return F.struct(F.array(m, n).alias("shape"), F.transform(F.sequence(F.lit(0), n * m - 1), lambda i: F.element_at(t["data"], ((i % n) * m + F.floor(i / n) + 1).cast("int"))).alias("data"))

    return let(cells, t)


def trace(t: Column) -> Column:
    return let(lambda t: F.aggregate(F.filter(t["data"], lambda x, i: i % (t["shape"][0] + 1) == 0), F.lit(0.0), lambda a, x: a + x), t)


def cross(a: Column, b: Column) -> Column:
    return let(lambda x, y: vec(F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])), a["data"], b["data"])


def det(t: Column, n: int) -> Column:
    """Of an n x n tensor, n <= 3, as one expression."""
    if n not in (1, 2, 3):
        raise ValueError("larger determinants: orrery.operators.tensor.determinants")
    forms = {
        1: lambda x: x[0],
        2: lambda x: x[0] * x[3] - x[1] * x[2],
        3: lambda x: x[0] * (x[4] * x[8] - x[5] * x[7]) - x[1] * (x[3] * x[8] - x[5] * x[6]) + x[2] * (x[3] * x[7] - x[4] * x[6]),
    }
    return let(forms[n], t["data"])


def inverse(t: Column, n: int) -> Column:
    """1 x 1 and 2 x 2; raises on a singular matrix."""
    if n not in (1, 2):
        raise ValueError("only 1 x 1 and 2 x 2 matrices")

    def cells(x: Column, d: Column) -> Column:
        safe = F.when(d == 0, F.raise_error(F.lit("singular matrix")).cast("double")).otherwise(d)
        return let(lambda s: mat(F.array(1 / s) if n == 1 else F.array(x[3] / s, -x[1] / s, -x[2] / s, x[0] / s), n, n), safe)

    return let(cells, t["data"], det(t, n))


def to_integers(t: Column) -> Column:
    """Cells rounded half to even; raises on NaN, infinities and what 64 bits don't hold."""
    one = lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**63), F.raise_error(F.lit("not a 64-bit integer")).cast("bigint")).otherwise(F.rint(x).cast("bigint"))
    return F.struct(t["shape"].alias("shape"), F.transform(t["data"], one).alias("data"))


def to_single(t: Column) -> Column:
    """Cells in 32 bits; raises where a finite cell overflows."""
    over = lambda x: (F.abs(x) != float("inf")) & (F.abs(x.cast("float")) == float("inf"))
    return F.struct(t["shape"].alias("shape"), F.transform(t["data"], lambda x: F.when(over(x), F.raise_error(F.lit("overflow of 32 bits")).cast("float")).otherwise(x.cast("float"))).alias("data"))


def add_exact(data: Column, c: Column) -> Column:
    """An integer array plus a scalar, widened so that no cell overflows."""
    return F.transform(data, lambda x: x.cast("decimal(38,0)") + c.cast("decimal(38,0)"))


# ---- tensors of structs (rational or complex cells of orrery.functions.scalar): `each` and `broadcasted` take them as they are


def tensor_of(shape: Column, data: Column) -> Column:
    """Like `tensor`, with cells of any type."""

    def checked(shape: Column, data: Column) -> Column:
        fits = F.aggregate(shape, F.lit(1), lambda a, d: a * d) == F.size(data)
        return F.struct(F.when(fits, shape).otherwise(F.raise_error(F.lit("shape and cells differ")).cast("array<int>")).alias("shape"), data.alias("data"))

    return let(checked, shape, data)


def total_of(t: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(t["data"], zero, add)


def matmul_of(a: Column, b: Column, zero: Column, add: Callable[[Column, Column], Column], mul: Callable[[Column, Column], Column]) -> Column:
    """The product of two matrices over any ring; raises if the inner lengths differ."""

    def cells(a: Column, b: Column) -> Column:
        k, m = F.get(a["shape"], F.lit(1)), F.get(b["shape"], F.lit(1))
        n = F.when(k == b["shape"][0], a["shape"][0]).otherwise(F.raise_error(F.lit("shapes don't match")).cast("int"))
        at = lambda t, i: F.element_at(t["data"], (i + 1).cast("int"))
        cell = lambda i: F.aggregate(F.sequence(F.lit(0), k - 1), zero, lambda s, j: add(s, mul(at(a, F.floor(i / m) * k + j), at(b, j * m + i % m))))
        return F.struct(F.array(n, m).alias("shape"), F.transform(F.sequence(F.lit(0), n * m - 1), cell).alias("data"))

    return let(cells, a, b)


# ---- boolean tensors: struct(shape, words array<bigint>), cell i in bit i % 64 of word i / 64; bits beyond the cells are 0


def bits(shape: Column, flags: Column) -> Column:
    """Packs booleans; raises unless the shape holds as many cells as there are."""

    def packed(shape: Column, flags: Column) -> Column:
        cells = F.aggregate(shape, F.lit(1), lambda a, d: a * d)
        good = F.when(cells == F.size(flags), shape).otherwise(F.raise_error(F.lit("shape and cells differ")).cast("array<int>"))
        # the last place of a word is its sign
        place = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
        word = lambda w: F.aggregate(F.zip_with(F.slice(flags, w * 64 + 1, F.lit(64)), place, lambda f, p: F.when(f, p).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
        every = F.when(F.size(flags) > 0, F.sequence(F.lit(0), F.floor((F.size(flags) - 1) / 64).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.struct(good.alias("shape"), F.transform(every, word).alias("words"))

    return let(packed, shape, flags)


def _words(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    def both(a: Column, b: Column) -> Column:
        same = F.when(a["shape"] == b["shape"], a["shape"]).otherwise(F.raise_error(F.lit("shapes don't match")).cast("array<int>"))
        return F.struct(same.alias("shape"), F.zip_with(a["words"], b["words"], op).alias("words"))

    return let(both, a, b)


def bits_or(a: Column, b: Column) -> Column:
    return _words(a, b, lambda x, y: x.bitwiseOR(y))


def bits_xor(a: Column, b: Column) -> Column:
    return _words(a, b, lambda x, y: x.bitwiseXOR(y))


def bits_and(a: Column, b: Column) -> Column:
    return _words(a, b, lambda x, y: x.bitwiseAND(y))


def flags_of(t: Column) -> Column:
    def unpacked(t: Column) -> Column:
        n = F.aggregate(t["shape"], F.lit(1), lambda a, d: a * d)
        word = lambda i: F.element_at(t["words"], (F.floor(i / 64) + 1).cast("int"))
        cell = lambda i: F.call_function("getbit", word(i), (i % 64).cast("int")) == 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), cell)).otherwise(F.array().cast("array<boolean>"))

    return let(unpacked, t)
