"""Numerical differentiation, quadrature and differential equations over rows of parameters, as Column expressions.

Functions are anything that maps a Column to a Column: a lambda or an expression's Function. A rule's nodes are folded within the row
(higher-order functions), so nothing is shuffled; only adaptive quadrature refines a table of intervals.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import expr as E
from orrery.functions.arrays import let
from orrery.functions.autodiff import Dual, Tape
from orrery.sources.tables import spread, table

Unary = Callable[[Column], Column]

# ---- differentiation


def forward(f: Unary, x: Column, h: float = 1e-6) -> Column:
    return (f(x + h) - f(x)) / h


def backward(f: Unary, x: Column, h: float = 1e-6) -> Column:
    return (f(x) - f(x - h)) / h


def central3(f: Unary, x: Column, h: float = 1e-6) -> Column:
    return (f(x + h) - f(x - h)) / (2 * h)


def central5(f: Unary, x: Column, h: float = 1e-6) -> Column:
    return (f(x - 2 * h) - 8 * f(x - h) + 8 * f(x + h) - f(x + 2 * h)) / (12 * h)


def richardson(f: Unary, x: Column, h: float = 1e-6) -> Column:
    return (4 * central3(f, x, h / 2) - central3(f, x, h)) / 3


# ---- fixed quadrature


def _weighed(f: Unary, lo: Column, hi: Column, n: int, weight: Unary, by: float = 1.0) -> Column:
    """step / by times the sum of weighted values at n + 1 even places. Step and places are named before `f` uses them, as an expression
    is evaluated anew wherever it stands."""

    def total(lo: Column, h: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: lo + h * i)
        return h / by * F.aggregate(F.transform(places, lambda x, i: weight(i) * f(x)), F.lit(0.0), lambda s, y: s + y)

    return let(total, lo, (hi - lo) / n)


def trapezoid(f: Unary, lo: Column, hi: Column, n: int = 256) -> Column:
    return _weighed(f, lo, hi, n, lambda i: F.when((i == 0) | (i == n), 0.5).otherwise(1.0))


def simpson(f: Unary, lo: Column, hi: Column, n: int = 128) -> Column:
    n += n % 2
    return _weighed(f, lo, hi, n, lambda i: F.when((i == 0) | (i == n), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0), 3.0)


def romberg(f: Unary, lo: Column, hi: Column, levels: int = 6) -> Column:
    def combined(*row: Column) -> Column:
        for k in range(1, levels):
            row = [(4**k * row[i + 1] - row[i]) / (4**k - 1) for i in range(len(row) - 1)]
        return row[0]

    return let(combined, *(trapezoid(f, lo, hi, 1 << k) for k in range(levels)))


def gauss_legendre(f: Unary, lo: Column, hi: Column, n: int = 16) -> Column:
    x, w = np.polynomial.legendre.leggauss(n)
    nodes = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("w")) for a, b in zip(x, w, strict=True)])

    def total(half: Column, mid: Column) -> Column:
        places = F.transform(nodes, lambda p: F.struct((mid + half * p["x"]).alias("x"), p["w"].alias("w")))
        return half * F.aggregate(F.transform(places, lambda p: p["w"] * f(p["x"])), F.lit(0.0), lambda s, y: s + y)

    return let(total, (hi - lo) / 2, (hi + lo) / 2)


QUADRATURE: dict[str, Callable[..., Column]] = {"trapezoid": trapezoid, "simpson": simpson, "romberg": romberg, "gauss-legendre-8": lambda f, a, b: gauss_legendre(f, a, b, 8), "gauss-legendre-16": gauss_legendre, "gauss-legendre-32": lambda f, a, b: gauss_legendre(f, a, b, 32)}
DIFFERENCES: dict[str, Callable[..., Column]] = {"forward": forward, "backward": backward, "central-3": central3, "central-5": central5, "richardson": richardson}


def register(methods: dict, name: str, method: Callable[..., Column]) -> None:
    if name in methods:
        raise ValueError(f"{name} exists")
    methods[name] = method


# ---- adaptive quadrature

#: Nodes and weights of the 15-point Kronrod rule (nonnegative half), and of the 7-point Gauss rule in it.
KRONROD = [
    (0.991455371120812639206854697526329, 0.022935322010529224963732008058970), (0.949107912342758524526189684047851, 0.063092092629978553290700663189204),
    (0.864864423359769072789712788640926, 0.104790010322250183839876322541518), (0.741531185599394439863864773280788, 0.140653259715525918745189590510238),
    (0.586087235467691130294144691693189, 0.169004726639267902826583426598550), (0.405845151377397166906606412076961, 0.190350578064785409913256402421014),
    (0.207784955007898467600689403773245, 0.204432940075298892414161999234649), (0.0, 0.209482141084727828012999174891714),
]
GAUSS = [0.129484966168869693270611432679082, 0.279705391489276667901467771423780, 0.381830050505118944950369775488975, 0.417959183673469387755102040816327]


def adaptive(rows: DataFrame, key: str, lo: str, hi: str, f: Unary, tolerance: float = 1e-10, depth: int = 10) -> DataFrame:
    """(key, value, intervals): G7-K15 on a table of intervals; those over their tolerance are halved, each half with half of it, at most
    `depth` times. Each round is one narrow pass over the open intervals; sums meet once at the end."""
    points = [(s * x, w, GAUSS[i // 2] if i % 2 == 1 else 0.0) for i, (x, w) in enumerate(KRONROD) for s in ((1, -1) if x else (1,))]
    half, mid = (F.col("b") - F.col("a")) / 2, (F.col("b") + F.col("a")) / 2
    # the values are an array of their own, so that both sums are plain products of its cells
    values = let(lambda half, mid: F.transform(F.transform(F.array(*[F.lit(x) for x, _, _ in points]), lambda x: mid + half * x), lambda x: f(x)), half, mid)
    kronrod, gauss = (sum((F.col("_values")[i] * w for i, w in enumerate(ws) if w), F.lit(0.0)) for ws in ([w for _, w, _ in points], [g for _, _, g in points]))
    opened, done = rows.select(F.col(key), F.col(lo).cast("double").alias("a"), F.col(hi).cast("double").alias("b"), F.lit(tolerance).alias("tol")), None
    for level in range(depth + 1):
        summed = opened.withColumn("_values", values).select(key, "a", "b", "tol", kronrod.alias("_kronrod"), gauss.alias("_gauss"))
        tried = summed.select(key, "a", "b", "tol", (half * F.col("_kronrod")).alias("value"), F.abs(half * (F.col("_kronrod") - F.col("_gauss"))).alias("error")).cache()
        fine = tried if level == depth else tried.where(F.col("error") <= F.col("tol"))
        done = fine.select(key, "value") if done is None else done.unionByName(fine.select(key, "value"))
        rest = tried.where(F.col("error") > F.col("tol"))
        if level == depth or rest.isEmpty():
            break
        sides = F.explode(F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b").alias("b")))).alias("s")
        opened = rest.select(key, "tol", sides).select(key, "s.a", "s.b", (F.col("tol") / 2).alias("tol"))
    return done.groupBy(key).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("intervals"))


# ---- differential equations

Slope = Callable[[Column, Column], Column]


def _euler(f: Slope, x: Column, y: Column, h: Column) -> Column:
    return y + h * f(x, y)


def _midpoint(f: Slope, x: Column, y: Column, h: Column) -> Column:
    return y + h * f(x + h / 2, y + h / 2 * f(x, y))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Name a value within an expression, so that it's evaluated once."""
    return F.transform(F.array(value), use)[0]


def _rk4(f: Slope, x: Column, y: Column, h: Column) -> Column:
    return _let(f(x, y), lambda a: _let(f(x + h / 2, y + h / 2 * a), lambda b: _let(f(x + h / 2, y + h / 2 * b), lambda c: y + h / 6 * (a + 2 * b + 2 * c + f(x + h, y + h * c)))))


def _backward(f: Slope, x: Column, y: Column, h: Column) -> Column:
    """Implicit Euler by 16 fixed-point iterations."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), y + h * f(x, y), lambda z, _: y + h * f(x + h, z))


STEPPERS = {"forward-euler": _euler, "backward-euler": _backward, "midpoint": _midpoint, "rk4": _rk4}


def solve(f: Slope, x0: Column, y0: Column, end: Column, h: float = 0.01, method: str = "rk4", most: int = 100_000) -> Column:
    """array(struct(x, y)) from x0 to end; the last step is cut to end there; h = 0 or too many steps raise."""
    if h == 0:
        raise ValueError("step of 0")
    n = F.ceil(F.round(F.abs(end - x0) / abs(h), 9)).cast("int")
    checked = F.when(n > most, F.raise_error(F.lit("too many steps")).cast("int")).otherwise(n)
    start = F.array(F.struct(x0.cast("double").alias("x"), y0.cast("double").alias("y")))
    signed = F.signum(end - x0) * abs(h)

    def step(path: Column, i: Column) -> Column:
        def add(last: Column) -> Column:
            to = F.when(i == n, end).otherwise(x0 + signed * i)
            return F.array_append(path, F.struct(to.cast("double").alias("x"), STEPPERS[method](f, last["x"], last["y"], to - last["x"]).cast("double").alias("y")))

        return _let(F.element_at(path, -1), add)

    return F.aggregate(F.when(checked > 0, F.sequence(F.lit(1), checked)).otherwise(F.array().cast("array<int>")), start, step)


class Cells:
    """An array Column with the arithmetic that the steppers use, cell by cell; the other operand may be a number, a Column or Cells."""

    def __init__(self, data: Column):
        self.data = data

    def _with(self, other, op: Callable[[Column, Column], Column]) -> Cells:
        if isinstance(other, Cells):
            return Cells(F.zip_with(self.data, other.data, op))
        fixed = other if isinstance(other, Column) else F.lit(other)
        return Cells(F.transform(self.data, lambda x: op(x, fixed)))

    def __add__(self, other) -> Cells:
        return self._with(other, lambda x, y: x + y)

    def __sub__(self, other) -> Cells:
        return self._with(other, lambda x, y: x - y)

    def __mul__(self, other) -> Cells:
        return self._with(other, lambda x, y: x * y)

    def __truediv__(self, other) -> Cells:
        return self._with(other, lambda x, y: x / y)

    def __neg__(self) -> Cells:
        return Cells(F.transform(self.data, lambda x: -x))

    def __getitem__(self, place: int) -> Column:
        return F.get(self.data, F.lit(place))

    @staticmethod
    def of(*cells: Column) -> Cells:
        return Cells(F.array(*cells))


def _cells_step(method: str, f: Callable, x: Column, y: Column, h: Column) -> Column:
    """One step of a state of cells; slopes are named once each."""
    slope = lambda x, y: f(x, Cells(y)).data
    move = lambda y, k, by: F.zip_with(y, k, lambda a, b: a + by * b)
    if method == "forward-euler":
        return move(y, slope(x, y), h)
    if method == "midpoint":
        return _let(move(y, slope(x, y), h / 2), lambda z: move(y, slope(x + h / 2, z), h))
    if method == "backward-euler":
        return F.aggregate(F.sequence(F.lit(1), F.lit(16)), move(y, slope(x, y), h), lambda z, _: move(y, slope(x + h, z), h))

    def last(a: Column, b: Column, c: Column, d: Column) -> Column:
        return F.zip_with(y, F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")), lambda y, k: y + h / 6 * (k["a"] + 2 * k["b"] + 2 * k["c"] + k["d"]))

    half = lambda k: _let(move(y, k, h / 2), lambda z: slope(x + h / 2, z))
    whole = lambda k: _let(move(y, k, h), lambda z: slope(x + h, z))
    return _let(slope(x, y), lambda a: _let(half(a), lambda b: _let(half(b), lambda c: _let(whole(c), lambda d: last(a, b, c, d)))))


def solve_cells(f: Callable[[Column, Cells], Cells], x0: Column, y0: Column, end: Column, h: float = 0.01, method: str = "rk4", most: int = 100_000) -> Column:
    """The state at `end` of a system whose state is an array: as `solve`, without the path. `f` takes x and Cells and gives Cells."""
    if h == 0:
        raise ValueError("step of 0")
    n = F.ceil(F.round(F.abs(end - x0) / abs(h), 9)).cast("int")
    checked = F.when(n > most, F.raise_error(F.lit("too many steps")).cast("int")).otherwise(n)
    signed = F.signum(end - x0) * abs(h)
    steps = F.when(checked > 0, F.sequence(F.lit(1), checked)).otherwise(F.array().cast("array<int>"))

    def step(y: Column, i: Column) -> Column:
        start = x0 + signed * (i - 1)
        return _cells_step(method, f, start, y, F.when(i == n, end - start).otherwise(signed))

    return F.aggregate(steps, y0.cast("array<double>"), step)


def solve_adaptive(rows: DataFrame, key: str, f: Callable, x0: str, y0: str, end: str, tolerance: float = 1e-8, h: float = 0.01, most: int = 100_000) -> DataFrame:
    """(key, x, y, steps) at `end`: Runge-Kutta-Fehlberg of orders 4 and 5 for all rows of a batch at once; `f` works on numpy arrays."""
    a = [[], [1 / 4], [3 / 32, 9 / 32], [1932 / 2197, -7200 / 2197, 7296 / 2197], [439 / 216, -8, 3680 / 513, -845 / 4104], [-8 / 27, 2, -3544 / 2565, 1859 / 4104, -11 / 40]]
    c, low, high = [0, 1 / 4, 3 / 8, 12 / 13, 1, 1 / 2], [25 / 216, 0, 1408 / 2565, 2197 / 4104, -1 / 5, 0], [16 / 135, 0, 6656 / 12825, 28561 / 56430, -9 / 50, 2 / 55]
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y, e = (batch[n].to_numpy(float).copy() for n in (x0, y0, end))
            way, steps = np.sign(e - x), np.zeros(len(x), int)
            size = np.full(len(x), abs(h))
            for _ in range(most):
                on = np.abs(e - x) > 1e-14 * np.maximum(1, np.abs(e))
                if not on.any():
                    break
                d = way * np.minimum(size, np.abs(e - x))
                k: list[np.ndarray] = []
                for ci, ai in zip(c, a, strict=True):
                    k.append(f(x + ci * d, y + d * sum((w * v for w, v in zip(ai, k, strict=True)), np.zeros(len(x)))))
                y4, y5 = (y + d * sum(w * v for w, v in zip(ws, k, strict=True)) for ws in (low, high))
                error = np.abs(y5 - y4)
                good = on & (error <= tolerance)
                x, y, steps = np.where(good, x + d, x), np.where(good, y5, y), steps + good
                size = size * np.clip(0.84 * (tolerance / np.maximum(error, 1e-300)) ** 0.25, 0.1, 4)
            else:
                raise ArithmeticError("too many steps")
            yield pd.DataFrame({key: batch[key], "x": x, "y": y, "steps": steps})

    return rows.select(key, x0, y0, end).mapInPandas(run, f"{key} {kind}, x double, y double, steps long")


@dataclass
class Composed:
    """An inspectable computation: what kind, by which method, with which options."""

    domain: str
    method: str
    options: dict

    def run(self, f: Callable, *args: Column) -> Column:
        if self.domain == "quadrature":
            return QUADRATURE[self.method](f, *args, **self.options)
        if self.domain == "ode-solve":
            return solve(f, *args, method=self.method, **self.options)
        if self.domain == "difference":
            return DIFFERENCES[self.method](f, *args, **self.options)
        raise ValueError(f"unknown domain {self.domain}")


def methods(spark: SparkSession) -> DataFrame:
    rows = [(m, d, d == "adaptive") for d, names in (("difference", DIFFERENCES), ("quadrature", QUADRATURE), ("ode-solve", STEPPERS)) for m in names]
    return spark.createDataFrame([*rows, ("adaptive-gauss-kronrod", "quadrature", True), ("rkf45", "ode-solve", True)], "method string, domain string, adaptive boolean")


# ---- queries


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), "p_partkey")
    return part.select("p_partkey", (F.col("p_retailprice") / 1000).alias("a"), (F.col("p_size") / 10).alias("b"))


def _smooth(x: Column) -> Column:
    return F.sin(x) + x * x * x / 3


def q_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", *(F.round(m(_smooth, F.col("b"), 1e-4), 2).alias(n.replace("-", "_")) for n, m in DIFFERENCES.items()))


def q_quadrature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", *(F.round(m(_smooth, F.lit(0.0), F.col("b")), 2).alias(n.replace("-", "_")) for n, m in QUADRATURE.items()))


def q_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).withColumn("zero", F.lit(0.0))
    return adaptive(rows, "p_partkey", "zero", "b", lambda x: F.sqrt(F.abs(x - 1)) + F.exp(-x), 1e-7).select("p_partkey", F.round("value", 4).alias("value"))


def q_ode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y' = -y / 2 from a over a span of 1, by each stepper."""
    p = _parts(spark, sf_dir)
    ends = {m: F.element_at(solve(lambda x, y: -y / 2, F.lit(0.0), F.col("a"), F.lit(1.0), 0.05, m), -1)["y"] for m in STEPPERS}
    return p.select("p_partkey", *(F.round(c, 6).alias(m.replace("-", "_")) for m, c in ends.items()))


_H = "0.025"
ODE_SQL = f"""SELECT p_partkey, round(p_retailprice / 1000 * pow(1 - {_H}, 20), 6) AS forward_euler, round(p_retailprice / 1000 * pow(1 / (1 + {_H}), 20), 6) AS backward_euler,
 round(p_retailprice / 1000 * pow(1 - {_H} + {_H} * {_H} / 2, 20), 6) AS midpoint, round(p_retailprice / 1000 * pow(1 - {_H} + {_H} ^ 2 / 2 - {_H} ^ 3 / 6 + {_H} ^ 4 / 24, 20), 6) AS rk4 FROM part"""


def q_ode_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).withColumn("x0", F.lit(0.0)).withColumn("end", F.lit(1.0))
    return solve_adaptive(p, "p_partkey", lambda x, y: -y / 2, "x0", "a", "end").select("p_partkey", F.round("y", 5).alias("y"))


def q_ode_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oscillator y'' = -y as a state of two cells, from (a, b) over a span of 1, by Runge-Kutta of order 4."""
    turn = lambda x, y: Cells.of(y[1], -y[0])
    p = _parts(spark, sf_dir)
    y = solve_cells(turn, F.lit(0.0), F.array("a", "b"), F.lit(1.0), 0.05)
    return p.select("p_partkey", y.alias("y")).select("p_partkey", *(F.round(F.col("y")[i], 6).alias(n) for i, n in enumerate(("place", "speed"))))


X, Y = E.Var("a"), E.Var("b")
BODY = (X**2 * Y + E.sin(X) / Y) ** 2 + E.exp(-X) * E.ln(Y + 1)


def q_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression, its partial derivatives and an integral, compiled to Columns."""
    poly = 3 * X**2 * Y - X / 2 + Y**-1
    dx, dy = E.gradient(BODY, ["a", "b"])
    named = {"value": BODY, "d_a": dx, "d_b": dy, "integral": E.integrate(poly, "a"), "second": E.differentiate(E.differentiate(E.tan(X / 9), "a"), "a")}
    return _parts(spark, sf_dir).select("p_partkey", *(F.round(E.column(e), 4).alias(n) for n, e in named.items()))


_u = "(a * a * b + sin(a) / b)"
CAS_SQL = f"""WITH p AS (SELECT p_partkey, p_retailprice / 1000 AS a, p_size / 10 AS b FROM part)
SELECT p_partkey, round({_u} ^ 2 + exp(-a) * ln(b + 1), 4) AS value, round(2 * {_u} * (2 * a * b + cos(a) / b) - exp(-a) * ln(b + 1), 4) AS d_a, round(2 * {_u} * (a * a - sin(a) / (b * b)) + exp(-a) / (b + 1), 4) AS d_b,
 round(a ^ 3 * b - a * a / 4 + a / b, 4) AS integral, round(2.0 / 81 * sin(a / 9) / cos(a / 9) ^ 3, 4) AS second FROM p"""


def q_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function values: calls, sums and products of functions, gradients."""
    f, g = E.Function(["a"], X**2), E.Function(["b"], E.cos(Y))
    h = f * g + 1
    return _parts(spark, sf_dir).select("p_partkey", F.round(h(F.col("a"), F.col("b")), 6).alias("h"), *(F.round(d(F.col("a"), F.col("b")), 6).alias(f"grad{i}") for i, d in enumerate(h.grad())))


def q_autodiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a sin(b) + exp(-a) / b and its gradient, by dual numbers and by a tape."""
    p = _parts(spark, sf_dir)
    a, b = Dual.inputs(F.col("a"), F.col("b"))
    f = a * b.sin() + (-a).exp() / b
    t = Tape()
    ta, tb = t.input(F.col("a")), t.input(F.col("b"))
    out = t.add(t.mul(ta, t.sin(tb)), t.div(t.exp(t.sub(t.constant(0), ta)), tb))
    back = t.grad(out, [ta, tb])
    return p.select("p_partkey", *(F.round(c, 6).alias(n) for n, c in {"value": f.value, "forward_a": f.slopes[0], "forward_b": f.slopes[1], "backward_a": back[0], "backward_b": back[1]}.items()))


AUTODIFF_SQL = """WITH p AS (SELECT p_partkey, p_retailprice / 1000 AS a, p_size / 10 AS b FROM part), g AS (SELECT *, sin(b) - exp(-a) / b AS ga, a * cos(b) - exp(-a) / (b * b) AS gb FROM p)
SELECT p_partkey, round(a * sin(b) + exp(-a) / b, 6) AS value, round(ga, 6) AS forward_a, round(gb, 6) AS forward_b, round(ga, 6) AS backward_a, round(gb, 6) AS backward_b FROM g"""


def q_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Composed("quadrature", "simpson", {"n": 64})
    return _parts(spark, sf_dir).select("p_partkey", F.lit(c.domain).alias("domain"), F.lit(c.method).alias("method"), F.round(c.run(_smooth, F.lit(0.0), F.col("b")), 3).alias("value"))


def q_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methods(spark).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if("adaptive").alias("n_adaptive"))


_true = "round(1 - cos(b) + b ^ 4 / 12, {})"
_P = "WITH p AS (SELECT p_partkey, p_size / 10 AS b FROM part)"

QUERIES = {
    "numeric_differences": (q_differences, f"{_P} SELECT p_partkey, " + ", ".join(f"round(({e}), 2) AS {n.replace('-', '_')}" for n, e in {
        "forward": "(sin(b + 1e-4) + (b + 1e-4) ^ 3 / 3 - sin(b) - b ^ 3 / 3) / 1e-4", "backward": "(sin(b) + b ^ 3 / 3 - sin(b - 1e-4) - (b - 1e-4) ^ 3 / 3) / 1e-4", "central-3": "cos(b) + b * b", "central-5": "cos(b) + b * b", "richardson": "cos(b) + b * b"}.items()) + " FROM p"),
    "numeric_quadrature": (q_quadrature, f"{_P} SELECT p_partkey, " + ", ".join(f"{_true.format(2)} AS {n.replace('-', '_')}" if n != "trapezoid" else "round(1 - cos(b) + b ^ 4 / 12 + (b / 256) ^ 2 / 12 * (cos(b) - 1 + b * b), 2) AS trapezoid" for n in QUADRATURE) + " FROM p"),
    "numeric_adaptive": (q_adaptive, f"{_P} SELECT p_partkey, round(CASE WHEN b <= 1 THEN 2.0 / 3 * (1 - (1 - b) ^ 1.5) ELSE 2.0 / 3 * (1 + (b - 1) ^ 1.5) END + 1 - exp(-b), 4) AS value FROM p"),
    "ode_fixed_step": (q_ode, ODE_SQL), "ode_rkf45": (q_ode_adaptive, "SELECT p_partkey, round(p_retailprice / 1000 * exp(-0.5), 5) AS y FROM part"),
    # a step of order 4 turns the state as c + i s does, so 20 steps are its power, written by size and angle
    "ode_cells": (q_ode_cells, "WITH p AS (SELECT p_partkey, p_retailprice / 1000 AS a, p_size / 10 AS b, 1 - 0.05::double ^ 2 / 2 + 0.05::double ^ 4 / 24 AS c, 0.05::double - 0.05::double ^ 3 / 6 AS s FROM part), "
        "t AS (SELECT *, (c * c + s * s) ^ 10 AS r, 20 * atan2(s, c) AS h FROM p) SELECT p_partkey, round(r * (a * cos(h) + b * sin(h)), 6) AS place, round(r * (b * cos(h) - a * sin(h)), 6) AS speed FROM t"),
    "cas_columns": (q_cas, CAS_SQL),
    "cas_functions": (q_functions, "WITH p AS (SELECT p_partkey, p_retailprice / 1000 AS a, p_size / 10 AS b FROM part) SELECT p_partkey, round(a * a * cos(b) + 1, 6) AS h, round(2 * a * cos(b), 6) AS grad0, round(-a * a * sin(b), 6) AS grad1 FROM p"),
    "numeric_autodiff": (q_autodiff, AUTODIFF_SQL),
    "numeric_composed": (q_composed, f"{_P} SELECT p_partkey, 'quadrature' AS domain, 'simpson' AS method, {_true.format(3)} AS value FROM p"),
    "numeric_methods": (q_methods, "SELECT * FROM (VALUES ('difference', 5, 0), ('quadrature', 7, 1), ('ode-solve', 5, 1)) AS t(domain, n, n_adaptive)"),
}
