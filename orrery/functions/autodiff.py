"""Automatic differentiation over Columns: dual numbers forward, a tape backward. Both only build expressions; Spark evaluates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Dual:
    """A value and its derivatives by n inputs."""

    def __init__(self, value: Column, slopes: list[Column]):
        self.value, self.slopes = value, slopes

    @staticmethod
    def inputs(*columns: Column) -> list[Dual]:
        return [Dual(c, [F.lit(float(i == j)) for j in range(len(columns))]) for i, c in enumerate(columns)]

    def _lift(self, o) -> Dual:
        return o if isinstance(o, Dual) else Dual(F.lit(float(o)), [F.lit(0.0)] * len(self.slopes))

    def _chain(self, value: Column, slope: Column) -> Dual:
        return Dual(value, [slope * d for d in self.slopes])

    def _pair(self, o, value, by_self, by_other) -> Dual:
        o = self._lift(o)
        return Dual(value(self.value, o.value), [by_self(self.value, o.value) * a + by_other(self.value, o.value) * b for a, b in zip(self.slopes, o.slopes, strict=True)])

    def __add__(self, o):
        return self._pair(o, lambda a, b: a + b, lambda a, b: F.lit(1.0), lambda a, b: F.lit(1.0))

    def __sub__(self, o):
        return self._pair(o, lambda a, b: a - b, lambda a, b: F.lit(1.0), lambda a, b: F.lit(-1.0))

    def __mul__(self, o):
        return self._pair(o, lambda a, b: a * b, lambda a, b: b, lambda a, b: a)

    def __truediv__(self, o):
        return self._pair(o, lambda a, b: a / b, lambda a, b: 1 / b, lambda a, b: -a / (b * b))

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, o):
        return self._lift(o) - self

    def __rtruediv__(self, o):
        return self._lift(o) / self

    def __neg__(self):
        return self._chain(-self.value, F.lit(-1.0))

    def sin(self):
        return self._chain(F.sin(self.value), F.cos(self.value))

    def cos(self):
        return self._chain(F.cos(self.value), -F.sin(self.value))

    def exp(self):
        return self._chain(F.exp(self.value), F.exp(self.value))

    def ln(self):
        return self._chain(F.log(self.value), 1 / self.value)

    def sqrt(self):
        return self._chain(F.sqrt(self.value), 0.5 / F.sqrt(self.value))

    def recip(self):
        return self._chain(1 / self.value, -1 / (self.value * self.value))


class Tape:
    """Nodes by number, each with its value and the slopes by the nodes it came from; `grad` runs backward once for all inputs."""

    def __init__(self):
        self.values: list[Column] = []
        self.parents: list[list[tuple[int, Column]]] = []

    def _push(self, value: Column, *parents: tuple[int, Column]) -> int:
        self.values.append(value)
        self.parents.append(list(parents))
        return len(self.values) - 1

    def constant(self, x: float) -> int:
        return self._push(F.lit(float(x)))

    def input(self, c: Column) -> int:
        return self._push(c)

    def add(self, a: int, b: int) -> int:
        return self._push(self.values[a] + self.values[b], (a, F.lit(1.0)), (b, F.lit(1.0)))

    def sub(self, a: int, b: int) -> int:
        return self._push(self.values[a] - self.values[b], (a, F.lit(1.0)), (b, F.lit(-1.0)))

    def mul(self, a: int, b: int) -> int:
        return self._push(self.values[a] * self.values[b], (a, self.values[b]), (b, self.values[a]))

    def div(self, a: int, b: int) -> int:
        x, y = self.values[a], self.values[b]
        return self._push(x / y, (a, 1 / y), (b, -x / (y * y)))

    def _unary(self, a: int, f: Callable[[Column], Column], slope: Callable[[Column], Column]) -> int:
        return self._push(f(self.values[a]), (a, slope(self.values[a])))

    def sin(self, a: int) -> int:
        return self._unary(a, F.sin, F.cos)

    def cos(self, a: int) -> int:
        return self._unary(a, F.cos, lambda x: -F.sin(x))

    def exp(self, a: int) -> int:
        return self._unary(a, F.exp, F.exp)

    def ln(self, a: int) -> int:
        return self._unary(a, F.log, lambda x: 1 / x)

    def sqrt(self, a: int) -> int:
        return self._unary(a, F.sqrt, lambda x: 0.5 / F.sqrt(x))

    def recip(self, a: int) -> int:
        return self._unary(a, lambda x: 1 / x, lambda x: -1 / (x * x))

    def value(self, a: int) -> Column:
        return self.values[a]

    def grad(self, of: int, by: list[int]) -> list[Column]:
        slopes: dict[int, Column] = {of: F.lit(1.0)}
        for i in range(of, -1, -1):
            if i in slopes:
                for p, d in self.parents[i]:
                    step = slopes[i] * d
                    slopes[p] = slopes[p] + step if p in slopes else step
        return [slopes.get(i, F.lit(0.0)) for i in by]
