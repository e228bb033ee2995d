"""Symbolic expressions that compile to Columns: built with Python's operators, simplified, differentiated, integrated.

Numbers are exact fractions or floats. `column` turns an expression into a Column whose variables are columns, so Catalyst plans it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


class Expr:
    def __add__(self, o):
        return simplify(Op("add", (self, lift(o))))

    def __radd__(self, o):
        return lift(o) + self

    def __sub__(self, o):
        return simplify(Op("sub", (self, lift(o))))

    def __rsub__(self, o):
        return lift(o) - self

    def __mul__(self, o):
        return simplify(Op("mul", (self, lift(o))))

    def __rmul__(self, o):
        return lift(o) * self

    def __truediv__(self, o):
        return simplify(Op("div", (self, lift(o))))

    def __rtruediv__(self, o):
        return lift(o) / self

    def __pow__(self, o):
        return simplify(Op("pow", (self, lift(o))))

    def __neg__(self):
        return lift(-1) * self


@dataclass(frozen=True)
class Num(Expr):
    value: Fraction | float


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Op(Expr):
    name: str
    args: tuple[Expr, ...]


def lift(x) -> Expr:
    return x if isinstance(x, Expr) else Num(x if isinstance(x, float) else Fraction(x))


def call(name: str, *args) -> Expr:
    """sin, cos, tan, exp, ln, sqrt, or an unknown function that stays symbolic."""
    return simplify(Op(name, tuple(map(lift, args))))


sin, cos, tan, exp, ln, sqrt = (lambda x, n=n: call(n, x) for n in ("sin", "cos", "tan", "exp", "ln", "sqrt"))

#: name: (number function, Column function, derivative)
FUNCTIONS: dict[str, tuple[Callable, Callable, Callable | None]] = {
    "sin": (math.sin, F.sin, lambda u: cos(u)), "cos": (math.cos, F.cos, lambda u: -sin(u)), "tan": (math.tan, F.tan, lambda u: 1 / cos(u) ** 2),
    "exp": (math.exp, F.exp, lambda u: exp(u)), "ln": (math.log, F.log, lambda u: 1 / u), "sqrt": (math.sqrt, F.sqrt, lambda u: 1 / (2 * sqrt(u))),
}
_RULES: dict[str, Callable[[Expr], Expr]] = {k: v[2] for k, v in FUNCTIONS.items()}


def register_derivative(name: str, rule: Callable[[Expr], Expr], override: bool = False) -> None:
    """`rule(u)`: derivative of name(u) by u. A second rule for a name is an error unless it overrides."""
    if name in _RULES and not override:
        raise ValueError(f"{name} has a rule")
    _RULES[name] = rule


def order_key(e: Expr) -> tuple:
    if isinstance(e, Num):
        return (0, float(e.value), "")
    return (1, 0.0, e.name) if isinstance(e, Var) else (2, 0.0, e.name + repr([order_key(a) for a in e.args]))


def _arith(name: str, a, b):
    if name == "div":
        return a / b
    if name == "pow":
        return a**b if isinstance(b, Fraction) and b.denominator == 1 else float(a) ** float(b)
    return {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b}[name]()


def simplify(e: Expr) -> Expr:
    """Nested sums and products flattened, numbers folded, identities dropped, zero absorbing, arguments sorted."""
    if not isinstance(e, Op):
        return e
    args = [simplify(a) for a in e.args]
    if e.name in ("add", "mul"):
        flat = [x for a in args for x in (a.args if isinstance(a, Op) and a.name == e.name else (a,))]
        unit = Fraction(0) if e.name == "add" else Fraction(1)
        total, rest = unit, []
        for a in flat:
            if isinstance(a, Num):
                total = _arith(e.name, total, a.value)
            else:
                rest.append(a)
        if e.name == "mul" and total == 0:
            return Num(Fraction(0))
        rest.sort(key=order_key)
        if total != unit or not rest:
            rest.insert(0, Num(total))
        return rest[0] if len(rest) == 1 else Op(e.name, tuple(rest))
    if e.name == "sub" and args[1] == Num(Fraction(0)):
        return args[0]
    if e.name == "div" and args[1] == Num(Fraction(1)):
        return args[0]
    if e.name == "pow" and isinstance(args[1], Num):
        n, base = args[1].value, args[0]
        if n == 1:
            return base
        if n == 0 and base != Num(Fraction(0)):
            return Num(Fraction(1))
        if base == Num(Fraction(0)) and n > 0:
            return base
    if e.name in ("add", "sub", "mul", "div", "pow") and all(isinstance(a, Num) for a in args) and not (e.name == "div" and args[1].value == 0) and args != [Num(Fraction(0))] * 2:
        return Num(_arith(e.name, args[0].value, args[1].value))
    return Op(e.name, tuple(args))


def free_variables(e: Expr) -> list[str]:
    """In order of first sight."""
    out: dict[str, None] = {}
    stack = [e]
    while stack:
        x = stack.pop()
        if isinstance(x, Var):
            out[x.name] = None
        elif isinstance(x, Op):
            stack.extend(reversed(x.args))
    return list(out)


def substitute(e: Expr, env: Mapping[str, object]) -> Expr:
    """Known variables replaced, others left symbolic."""
    if isinstance(e, Var):
        return lift(env[e.name]) if e.name in env else e
    return simplify(Op(e.name, tuple(substitute(a, env) for a in e.args))) if isinstance(e, Op) else e


def evaluate(e: Expr, env: Mapping[str, float]) -> float:
    """A number; an unbound variable is an error."""
    if isinstance(e, Num):
        return float(e.value)
    if isinstance(e, Var):
        return float(env[e.name])
    args = [evaluate(a, env) for a in e.args]
    if e.name in FUNCTIONS:
        return FUNCTIONS[e.name][0](*args)
    out = args[0]
    for a in args[1:]:
        out = _arith(e.name, out, a)
    return out


def column(e: Expr, env: Mapping[str, Column] | None = None) -> Column:
    """Variables are columns of their name, or those of `env`."""
    if isinstance(e, Num):
        return F.lit(float(e.value))
    if isinstance(e, Var):
        return (env or {}).get(e.name, F.col(e.name)).cast("double")
    args = [column(a, env) for a in e.args]
    if e.name in FUNCTIONS:
        return FUNCTIONS[e.name][1](*args)
    if e.name == "pow":
        return F.pow(args[0], args[1])
    if e.name not in ("add", "sub", "mul", "div"):
        raise ValueError(f"no Column function for {e.name}")
    out = args[0]
    for a in args[1:]:
        out = _arith(e.name, out, a)
    return out


def differentiate(e: Expr, v: str) -> Expr:
    if isinstance(e, Num):
        return lift(0)
    if isinstance(e, Var):
        return lift(int(e.name == v))
    d = [differentiate(a, v) for a in e.args]
    if e.name == "add":
        return sum(d, lift(0))
    if e.name == "sub":
        return d[0] - d[1]
    if e.name == "mul":
        out = lift(0)
        for i in range(len(d)):
            term = d[i]
            for j, a in enumerate(e.args):
                term = term * a if j != i else term
            out = out + term
        return out
    if e.name == "div":
        a, b = e.args
        return (d[0] * b - a * d[1]) / b**2
    if e.name == "pow":
        a, b = e.args
        return b * a ** (b - 1) * d[0] if isinstance(b, Num) else e * (d[1] * ln(a) + b * d[0] / a)
    if e.name in _RULES and len(e.args) == 1:
        return _RULES[e.name](e.args[0]) * d[0]
    return Op("diff", (e, Var(v)))


def gradient(e: Expr, variables: list[str] | None = None) -> list[Expr]:
    return [differentiate(e, v) for v in (variables or free_variables(e))]


def integrate(e: Expr, v: str) -> Expr:
    """Constants, sums, differences, products with one factor in the variable, and integer powers of it; else an error."""
    x = Var(v)
    if v not in free_variables(e):
        return e * x
    if e == x:
        return x**2 / 2
    if isinstance(e, Op):
        if e.name in ("add", "sub"):
            parts = [integrate(a, v) for a in e.args]
            return sum(parts[1:], parts[0]) if e.name == "add" else parts[0] - parts[1]
        if e.name == "div" and v not in free_variables(e.args[1]):
            return integrate(e.args[0], v) / e.args[1]
        if e.name == "mul":
            inner = [a for a in e.args if v in free_variables(a)]
            if len(inner) == 1:
                out = integrate(inner[0], v)
                for a in e.args:
                    out = a * out if a is not inner[0] else out
                return out
        if e.name == "pow" and e.args[0] == x and isinstance(e.args[1], Num) and Fraction(e.args[1].value).denominator == 1:
            n = Fraction(e.args[1].value)
            return ln(x) if n == -1 else x ** (n + 1) / (n + 1)
    raise ValueError("no rule integrates this")


def to_json(e: Expr) -> str:
    def plain(x: Expr):
        if isinstance(x, Num):
            return str(x.value)
        return x.name if isinstance(x, Var) else [x.name, *map(plain, x.args)]

    return json.dumps(plain(e))


class Function:
    """Parameters and a body; called with Columns, numbers or expressions."""

    def __init__(self, parameters: list[str], body: Expr):
        self.parameters, self.body = parameters, body

    def __call__(self, *args):
        if len(args) != len(self.parameters):
            raise TypeError(f"{len(self.parameters)} arguments needed")
        env = dict(zip(self.parameters, args, strict=True))
        if any(isinstance(a, Column) for a in args):
            return column(self.body, {k: a if isinstance(a, Column) else F.lit(float(a)) for k, a in env.items()})
        return substitute(self.body, env)

    def _with(self, o, op) -> Function:
        other = o if isinstance(o, Function) else Function([], lift(o))
        return Function(list(dict.fromkeys(self.parameters + other.parameters)), op(self.body, other.body))

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __truediv__(self, o):
        return self._with(o, lambda a, b: a / b)

    def grad(self) -> list[Function]:
        return [Function(self.parameters, differentiate(self.body, p)) for p in self.parameters]
