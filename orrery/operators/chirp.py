"""Transforms of one long series of any length, and at any linear grid of frequencies, by chirps.

A sum over x_n exp(-2 pi i n (first + k step)) is, as n k = (n^2 + k^2 - (k - n)^2) / 2, a convolution with a chirp between two
multiplications by chirps. The convolution runs through transforms of a power of two, in rows and columns (two shuffles each), so no
task holds more than a row or a column: about the square root of the length. Steps are ratios of integers, and squares are taken modulo
their period before they become angles, so phases keep their digits at any length.

Null values raise; a place must not repeat; places that are missing count as zero; an empty series has no bins.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.scratch import staged
from orrery.sources.tables import indexed, table

_CELL = "r long, c long, re double, im double"


def _pass(cells: DataFrame, line: str, along: str, length: int, sign: int, twiddle: int = 0) -> DataFrame:
    """Transforms of the lines of `cells(r, c, re, im)` along one axis, zeros where cells are missing; with `twiddle` each result is turned
    by exp(sign 2 pi i r c / twiddle)."""

    def one(group: pa.Table) -> pa.Table:
        x = np.zeros(length, complex)
        at = group.column(along).to_numpy()
        x[at] = group.column("re").to_numpy(zero_copy_only=False) + 1j * group.column("im").to_numpy(zero_copy_only=False)
        y = np.fft.fft(x) if sign < 0 else np.fft.ifft(x) * length
        own, k = int(group.column(line)[0].as_py()), np.arange(length)
        if twiddle:
            y = y * np.exp(sign * 2j * np.pi * ((own * k) % twiddle) / twiddle)
        return pa.table({line: np.full(length, own), along: k, "re": y.real, "im": y.imag}).select(["r", "c", "re", "im"])

    return cells.groupBy(line).applyInArrow(one, _CELL)


def long_fft(df: DataFrame, power: int, inverse: bool = False) -> DataFrame:
    """idx, re, im: the unscaled transform of length 2^power of `df(idx, re, im)`; missing places are zero. Every place has a row."""
    rows, sign = 1 << power // 2, 1 if inverse else -1
    columns = (1 << power) // rows
    cells = df.select((F.col("idx") % rows).alias("r"), F.floor(F.col("idx") / rows).cast("long").alias("c"), "re", "im")
    # lines without a value are zero, as are their transforms: they add nothing in the second pass
    inner = _pass(cells, "r", "c", columns, sign, 1 << power)
    return _pass(inner, "c", "r", rows, sign).select((F.col("c") + columns * F.col("r")).alias("idx"), "re", "im")


def _turn(number: Column, top: int, bottom: int) -> tuple[Column, Column]:
    """cos and sin of 2 pi number top / bottom, number a long: reduced modulo the period first."""
    angle = F.lit(2 * math.pi / bottom) * (F.pmod(F.pmod(number, F.lit(bottom)) * F.lit(top % bottom), F.lit(bottom))).cast("double")
    return F.cos(angle), F.sin(angle)


def _chirp(number: Column, step: Fraction) -> tuple[Column, Column]:
    """cos and sin of pi step number^2."""
    period = 2 * step.denominator
    near = F.pmod(number, F.lit(period))
    return _turn(F.pmod(near * near, F.lit(period)), step.numerator, period)


def _times(re: Column, im: Column, by: tuple[Column, Column], sign: int) -> tuple[Column, Column]:
    c, s = by[0], F.lit(float(sign)) * by[1]
    return re * c - im * s, re * s + im * c


def chirp_z(df: DataFrame, bins: int, first: Fraction, step: Fraction, length: int | None = None) -> DataFrame:
    """k, re, im for k = 0 … bins - 1: sums of `df(idx, x)` over x exp(-2 pi i idx (first + k step)), first and step in cycles a sample."""
    if max(2 * step.denominator, first.denominator) >= 2**31:
        raise ValueError("denominators of 2^31 or more leave 64 bits")
    last = df.agg(F.max("idx")).first()[0] if length is None else length - 1
    n = 0 if last is None else last + 1
    power = max(0, (max(1, n) + bins - 2).bit_length())
    size = 1 << power
    value = F.coalesce(F.col("x").cast("double"), F.raise_error(F.lit("a missing value")).cast("double"))
    re, im = _times(value, F.lit(0.0), _turn(F.col("idx"), first.numerator, first.denominator), -1)
    led = df.select(F.col("idx").cast("long").alias("idx"), re.alias("re"), im.alias("im"))
    re, im = _times(F.col("re"), F.col("im"), _chirp(F.col("idx"), step), -1)
    series = long_fft(led.select("idx", re.alias("re"), im.alias("im")), power)
    spread = df.sparkSession.range(min(0, 1 - n), bins).select(F.pmod("id", F.lit(size)).alias("idx"), *(c.alias(name) for c, name in zip(_chirp(F.col("id"), step), ("re", "im"), strict=True)))
    # both are needed whole and no more than once; written, so that lost executors cost a pass and not all of them
    a, b = staged(series, "chirp-series"), staged(long_fft(spread, power), "chirp-spread").select("idx", F.col("re").alias("re2"), F.col("im").alias("im2"))
    product = a.join(b, "idx").select("idx", (F.col("re") * F.col("re2") - F.col("im") * F.col("im2")).alias("re"), (F.col("re") * F.col("im2") + F.col("im") * F.col("re2")).alias("im"))
    folded = long_fft(product, power, inverse=True).where(F.col("idx") < bins)
    re, im = _times(F.col("re"), F.col("im"), _chirp(F.col("idx"), step), -1)
    return folded.select(F.col("idx").alias("k"), (re / size).alias("re"), (im / size).alias("im"))


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """All events in order of time as one series, and their number."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", F.col("value").alias("x"))
    series = indexed(events, ["ts", "event_id"])
    return series.select("idx", "x"), series.count()


#: Bins whose values are compared; all of them are computed.
CHOSEN = [0, 1, 2, 5, 17, 100, 333, 900]


def q_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series whose transform has a prime number of bins."""
    series, n = _events(spark, sf_dir)
    prime = next_prime(n)
    found = chirp_z(series, prime, Fraction(0), Fraction(1, prime), n)
    whole = found.agg((F.sum(F.col("re") ** 2 + F.col("im") ** 2) / prime).alias("energy"))  # Parseval: all bins are right together
    return found.where(F.col("k").isin(CHOSEN)).crossJoin(F.broadcast(whole)).select("k", *(F.round(c, 3).alias(c) for c in ("re", "im")), F.round("energy", 1).alias("energy"))


_SERIES = "s AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, value AS x FROM events)"
PRIME_SQL = f"""
WITH {_SERIES}, c AS (SELECT count(*) AS n FROM s), p AS (SELECT min(q) AS p FROM (SELECT unnest(range(n, n + 300)) AS q FROM c) WHERE q > 1 AND len([d FOR d IN range(2, floor(sqrt(q))::bigint + 1) IF q % d = 0]) = 0),
d AS (SELECT k, sum(x * cos(2 * pi() * ((k * i) % p) / p)) AS re, -sum(x * sin(2 * pi() * ((k * i) % p) / p)) AS im FROM s, p, (SELECT unnest({CHOSEN}) AS k) GROUP BY k)
SELECT k, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im, (SELECT round(sum(x * x), 1) FROM s) AS energy FROM d
"""


def q_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band of frequencies in steps finer than the series' own bins."""
    series, n = _events(spark, sf_dir)
    found = chirp_z(series, 33, Fraction(1, 50), Fraction(1, 40_000), n)
    return found.select("k", *(F.round(c, 3).alias(c) for c in ("re", "im")))


ZOOM_SQL = f"""
WITH {_SERIES} SELECT k, round(sum(x * cos(2 * pi() * ((i * (800 + k)) % 40000) / 40000)), 3) + 0.0 AS re, round(-sum(x * sin(2 * pi() * ((i * (800 + k)) % 40000) / 40000)), 3) + 0.0 AS im
FROM s, (SELECT unnest(range(33)) AS k) GROUP BY k
"""

QUERIES = {"signal_chirp_prime": (q_prime, PRIME_SQL), "signal_chirp_zoom": (q_zoom, ZOOM_SQL)}
