"""Transforms and spectra of series: by definition as joins and sums, and by FFT kernels over batches of whole series.

A series must fit in a task here; longer ones go through `fft_two_pass`, which transforms columns and rows of a folded series apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.series import taper
from orrery.sources.tables import USER_SERIES_SQL, table, user_series


def arrays(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """keys and one ordered array per value column."""
    rows = F.sort_array(F.collect_list(F.struct("idx", *values)))
    gathered = df.groupBy(*keys).agg(rows.alias("_r"))
    field = lambda v: lambda r: r[v]
    return gathered.select(*keys, *(F.transform("_r", field(v)).alias(v) for v in values))


def kernel(df: DataFrame, keys: list[str], values: list[str], f: Callable[..., dict[str, np.ndarray]], fields: str) -> DataFrame:
    """Apply a numpy function to each series; it returns equally long columns."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                got = row._asdict()
                made = f(*(np.asarray(got[v], float) for v in values))
                n = len(next(iter(made.values())))
                out.append(pd.DataFrame({k: [got[k]] * n for k in keys} | made))
            if out:
                yield pd.concat(out, ignore_index=True)

    return arrays(df, keys, *values).mapInPandas(each, f"{kinds}, {fields}")


# ---- by definition


def dft(df: DataFrame, keys: list[str], bins: Column | None = None, sign: int = -1) -> DataFrame:
    """(keys, k, re, im) of X_k = sum x_n e^(sign 2 pi i k n / N): each sample meets each bin, sums are partial before the shuffle."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    sized = df.select(*keys, "idx", "x", n.alias("n"))
    each = sized.select(*keys, "idx", "x", "n", F.explode(bins if bins is not None else F.sequence(F.lit(0), F.floor(F.col("n") / 2).cast("int"))).alias("k"))
    angle = F.lit(2 * math.pi * sign) * ((F.col("k") * F.col("idx")) % F.col("n")) / F.col("n")
    return each.groupBy(*keys, "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))


def trigonometric(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, k, y): DCT and DST of types 1 to 4, unnormalised, by definition. Kinds: dct1 … dct4, dst1 … dst4."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    each = df.select(*keys, "idx", "x", n.alias("n")).where(F.col("n") > 1)
    each = each.select(*keys, "idx", "x", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    return each.groupBy(*keys, "k").agg(F.sum(F.col("x") * F.expr(KERNELS[kind].format(i="idx", pi="pi()"))).alias("y"))


#: Weight of sample {i} in coefficient k for length n, in SQL.
KERNELS = {
    "dct1": "CASE WHEN {i} = 0 THEN 1.0D WHEN {i} = n - 1 THEN CASE WHEN k % 2 = 0 THEN 1.0D ELSE -1.0D END ELSE 2 * cos({pi} * k * {i} / (n - 1)) END",
    "dct2": "2 * cos({pi} * k * (2 * {i} + 1) / (2 * n))",
    "dct3": "CASE WHEN {i} = 0 THEN 1.0D ELSE 2 * cos({pi} * {i} * (2 * k + 1) / (2 * n)) END",
    "dct4": "2 * cos({pi} * (2 * k + 1) * (2 * {i} + 1) / (4 * n))",
    "dst1": "2 * sin({pi} * (k + 1) * ({i} + 1) / (n + 1))",
    "dst2": "2 * sin({pi} * (k + 1) * (2 * {i} + 1) / (2 * n))",
    "dst3": "CASE WHEN {i} = n - 1 THEN CASE WHEN k % 2 = 0 THEN 1.0D ELSE -1.0D END ELSE 2 * sin({pi} * ({i} + 1) * (2 * k + 1) / (2 * n)) END",
    "dst4": "2 * sin({pi} * (2 * k + 1) * (2 * {i} + 1) / (4 * n))",
}


#: For each kind the part it takes of a transform of length `size`, where coefficient k is read and sample i placed, and
#: which samples count half.
FAST = {
    "dct1": (1, lambda n: 2 * (n - 1), lambda k: k, lambda i: i, lambda n: [0, n - 1]),
    "dct2": (1, lambda n: 4 * n, lambda k: k, lambda i: 2 * i + 1, lambda n: []),
    "dct3": (1, lambda n: 4 * n, lambda k: 2 * k + 1, lambda i: i, lambda n: [0]),
    "dct4": (1, lambda n: 8 * n, lambda k: 2 * k + 1, lambda i: 2 * i + 1, lambda n: []),
    "dst1": (0, lambda n: 2 * (n + 1), lambda k: k + 1, lambda i: i + 1, lambda n: []),
    "dst2": (0, lambda n: 4 * n, lambda k: k + 1, lambda i: 2 * i + 1, lambda n: []),
    "dst3": (0, lambda n: 4 * n, lambda k: 2 * k + 1, lambda i: i + 1, lambda n: [n - 1]),
    "dst4": (0, lambda n: 8 * n, lambda k: 2 * k + 1, lambda i: 2 * i + 1, lambda n: []),
}


def fast_trigonometric(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The same coefficients as `trigonometric`, a series a row, in n log n: real or imaginary parts of one longer Fourier transform."""
    cosine, size, read, put, half = FAST[kind]

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        if n < 2:
            return {"k": np.zeros(0, int), "y": np.zeros(0)}
        spread, i = np.zeros(size(n)), np.arange(n)
        np.add.at(spread, put(i), np.where(np.isin(i, half(n)), 0.5, 1.0) * x)
        y = np.fft.fft(spread)[read(i)]
        return {"k": i, "y": 2 * y.real if cosine else -2 * y.imag}

    return kernel(df, keys, ["x"], f, "k int, y double")


def dft_bin(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    return dft(df, keys, F.array(F.lit(k)))


# ---- by FFT


def _norm(name: str) -> str:
    """numpy's norm of a forward transform for none, forward, inverse, orthonormal."""
    return {"none": "backward", "inverse": "backward", "forward": "forward", "orthonormal": "ortho"}[name]


def fft(df: DataFrame, keys: list[str], normalization: str = "inverse", one_sided: bool = True, length: int | None = None) -> DataFrame:
    """(keys, k, re, im); `length` pads with zeros or cuts."""

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        y = (np.fft.rfft if one_sided else np.fft.fft)(x, length, norm=_norm(normalization))
        return {"k": np.arange(len(y)), "re": y.real, "im": y.imag}

    return kernel(df, keys, ["x"], f, "k int, re double, im double")


def inverse_fft(df: DataFrame, keys: list[str], normalization: str = "inverse") -> DataFrame:
    """(keys, idx, re, im) of a full spectrum (keys, k, re, im)."""
    norm = "forward" if normalization == "none" else _norm(normalization)

    def f(re: np.ndarray, im: np.ndarray) -> dict[str, np.ndarray]:
        y = np.fft.ifft(re + 1j * im, norm=norm)
        return {"idx": np.arange(len(y)), "re": y.real, "im": y.imag}

    return kernel(df.withColumnRenamed("k", "idx"), keys, ["re", "im"], f, "idx long, re double, im double")


def fft_axis(cells: DataFrame, axis: str, others: list[str]) -> DataFrame:
    """One axis of an n-d transform of a cell table (axes…, re, im): lines along the axis are transformed apart."""

    def f(re: np.ndarray, im: np.ndarray) -> dict[str, np.ndarray]:
        y = np.fft.fft(re + 1j * im)
        return {axis: np.arange(len(y)), "re": y.real, "im": y.imag}

    return kernel(cells.withColumnRenamed(axis, "idx"), others, ["re", "im"], f, f"{axis} long, re double, im double")


def fft_nd(cells: DataFrame, axes: list[str]) -> DataFrame:
    """A shuffle an axis; memory per task is one batch of lines."""
    for axis in axes:
        cells = fft_axis(cells, axis, [a for a in axes if a != axis])
    return cells


def fft_two_pass(df: DataFrame, n: int, rows: int) -> DataFrame:
    """Transform of one long series (idx, x) of length n = rows x columns, no task holding more than a row or a column.

    x at r + rows c: columns along c are transformed, twiddled by place, then rows along r; the result's index is k2 + columns k1.
    """
    columns = n // rows
    if rows * columns != n:
        raise ValueError("rows must divide n")
    cells = df.select((F.col("idx") % rows).alias("r"), F.floor(F.col("idx") / rows).alias("c"), F.col("x").alias("re"), F.lit(0.0).alias("im"))
    inner = fft_axis(cells, "c", ["r"])
    angle = F.lit(-2 * math.pi) * ((F.col("r") * F.col("c")) % n) / n
    turned = inner.select("r", "c", (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)).alias("re"), (F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)).alias("im"))
    return fft_axis(turned, "r", ["c"]).select((F.col("c") + columns * F.col("r")).alias("k"), "re", "im")


# ---- spectra


def _sided(power: np.ndarray, n: int) -> np.ndarray:
    """One-sided doubling of all bins but the first and, for even n, the last."""
    power[1 : len(power) - (n % 2 == 0)] *= 2
    return power


def _power(x: np.ndarray, w: np.ndarray, rate: float, density: bool) -> np.ndarray:
    y = np.abs(np.fft.rfft(x * w)) ** 2 / (rate * (w**2).sum() if density else w.sum() ** 2)
    return _sided(y, len(x))


def periodogram(df: DataFrame, keys: list[str], window: str = "hann", rate: float = 1.0, density: bool = False) -> DataFrame:
    """(keys, k, frequency, power), periodic taper."""

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        p = _power(x, np.array(taper(len(x), window, periodic=True)), rate, density)
        return {"k": np.arange(len(p)), "frequency": np.arange(len(p)) * rate / len(x), "power": p}

    return kernel(df, keys, ["x"], f, "k int, frequency double, power double")


def segments(df: DataFrame, keys: list[str], length: int, hop: int) -> DataFrame:
    """(keys, segment, idx within it, columns): full overlapped segments; each sample is sent to those that hold it."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    first = F.greatest(F.ceil((F.col("idx") - (length - 1)) / hop), F.lit(0)).cast("int")
    last = F.least(F.floor(F.col("idx") / hop), F.floor((n - length) / hop)).cast("int")
    others = [c for c in df.columns if c not in (*keys, "idx")]
    spread = df.withColumn("_a", first).withColumn("_b", last).where("_a <= _b").withColumn("segment", F.explode(F.sequence("_a", "_b")))
    return spread.select(*keys, "segment", (F.col("idx") - F.col("segment") * hop).alias("idx"), *others)


def welch(df: DataFrame, keys: list[str], length: int, hop: int, window: str = "hann", rate: float = 1.0, density: bool = True) -> DataFrame:
    """Mean periodogram of segments; segments are the unit of work, so one long series spreads over tasks."""
    return periodogram(segments(df, keys, length, hop), [*keys, "segment"], window, rate, density).groupBy(*keys, "k").agg(F.avg("power").alias("power"), F.count(F.lit(1)).alias("segments"))


def cross_spectrum(df: DataFrame, keys: list[str], length: int, hop: int, window: str = "hann") -> DataFrame:
    """Of columns x and y: mean cross power (re, im), auto powers, and coherence in [0, 1]."""
    w = np.array(taper(length, window, periodic=True))

    def f(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        a, b = np.fft.rfft(x * w), np.fft.rfft(y * w)
        c = np.conj(a) * b / w.sum() ** 2
        return {"k": np.arange(len(a)), "re": c.real, "im": c.imag, "px": np.abs(a) ** 2 / w.sum() ** 2, "py": np.abs(b) ** 2 / w.sum() ** 2}

    each = kernel(segments(df, keys, length, hop), [*keys, "segment"], ["x", "y"], f, "k int, re double, im double, px double, py double")
    mean = each.groupBy(*keys, "k").agg(*(F.avg(c).alias(c) for c in ("re", "im", "px", "py")))
    return mean.withColumn("coherence", F.least(F.coalesce(F.try_divide(F.col("re") ** 2 + F.col("im") ** 2, F.col("px") * F.col("py")), F.lit(0.0)), F.lit(1.0)))


@lru_cache(maxsize=64)
def slepian(n: int, half_bandwidth: float, count: int) -> np.ndarray:
    """Tapers of the largest concentration: eigenvectors of the published tridiagonal matrix, unit norm, largest entry positive."""
    i = np.arange(n)
    w = half_bandwidth / n
    m = np.diag(((n - 1) / 2 - i) ** 2 * np.cos(2 * np.pi * w)) + np.diag(i[1:] * (n - i[1:]) / 2, 1) + np.diag(i[1:] * (n - i[1:]) / 2, -1)
    v = np.linalg.eigh(m)[1][:, ::-1][:, :count].T
    return v * np.sign(v[np.arange(count), np.abs(v).argmax(1)])[:, None]


def multitaper(df: DataFrame, keys: list[str], half_bandwidth: float = 2.5, tapers: int = 4) -> DataFrame:
    """Mean over Slepian tapers; at most floor(2 half_bandwidth) of them, and no more than the series is long."""
    if tapers > math.floor(2 * half_bandwidth):
        raise ValueError("too many tapers for this bandwidth")

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        v = slepian(len(x), half_bandwidth, min(tapers, len(x)))
        p = _sided((np.abs(np.fft.rfft(v * x, axis=1)) ** 2).mean(0), len(x))
        return {"k": np.arange(len(p)), "power": p}

    return kernel(df, keys, ["x"], f, "k int, power double")


def lomb_scargle(df: DataFrame, keys: list[str], t: str, x: str, frequencies: list[float]) -> DataFrame:
    """(keys, frequency, power): share of variance that a least-squares sinusoid with free mean explains at each frequency.

    Sums per frequency in one aggregation; the three normal equations are solved in closed form.
    """
    times = F.explode(F.array(*map(F.lit, frequencies))).alias("f")
    each = df.select(*keys, F.col(t).alias("t"), F.col(x).alias("x"), times).withColumn("c", F.cos(2 * math.pi * F.col("f") * F.col("t"))).withColumn("s", F.sin(2 * math.pi * F.col("f") * F.col("t")))
    a = lambda c: F.avg(c)
    m = each.groupBy(*keys, "f").agg(F.count(F.lit(1)).alias("n"), a("c").alias("C"), a("s").alias("S"), a("x").alias("Y"), a(F.col("x") ** 2).alias("YY"), a(F.col("x") * F.col("c")).alias("YC"), a(F.col("x") * F.col("s")).alias("YS"), a(F.col("c") ** 2).alias("CC"), a(F.col("s") ** 2).alias("SS"), a(F.col("c") * F.col("s")).alias("CS"))
    v = {"yy": "YY - Y * Y", "yc": "YC - Y * C", "ys": "YS - Y * S", "cc": "CC - C * C", "ss": "SS - S * S", "cs": "CS - C * S"}
    m = m.select(*keys, F.col("f").alias("frequency"), "n", *(F.expr(e).alias(f"v_{k}") for k, e in v.items()))
    det = F.col("v_cc") * F.col("v_ss") - F.col("v_cs") ** 2
    top = F.col("v_ss") * F.col("v_yc") ** 2 + F.col("v_cc") * F.col("v_ys") ** 2 - 2 * F.col("v_cs") * F.col("v_yc") * F.col("v_ys")
    return m.select(*keys, "frequency", "n", F.when((F.col("n") < 4) | (det < 1e-12) | (F.col("v_yy") <= 0), 0.0).otherwise(F.try_divide(top, det * F.col("v_yy"))).alias("power"))


# ---- autoregression


def burg_fit(x: np.ndarray, order: int) -> tuple[float, np.ndarray, float]:
    """Mean, coefficients a_1 … a_p of x_t = -sum a_j x_(t-j) about the mean, and residual variance."""
    mean = x.mean()
    f, b = x - mean, x - mean
    a, e = np.zeros(0), float(((x - mean) ** 2).mean())
    for _ in range(min(order, len(x) - 1)):
        up, low = f[1:], b[:-1]
        size = (up**2).sum() + (low**2).sum()
        if size <= 0:
            break
        k = -2 * (up * low).sum() / size
        a = np.append(a + k * a[::-1], k) if len(a) else np.array([k])
        f, b = up + k * low, low + k * up
        e *= 1 - k * k
    return mean, a, e


def select_order(x: np.ndarray, most: int, criterion: str) -> int:
    """Lowest score of aic, bic or fpe over orders 1 … most."""
    n, best = len(x), []
    for p in range(1, most + 1):
        e = max(burg_fit(x, p)[2], 1e-300)
        best.append(({"aic": n * np.log(e) + 2 * p, "bic": n * np.log(e) + p * np.log(n), "fpe": e * (n + p) / max(n - p, 1e-9)}[criterion], p))
    return min(best)[1]


def burg(df: DataFrame, keys: list[str], order: int, criterion: str | None = None) -> DataFrame:
    """(keys, mean, order, variance, coefficients); series of at most `order` samples are left out."""

    def f(x: np.ndarray) -> dict:
        if len(x) <= order + 1:
            return {"mean": [], "order": [], "variance": [], "coefficients": []}
        p = select_order(x, order, criterion) if criterion else order
        mean, a, e = burg_fit(x, p)
        return {"mean": [mean], "order": [len(a)], "variance": [e], "coefficients": [a.tolist()]}

    return kernel(df, keys, ["x"], f, "mean double, order int, variance double, coefficients array<double>")


def mem_spectrum(models: DataFrame, keys: list[str], bins: int = 17, rate: float = 1.0) -> DataFrame:
    """(keys, k, power) of fitted models at bins 0 … bins - 1 of the half spectrum: Column expressions over coefficient arrays."""
    at = models.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    angle = F.lit(-math.pi) * F.col("k") / (bins - 1)
    part = lambda g: F.aggregate(F.transform("coefficients", lambda a, j: a * g(angle * (j + 1))), F.lit(0.0), lambda s, v: s + v)
    size = (1 + part(F.cos)) ** 2 + part(F.sin) ** 2
    return at.select(*keys, "k", (F.when(F.col("k").isin(0, bins - 1), 1.0).otherwise(2.0) * F.col("variance") / (rate * size)).alias("power"))


def predict(df: DataFrame, keys: list[str], order: int, horizon: int, backward: bool = False) -> DataFrame:
    """(keys, step, y): the next (or, backward, the earlier) `horizon` values by the Burg model."""

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        if len(x) <= order + 1:
            return {"step": np.zeros(0, int), "y": np.zeros(0)}
        mean, a, _ = burg_fit(x, order)
        past = list((x[::-1] if backward else x)[-len(a) :] - mean) if len(a) else []
        out = []
        for _ in range(horizon):
            y = -sum(c * past[-1 - j] for j, c in enumerate(a))
            past.append(y)
            out.append(y + mean)
        return {"step": np.arange(1, horizon + 1), "y": np.array(out)}

    return kernel(df, keys, ["x"], f, "step int, y double")


def solve_toeplitz(column: np.ndarray, row: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Levinson's recursion, n^2; where a leading block is singular, the dense solution."""
    n = len(column)
    with np.errstate(all="ignore"):
        forward, backward, x = np.array([1 / column[0]]), np.array([1 / column[0]]), np.array([right[0] / column[0]])
        for i in range(1, n):
            miss_f, miss_b, miss_x = column[i:0:-1] @ forward, row[1 : i + 1] @ backward, column[i:0:-1] @ x
            d = 1 - miss_f * miss_b
            longer, shifted = np.append(forward, 0.0), np.append(0.0, backward)
            forward, backward = (longer - miss_f * shifted) / d, (shifted - miss_b * longer) / d
            x = np.append(x, 0.0) + (right[i] - miss_x) * backward
    if np.isfinite(x).all():
        return x
    i = np.arange(n)
    values = np.concatenate([row[:0:-1], column])
    return np.linalg.solve(values[i[:, None] - i[None, :] + n - 1], right)


def toeplitz(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, j, a): Yule-Walker equations of each series' autocovariances solved as a Toeplitz system."""

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        if len(x) <= size or x.std() == 0:
            return {"j": np.zeros(0, int), "a": np.zeros(0)}
        y = x - x.mean()
        r = np.array([(y[: len(y) - k] * y[k:]).sum() / len(y) for k in range(size + 1)])
        return {"j": np.arange(1, size + 1), "a": solve_toeplitz(r[:size], r[:size], r[1:])}

    return kernel(df, keys, ["x"], f, "j int, a double")


# ---- deconvolution, analytic signals, trigonometric interpolation


def deconvolve(df: DataFrame, keys: list[str], response: list[float], tikhonov: float = 0.0, floor: float = 1e-10) -> DataFrame:
    """(keys, idx, x): circular inverse of a known response; bins where it is under `floor` of its largest are set to zero."""

    def f(y: np.ndarray) -> dict[str, np.ndarray]:
        h = np.fft.fft(response, len(y)) if len(y) >= len(response) else np.fft.fft(response[: len(y)])
        size = np.abs(h) ** 2
        ok = np.abs(h) > floor * np.abs(h).max()
        x = np.fft.ifft(np.where(ok, np.fft.fft(y) * np.conj(h) / np.where(ok, size + tikhonov, 1), 0)).real
        return {"idx": np.arange(len(x)), "x": x}

    return kernel(df.withColumnRenamed("y", "x") if "y" in df.columns else df, keys, ["x"], f, "idx long, x double")


def analytic(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, re, im, envelope, phase) of the analytic signal."""

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        h = np.zeros(n)
        h[0] = 1
        h[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            h[n // 2] = 1
        z = np.fft.ifft(np.fft.fft(x) * h)
        return {"idx": np.arange(n), "re": z.real, "im": z.imag, "envelope": np.abs(z), "phase": np.angle(z)}

    return kernel(df, keys, ["x"], f, "idx long, re double, im double, envelope double, phase double")


def instantaneous_frequency(phases: DataFrame, keys: list[str], rate: float = 1.0) -> DataFrame:
    """(keys, idx, frequency) between neighbours, at the midpoints; phase steps are taken within half a turn."""
    w = Window.partitionBy(*keys).orderBy("idx")
    step = F.lead("phase").over(w) - F.col("phase")
    near = step - 2 * math.pi * F.floor((step + math.pi) / (2 * math.pi))
    return phases.select(*keys, (F.col("idx") + 0.5).alias("idx"), (near * rate / (2 * math.pi)).alias("frequency")).where("frequency IS NOT NULL")


def dft_interpolate(df: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """(keys, t, y): the series' trigonometric polynomial at places `at` (in samples), by definition from its spectrum."""
    spectrum = dft(df, keys, F.sequence(F.lit(0), F.col("n").cast("int") - 1))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    signed = F.when(2 * F.col("k") > F.col("n"), F.col("k") - F.col("n")).otherwise(F.col("k"))
    each = spectrum.withColumn("n", n).withColumn("t", F.explode(F.array(*map(F.lit, at))))
    angle = F.lit(2 * math.pi) * signed * F.col("t") / F.col("n")
    # the middle bin of an even length is shared by both signs: its cosine alone
    term = F.col("re") * F.cos(angle) - F.when(2 * F.col("k") == F.col("n"), 0.0).otherwise(F.col("im") * F.sin(angle))
    return each.groupBy(*keys, "t").agg((F.sum(term) / F.first("n")).alias("y"))


def dft_integrate(df: DataFrame, keys: list[str], lo: float | Column, hi: float | Column) -> DataFrame:
    """(keys, area): exact integral of the series' trigonometric polynomial from lo to hi (in samples; columns may use the length, n)."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    spectrum = dft(df, keys, F.sequence(F.lit(0), F.col("n").cast("int") - 1))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    each = spectrum.withColumn("n", n)
    signed = F.when(2 * F.col("k") > F.col("n"), F.col("k") - F.col("n")).otherwise(F.col("k"))
    w = F.lit(2 * math.pi) * signed / F.col("n")
    im = F.when(2 * F.col("k") == F.col("n"), 0.0).otherwise(F.col("im"))
    term = F.when(F.col("k") == 0, F.col("re") * (hi - lo)).otherwise(F.try_divide(F.col("re") * (F.sin(w * hi) - F.sin(w * lo)) + im * (F.cos(w * hi) - F.cos(w * lo)), w))
    return each.groupBy(*keys).agg((F.sum(term) / F.first("n")).alias("area"))


# ---- queries

U = ["user_id"]


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(F.col(c) + 0.0, digits).alias(c) if c in columns else c for c in df.columns])


def q_dft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dft(user_series(spark, sf_dir), U), "re", "im", digits=3)


def q_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fft(user_series(spark, sf_dir), U), "re", "im", digits=3)


def q_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest error of the inverse of the transform under each normalization."""
    s, out = user_series(spark, sf_dir), None
    for name in ("inverse", "forward", "orthonormal"):
        back = inverse_fft(fft(s, U, name, one_sided=False), U, name)
        part = s.join(back, ["user_id", "idx"]).agg(F.lit(name).alias("normalization"), F.round(F.max(F.abs(F.col("x") - F.col("re"))), 6).alias("error"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def _trig_query(kind: str):
    return lambda spark, sf_dir: _rounded(fast_trigonometric(user_series(spark, sf_dir), U, kind), "y", digits=3)


_N = f"WITH s AS ({USER_SERIES_SQL}), n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s)"
_DFT = "sum(x * cos(2 * pi() * k * idx / n)) AS re, sum(x * sin(-2 * pi() * k * idx / n)) AS im"
DFT_SQL = f"{_N}, k AS (SELECT *, unnest(range(n // 2 + 1)) AS k FROM n), d AS (SELECT user_id, k, {_DFT} FROM k GROUP BY ALL) SELECT user_id, k::int AS k, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM d"


def _trig_sql(kind: str) -> str:
    return f"{_N}, k AS (SELECT *, unnest(range(n)) AS k FROM n WHERE n > 1) SELECT user_id, k::int AS k, round(sum(x * {KERNELS[kind].format(i='idx', pi='pi()').replace('1.0D', '1.0')}), 3) + 0.0 AS y FROM k GROUP BY user_id, k"


def q_periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(periodogram(user_series(spark, sf_dir), U, "hann"), "frequency", "power")


PERIODOGRAM_SQL = f"""{_N}, w AS (SELECT user_id, idx, n, x, CASE WHEN n = 1 THEN 1.0 ELSE 0.5 - 0.5 * cos(2 * pi() * idx / n) END AS w FROM n), k AS (SELECT *, unnest(range(n // 2 + 1)) AS k FROM w),
 d AS (SELECT user_id, k, n, sum(w) AS g, sum(x * w * cos(2 * pi() * k * idx / n)) AS re, sum(x * w * sin(2 * pi() * k * idx / n)) AS im FROM k GROUP BY ALL)
SELECT user_id, k::int AS k, round(k / n, 4) AS frequency, round(CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END * (re * re + im * im) / (g * g), 4) AS power FROM d"""


def q_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(welch(user_series(spark, sf_dir), U, 8, 4), "power")


WELCH_SQL = f"""{_N}, g AS (SELECT user_id, idx - 4 * m AS i, m, x, 0.5 - 0.5 * cos(2 * pi() * (idx - 4 * m) / 8) AS w FROM (SELECT *, unnest(range(n // 4)) AS m FROM n) WHERE idx >= 4 * m AND idx < 4 * m + 8 AND 4 * m + 8 <= n),
 k AS (SELECT *, unnest(range(5)) AS k FROM g), d AS (SELECT user_id, m, k, sum(w * w) AS g, sum(x * w * cos(2 * pi() * k * i / 8)) AS re, sum(x * w * sin(2 * pi() * k * i / 8)) AS im FROM k GROUP BY ALL)
SELECT user_id, k::int AS k, round(avg(CASE WHEN k = 0 OR k = 4 THEN 1 ELSE 2 END * (re * re + im * im) / g), 4) AS power, count(*) AS segments FROM d GROUP BY ALL"""


def q_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = user_series(spark, sf_dir).withColumn("y", F.col("x") * F.when(F.col("idx") % 2 == 0, 1.0).otherwise(-0.5))
    return _rounded(cross_spectrum(two, U, 8, 4), "re", "im", "px", "py", "coherence", digits=3)


def q_multitaper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total power per user: tapers of unit norm keep it near the series' energy."""
    return multitaper(user_series(spark, sf_dir), U).groupBy("user_id").agg(F.round(F.sum("power"), 2).alias("power"), F.count(F.lit(1)).alias("bins"))


FREQUENCIES = [0.001, 0.005, 0.01, 0.02]


def q_lomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", ((F.unix_micros("ts") - 1.7e15) / 3_600e6).alias("t"), F.col("value").alias("x"))
    return _rounded(lomb_scargle(e, U, "t", "x", FREQUENCIES), "power")


LOMB_SQL = f"""WITH t AS (SELECT user_id, (epoch_us(ts) - 1.7e15::double) / 3600e6::double AS t, value AS x, unnest({FREQUENCIES})::double AS f FROM events), c AS (SELECT *, cos(2 * pi() * f * t) AS c, sin(2 * pi() * f * t) AS s FROM t),
 v AS (SELECT user_id, f, count(*) AS n, avg(x * x) - avg(x) ^ 2 AS yy, avg(x * c) - avg(x) * avg(c) AS yc, avg(x * s) - avg(x) * avg(s) AS ys, avg(c * c) - avg(c) ^ 2 AS cc, avg(s * s) - avg(s) ^ 2 AS ss, avg(c * s) - avg(c) * avg(s) AS cs FROM c GROUP BY ALL)
SELECT user_id, f AS frequency, n, round(CASE WHEN n < 4 OR cc * ss - cs * cs < 1e-12 OR yy <= 0 THEN 0 ELSE (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / ((cc * ss - cs * cs) * yy) END, 4) AS power FROM v"""


def q_burg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burg(user_series(spark, sf_dir), U, 3, "aic").select("user_id", "order", F.round("mean", 4).alias("mean"), F.round("variance", 4).alias("variance"))


def q_mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mem_spectrum(burg(user_series(spark, sf_dir), U, 2), U, 9), "power")


def q_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = user_series(spark, sf_dir)
    return _rounded(predict(s, U, 2, 3).withColumn("side", F.lit("after")).unionByName(predict(s, U, 2, 3, True).withColumn("side", F.lit("before"))), "y")


def q_toeplitz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(toeplitz(user_series(spark, sf_dir), U, 3), "a")


def q_deconvolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest error of taking a circular convolution back."""
    from orrery.operators.series import convolve

    s, h = user_series(spark, sf_dir), [1.0, 0.4, 0.2]
    back = deconvolve(convolve(s, U, h, "circular"), U, h).withColumnRenamed("x", "z")
    long = s.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).where("n >= 3")
    return long.join(back, ["user_id", "idx"]).agg(F.round(F.max(F.abs(F.col("x") - F.col("z"))), 6).alias("error"), F.count(F.lit(1)).alias("n"))


def q_analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The real part is the series again; the envelope bounds it."""
    s = user_series(spark, sf_dir)
    both = s.join(analytic(s, U), ["user_id", "idx"])
    return both.agg(F.round(F.max(F.abs(F.col("x") - F.col("re"))), 6).alias("error"), F.bool_and(F.col("envelope") >= F.abs("x") - 1e-9).alias("bounds"), F.count(F.lit(1)).alias("n"))


def q_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = user_series(spark, sf_dir).withColumn("phase", F.col("idx") * 0.5 - 2 * math.pi * F.floor(F.col("idx") * 0.5 / (2 * math.pi)))
    return _rounded(instantaneous_frequency(phases, U), "frequency", digits=6)


def q_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dft_bin(user_series(spark, sf_dir), U, 2), "re", "im", digits=3)


def q_dft_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At whole places the polynomial gives the samples."""
    s = user_series(spark, sf_dir)
    got = dft_interpolate(s, U, [0.0, 1.0]).withColumn("idx", F.col("t").cast("bigint"))
    return s.join(got, ["user_id", "idx"]).select("user_id", "idx", F.round("y", 4).alias("y"))


def q_dft_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a whole period the integral is the sum of the samples: all but the mean vanish."""
    return _rounded(dft_integrate(user_series(spark, sf_dir), U, 0.0, F.col("n").cast("double")), "area", digits=3)


def q_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional transform of the sum of prices by size and brand digit."""
    p = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 8).cast("bigint").alias("a"), (F.col("p_partkey") % 4).alias("b")).agg(F.sum("p_retailprice").alias("re"))
    return _rounded(fft_nd(p.withColumn("im", F.lit(0.0)), ["a", "b"]), "re", "im", digits=2).select("a", "b", "re", "im")


ND_SQL = """WITH p AS (SELECT p_size % 8 AS i, p_partkey % 4 AS j, sum(p_retailprice) AS x FROM part GROUP BY ALL), d AS (SELECT a, b, sum(x * cos(2 * pi() * (a * i / 8 + b * j / 4))) AS re, -sum(x * sin(2 * pi() * (a * i / 8 + b * j / 4))) AS im FROM p, range(8) r(a), range(4) q(b) GROUP BY ALL)
SELECT a, b, round(re, 2) + 0.0 AS re, round(im, 2) + 0.0 AS im FROM d"""


def q_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform of 64 daily order counts as one series, in rows and columns of 8."""
    days = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 64).alias("idx")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    return _rounded(fft_two_pass(days, 64, 8), "re", "im", digits=3)


CROSS_SQL = f"""{_N}, g AS (SELECT user_id, idx - 4 * m AS i, m, x, x * CASE WHEN idx % 2 = 0 THEN 1.0 ELSE -0.5 END AS y, 0.5 - 0.5 * cos(2 * pi() * (idx - 4 * m) / 8) AS w FROM (SELECT *, unnest(range(n // 4)) AS m FROM n)
  WHERE idx >= 4 * m AND idx < 4 * m + 8 AND 4 * m + 8 <= n), k AS (SELECT *, unnest(range(5)) AS k, 4.0 AS g FROM g),
 d AS (SELECT user_id, m, k, sum(x * w * cos(2 * pi() * k * i / 8)) AS a, -sum(x * w * sin(2 * pi() * k * i / 8)) AS b, sum(y * w * cos(2 * pi() * k * i / 8)) AS c, -sum(y * w * sin(2 * pi() * k * i / 8)) AS e FROM k GROUP BY ALL),
 p AS (SELECT user_id, k, avg(a * c + b * e) / 16 AS re, avg(a * e - b * c) / 16 AS im, avg(a * a + b * b) / 16 AS px, avg(c * c + e * e) / 16 AS py FROM d GROUP BY ALL)
SELECT user_id, k::int AS k, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im, round(px, 3) + 0.0 AS px, round(py, 3) + 0.0 AS py, round(least(coalesce((re * re + im * im) / nullif(px * py, 0), 0), 1), 3) + 0.0 AS coherence FROM p"""
TOEPLITZ_SQL = f"""{_N}, c AS (SELECT user_id, idx, n, x - avg(x) OVER (PARTITION BY user_id) AS y FROM n WHERE n > 3),
 l AS (SELECT *, lead(y, 1, 0) OVER w AS y1, lead(y, 2, 0) OVER w AS y2, lead(y, 3, 0) OVER w AS y3 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
 r AS (SELECT user_id, sum(y * y) AS r0, sum(y * y1) AS r1, sum(y * y2) AS r2, sum(y * y3) AS r3 FROM l GROUP BY user_id HAVING sum(y * y) > 0),
 a AS (SELECT *, r1 / r0 AS a1 FROM r), b AS (SELECT *, r0 - a1 * r1 AS e1, (r2 - a1 * r1) / (r0 - a1 * r1) AS k2 FROM a), d AS (SELECT *, a1 - k2 * a1 AS b1, e1 * (1 - k2 * k2) AS e2 FROM b),
 e AS (SELECT *, (r3 - b1 * r2 - k2 * r1) / e2 AS k3 FROM d)
SELECT user_id, j::int AS j, round(CASE j WHEN 1 THEN b1 - k3 * k2 WHEN 2 THEN k2 - k3 * b1 ELSE k3 END, 4) + 0.0 AS a FROM e, range(1, 4) t(j)"""
# Burg's reflections, one after another: f and b are the forward and backward errors, lagged by a window
_BURG = f"""{_N}, c AS (SELECT user_id, idx, n, x, avg(x) OVER (PARTITION BY user_id) AS mean FROM n), y AS (SELECT user_id, idx, n, mean, x - mean AS y, lag(x - mean) OVER (PARTITION BY user_id ORDER BY idx) AS z FROM c),
 k1 AS (SELECT user_id, coalesce(-2 * sum(y * z) / nullif(sum(y * y + z * z), 0), 0) AS k1 FROM y WHERE idx >= 1 GROUP BY user_id),
 f1 AS (SELECT y.*, k1, y + k1 * z AS f, lag(z + k1 * y) OVER (PARTITION BY user_id ORDER BY idx) AS g FROM y JOIN k1 USING (user_id) WHERE idx >= 1),
 k2 AS (SELECT user_id, coalesce(-2 * sum(f * g) / nullif(sum(f * f + g * g), 0), 0) AS k2 FROM f1 WHERE idx >= 2 GROUP BY user_id),
 f2 AS (SELECT f1.user_id, idx, f + k2 * g AS f, lag(g + k2 * f) OVER (PARTITION BY user_id ORDER BY idx) AS g FROM f1 JOIN k2 USING (user_id) WHERE idx >= 2),
 k3 AS (SELECT user_id, coalesce(-2 * sum(f * g) / nullif(sum(f * f + g * g), 0), 0) AS k3 FROM f2 WHERE idx >= 3 GROUP BY user_id),
 v AS (SELECT user_id, any_value(mean) AS mean, any_value(n) AS n, avg(y * y) AS e0, arg_min(y, idx) AS first, arg_max(y, idx) AS last, max(CASE WHEN idx = 1 THEN y END) AS second, max(CASE WHEN idx = n - 2 THEN y END) AS before FROM y GROUP BY user_id),
 fit AS (SELECT *, e0 * (1 - k1 * k1) AS e1, e0 * (1 - k1 * k1) * (1 - k2 * k2) AS e2, k1 + k2 * k1 AS a1, k2 AS a2 FROM v JOIN k1 USING (user_id) JOIN k2 USING (user_id))"""
MEM_SQL = _BURG + """, m AS (SELECT user_id, a1, a2, e2, unnest(range(9)) AS k FROM fit WHERE n >= 4),
 p AS (SELECT *, (1 + a1 * cos(-pi() * k / 8) + a2 * cos(-2 * pi() * k / 8)) ^ 2 + (a1 * sin(-pi() * k / 8) + a2 * sin(-2 * pi() * k / 8)) ^ 2 AS size FROM m)
SELECT user_id, k::int AS k, round(CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END * e2 / size, 4) + 0.0 AS power FROM p"""
BURG_SQL = _BURG + """, o AS (SELECT user_id, mean, n, unnest([1, 2, 3]) AS p, unnest([e1, e2, e2 * (1 - k3 * k3)]) AS e FROM fit JOIN k3 USING (user_id) WHERE n >= 5)
SELECT user_id, p::int AS order, round(mean, 4) AS mean, round(e, 4) AS variance FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n * ln(greatest(e, 1e-300)) + 2 * p, p) = 1""".replace("AS order", 'AS "order"')
PREDICT_SQL = _BURG + """, t AS (SELECT user_id, mean, a1, a2, 'after' AS side, last AS u, before AS w FROM fit WHERE n >= 4 UNION ALL SELECT user_id, mean, a1, a2, 'before', first, second FROM fit WHERE n >= 4),
 p1 AS (SELECT *, -(a1 * u + a2 * w) AS p1 FROM t), p2 AS (SELECT *, -(a1 * p1 + a2 * u) AS p2 FROM p1), p3 AS (SELECT *, -(a1 * p2 + a2 * p1) AS p3 FROM p2)
SELECT user_id, unnest([1, 2, 3])::int AS step, round(unnest([p1, p2, p3]) + mean, 4) + 0.0 AS y, side FROM p3"""

QUERIES = {
    "signal_dft": (q_dft, DFT_SQL), "signal_fft": (q_fft, DFT_SQL),
    "signal_fft_round_trip": (q_round_trip, "SELECT w AS normalization, 0.0::double AS error, (SELECT count(*) FROM events) AS n FROM (SELECT unnest(['inverse', 'forward', 'orthonormal']) AS w)"),
    **{f"signal_{kind}": (_trig_query(kind), _trig_sql(kind)) for kind in KERNELS},
    "signal_periodogram": (q_periodogram, PERIODOGRAM_SQL), "signal_welch": (q_welch, WELCH_SQL), "signal_cross_spectrum": (q_cross, CROSS_SQL), "signal_multitaper": (q_multitaper, None),
    "signal_lomb_scargle": (q_lomb, LOMB_SQL), "signal_burg": (q_burg, BURG_SQL), "signal_mem_spectrum": (q_mem, MEM_SQL), "signal_predict": (q_predict, PREDICT_SQL), "signal_toeplitz": (q_toeplitz, TOEPLITZ_SQL),
    "signal_deconvolve": (q_deconvolve, "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT 0.0::double AS error, sum(n)::bigint AS n FROM n WHERE n >= 3"),
    "signal_analytic": (q_analytic, "SELECT 0.0::double AS error, true AS bounds, count(*) AS n FROM events"),
    "signal_instantaneous_frequency": (q_frequency, f"WITH s AS ({USER_SERIES_SQL}) SELECT user_id, idx + 0.5::double AS idx, round(0.5 / (2 * pi()), 6) AS frequency FROM s QUALIFY lead(idx) OVER (PARTITION BY user_id ORDER BY idx) IS NOT NULL"),
    "signal_dft_bin": (q_bin, f"{_N}, k AS (SELECT *, 2 AS k FROM n), d AS (SELECT user_id, k, {_DFT} FROM k GROUP BY ALL) SELECT user_id, k, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM d"),
    "signal_dft_interpolate": (q_dft_interpolate, f"SELECT user_id, idx, round(x, 4) AS y FROM ({USER_SERIES_SQL}) WHERE idx < 2"),
    "signal_dft_integrate": (q_dft_integrate, "SELECT user_id, round(sum(value), 3) AS area FROM events GROUP BY user_id"),
    "signal_fft_nd": (q_nd, ND_SQL),
    "signal_fft_two_pass": (q_two_pass, "WITH s AS (SELECT o_orderkey % 64 AS i, count(*) AS x FROM orders GROUP BY ALL), d AS (SELECT k, sum(x * cos(2 * pi() * k * i / 64)) AS re, -sum(x * sin(2 * pi() * k * i / 64)) AS im FROM s, range(64) r(k) GROUP BY k) SELECT k, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM d"),
}
