"""Ordered series: convolution, correlation, smoothing, phase, interpolation, wavelets and envelopes by joins and windows.

A series is (keys…, idx, x); windows deal series by their keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.tridiagonal import solve_rows
from orrery.sources.scratch import staged
from orrery.sources.tables import USER_SERIES_SQL, series, spread, table, user_series


def _along(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("idx")


def convolve(df: DataFrame, keys: list[str], kernel: list[float], span: str = "full", normalize: bool = False) -> DataFrame:
    """Convolution with a short kernel. Spans: full, same (offset (k - 1) div 2), valid, circular.

    `same` and `valid` read lagged values in one window pass; `full` and `circular` spread each sample over the kernel's taps and sum by
    place. `normalize` divides the kernel by its sum.
    """
    k = len(kernel)
    h = [v / sum(kernel) for v in kernel] if normalize else list(kernel)
    if span in ("same", "valid"):
        w, lead = _along(keys), (k - 1) // 2 if span == "same" else 0
        y = sum((F.coalesce(F.lag("x", j - lead).over(w), F.lit(0.0)) * v for j, v in enumerate(h)), F.lit(0.0))
        out = df.select(*keys, "idx", y.alias("y"))
        return out if span == "same" else out.where(F.col("idx") >= k - 1).select(*keys, (F.col("idx") - (k - 1)).alias("idx"), "y")
    taps = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(v)).alias("h")) for j, v in enumerate(h)])).alias("tap")
    if span == "circular":
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        spread = df.select(*keys, "idx", "x", n.alias("n")).select(*keys, "idx", "x", "n", taps).select(*keys, ((F.col("idx") + F.col("tap.j")) % F.col("n")).alias("idx"), (F.col("x") * F.col("tap.h")).alias("y"))
    elif span == "full":
        spread = df.select(*keys, "idx", "x", taps).select(*keys, (F.col("idx") + F.col("tap.j")).alias("idx"), (F.col("x") * F.col("tap.h")).alias("y"))
    else:
        raise ValueError(f"unknown span {span}")
    return spread.groupBy(*keys, "idx").agg(F.sum("y").alias("y"))


def convolution_cost(n: int, k: int) -> dict[str, int]:
    """Cost units of both forms: direct n k, spectral 3 N log2 N + N with N the next power of two that holds n + k - 1."""
    size = 1 << max(0, (n + k - 2)).bit_length()
    return {"direct": n * k, "fft": 3 * size * size.bit_length() + size}


def convolve_blocks(df: DataFrame, keys: list[str], kernel: list[float], block: int = 4096) -> DataFrame:
    """Overlap-add for series too long for one task: blocks of `block` samples are convolved alone (by FFT) and sums meet by place."""
    h = np.asarray(kernel, float)
    parts = df.withColumn("block", F.floor(F.col("idx") / block)).groupBy(*keys, "block").agg(F.min("idx").alias("first"), F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("rows"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, r in batch.iterrows():
                x = np.array([s["x"] for s in r["rows"]])
                size = 1 << (len(x) + len(h) - 2).bit_length()
                y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[: len(x) + len(h) - 1] if size > 1 else x * h[0]
                yield pd.DataFrame({k: r[k] for k in keys} | {"idx": r["first"] + np.arange(len(y)), "y": y})

    return parts.select(*keys, "first", "rows").mapInPandas(each, f"{kinds}, idx long, y double").groupBy(*keys, "idx").agg(F.sum("y").alias("y"))


def convolve_overlap_save(df: DataFrame, keys: list[str], kernel: list[float], block: int = 4096) -> DataFrame:
    """Overlap-save: each block also gets the last len(kernel) - 1 samples before it, is convolved in a circle and drops what wraps
    around. A place comes from one block alone, so nothing is summed afterwards. Places of a series must have no gaps."""
    h = np.asarray(kernel, float)
    past = len(h) - 1
    if block < max(past, 1):
        raise ValueError("a block must hold the kernel's past")
    own = F.floor(F.col("idx") / block)
    blocks = F.when(F.col("idx") % block >= block - past, F.array(own, own + 1)).otherwise(F.array(own)) if past else F.array(own)
    parts = df.withColumn("block", F.explode(blocks)).groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("rows"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    size = block + past
    turned = np.fft.rfft(h, size)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, r in batch.iterrows():
                start, x = int(r["block"]) * block, np.zeros(size)
                for s in r["rows"]:
                    x[s["idx"] - start + past] = s["x"]
                last = r["rows"][-1]["idx"]  # of the series, unless the block is full
                n = block if last == start + block - 1 else min(block, last + past - start + 1)
                y = np.fft.irfft(np.fft.rfft(x) * turned, size)[past : past + n]
                yield pd.DataFrame({k: r[k] for k in keys} | {"idx": start + np.arange(n), "y": y})

    return parts.mapInPandas(each, f"{kinds}, idx long, y double")


def correlate(df: DataFrame, keys: list[str], lags: int, norm: str = "none") -> DataFrame:
    """Of columns x and y: (keys, lag, r), r = sum x[n] y[n + lag] for lags -lags … lags; norms none, biased, unbiased, coefficient."""
    return normed(lag_sums(df, keys, lags), keys, lags, norm)


def lag_sums(df: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """keys, n, xx, yy, and the sums r0 … of all lags: one pass, whatever norms are taken of them."""
    w = _along(keys)
    shifted = df.select(*keys, "x", "y", *(F.lag("y", -lag).over(w).alias(f"y{i}") for i, lag in enumerate(range(-lags, lags + 1))))
    return shifted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("y") ** 2).alias("yy"), *(F.coalesce(F.sum(F.col("x") * F.col(f"y{i}")), F.lit(0.0)).alias(f"r{i}") for i in range(2 * lags + 1)))


def normed(sums: DataFrame, keys: list[str], lags: int, norm: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(lag).alias("lag"), F.col(f"r{i}").alias("r")) for i, lag in enumerate(range(-lags, lags + 1))])).alias("e")
    long = sums.where(F.col("n") > lags).select(*keys, "n", "xx", "yy", each).select(*keys, "n", "xx", "yy", "e.lag", "e.r")
    scale = {"none": F.lit(1.0), "biased": F.col("n"), "unbiased": F.col("n") - F.abs("lag"), "coefficient": F.sqrt(F.col("xx") * F.col("yy"))}[norm]
    return long.select(*keys, "lag", F.try_divide(F.col("r"), scale).alias("r"))


def savitzky_golay_weights(half: int, degree: int, derivative: int = 0, step: float = 1.0) -> list[float]:
    """Weights of places -half … half of the least-squares polynomial's derivative at the middle."""
    a = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True).astype(float)
    return (np.linalg.solve(a.T @ a, a.T)[derivative] * math.factorial(derivative) / step**derivative).tolist()


def savitzky_golay(df: DataFrame, keys: list[str], half: int, degree: int, derivative: int = 0, step: float = 1.0) -> DataFrame:
    """Places with a full neighbourhood only."""
    w = _along(keys)
    y = sum((F.lag("x", -j).over(w) * v for j, v in zip(range(-half, half + 1), savitzky_golay_weights(half, degree, derivative, step), strict=True)), F.lit(0.0))
    return df.select(*keys, "idx", y.alias("y")).where("y IS NOT NULL")


def unwrap(df: DataFrame, keys: list[str], threshold: float = math.pi) -> DataFrame:
    """Phases with jumps over `threshold` taken back by multiples of 2 pi."""
    w = _along(keys)
    jump = F.col("x") - F.lag("x").over(w)
    turns = F.when(F.abs(jump) > threshold, F.floor((jump + math.pi) / (2 * math.pi))).otherwise(0)
    return df.withColumn("turns", F.coalesce(turns, F.lit(0))).select(*keys, "idx", (F.col("x") - 2 * math.pi * F.sum("turns").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("y"))


def trapezoid(df: DataFrame, keys: list[str], t: str, x: str, order: list[str]) -> DataFrame:
    """Integral of sampled data by group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    area = (F.col(t) - F.lag(t).over(w)) * (F.col(x) + F.lag(x).over(w)) / 2
    return df.select(*keys, area.alias("a")).groupBy(*keys).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("area"))


def without_duplicates(df: DataFrame, keys: list[str], t: str, x: str, policy: str = "mean") -> DataFrame:
    """One sample per time: reject, first, last (by column `idx`) or mean."""
    agg = {"first": F.min_by(x, "idx"), "last": F.max_by(x, "idx"), "mean": F.avg(x), "reject": F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate sample"))).otherwise(F.max(x))}[policy]
    return df.groupBy(*keys, t).agg(agg.cast("double").alias(x))


def interpolate_linear(df: DataFrame, keys: list[str], t: str, x: str, step: float) -> DataFrame:
    """Values at the multiples of `step` within each series' times, from the interval each multiple lies in. Times must not repeat."""
    w = Window.partitionBy(*keys).orderBy(t)
    ends = df.select(*keys, F.col(t).alias("t0"), F.col(x).alias("x0"), F.lead(t).over(w).alias("t1"), F.lead(x).over(w).alias("x1"))
    first, last = F.ceil(F.col("t0") / step), F.when(F.col("t1").isNull(), F.floor(F.col("t0") / step)).otherwise(F.ceil(F.col("t1") / step) - 1)
    grid = ends.where(first <= last).withColumn("g", F.explode(F.sequence(first, last)))
    at = F.col("g") * step
    return grid.select(*keys, at.alias("t"), F.when(F.col("t1").isNull(), F.col("x0")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * (at - F.col("t0")) / (F.col("t1") - F.col("t0"))).alias("y"))


def cubic_second_derivatives(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Natural cubic spline: second derivatives at the knots, 0 at the ends."""
    n, m = len(t), np.zeros(len(t))
    if n < 3:
        return m
    h, s = np.diff(t), np.diff(x) / np.diff(t)
    m[1:-1] = solve_rows(h[:-1], 2 * (h[:-1] + h[1:]), h[1:], 6 * np.diff(s))
    return m


def monotone_tangents(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Tangents that keep monotone data monotone: weighted harmonic means, 0 at turns, clamped three-point ends."""
    h, s = np.diff(t), np.diff(x) / np.diff(t)
    if len(s) == 1:
        return np.array([s[0], s[0]])
    m = np.zeros(len(t))
    same = s[:-1] * s[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        m[1:-1] = np.where(same, (w1 + w2) / (w1 / s[:-1] + w2 / s[1:]), 0.0)
    for i, h0, h1, s0, s1 in ((0, h[0], h[1], s[0], s[1]), (-1, h[-1], h[-2], s[-1], s[-2])):
        e = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        m[i] = 0.0 if e * s0 <= 0 else 3 * s0 if s0 * s1 <= 0 and abs(e) > 3 * abs(s0) else e
    return m


def interpolate_smooth(df: DataFrame, keys: list[str], t: str, x: str, step: float, kind: str = "monotone") -> DataFrame:
    """Cubic (natural) or monotone Hermite values at the multiples of `step`; a series a row of the kernel's batch, which stays in Arrow's
    arrays (as Python objects it would take some twenty times as much memory)."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(x).alias("x")))).alias("s"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, s in enumerate(batch.column("s")):
                a, b = (s.values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("t", "x"))
                at = np.arange(math.ceil(a[0] / step), math.floor(a[-1] / step) + 1) * step
                if len(a) == 1:
                    y = np.full(len(at), b[0])
                else:
                    i = np.clip(np.searchsorted(a, at, side="right") - 1, 0, len(a) - 2)
                    h, u = a[i + 1] - a[i], (at - a[i]) / (a[i + 1] - a[i])
                    if kind == "cubic":
                        m = cubic_second_derivatives(a, b)
                        y = (1 - u) * b[i] + u * b[i + 1] + h**2 / 6 * (((1 - u) ** 3 - (1 - u)) * m[i] + (u**3 - u) * m[i + 1])
                    else:
                        m = monotone_tangents(a, b)
                        y = (1 + 2 * u) * (1 - u) ** 2 * b[i] + u * (1 - u) ** 2 * h * m[i] + u**2 * (3 - 2 * u) * b[i + 1] + u**2 * (u - 1) * h * m[i + 1]
                own = {k: batch.column(k).take(pa.array(np.full(len(at), row))) for k in keys}
                yield pa.RecordBatch.from_pydict({**own, "t": at, "y": y})

    return rows.mapInArrow(each, f"{kinds}, t double, y double")


# ---- wavelets


def haar(df: DataFrame, keys: list[str]) -> DataFrame:
    """One level: (keys, idx, s, d) from neighbouring pairs; a last odd sample pairs with zero (zero extension)."""
    r = math.sqrt(0.5)
    pairs = df.groupBy(*keys, F.floor(F.col("idx") / 2).alias("pair")).agg(F.coalesce(F.max(F.when(F.col("idx") % 2 == 0, F.col("x"))), F.lit(0.0)).alias("a"), F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("x"))), F.lit(0.0)).alias("b"))
    return pairs.select(*keys, F.col("pair").alias("idx"), ((F.col("a") + F.col("b")) * r).alias("s"), ((F.col("a") - F.col("b")) * r).alias("d"))


def haar_inverse(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, x) of even length from (keys, idx, s, d)."""
    r = math.sqrt(0.5)
    both = F.explode(F.array(F.struct((2 * F.col("idx")).alias("idx"), ((F.col("s") + F.col("d")) * r).alias("x")), F.struct((2 * F.col("idx") + 1).alias("idx"), ((F.col("s") - F.col("d")) * r).alias("x")))).alias("e")
    return df.select(*keys, both).select(*keys, "e.idx", "e.x")


def haar_levels(df: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """(keys, level, idx, d) of all levels, and the last level's averages as level 0."""
    out, now = None, df
    for level in range(1, levels + 1):
        step = haar(now, keys)
        d = step.select(*keys, F.lit(level).alias("level"), "idx", F.col("d").alias("value"))
        out = d if out is None else out.unionByName(d)
        now = step.select(*keys, "idx", F.col("s").alias("x"))
    return out.unionByName(now.select(*keys, F.lit(0).alias("level"), "idx", F.col("x").alias("value")))


def le_gall(df: DataFrame, keys: list[str]) -> DataFrame:
    """One level of the 5/3 lifting transform with symmetric extension: (keys, idx, s, d), d null where an odd length has none."""
    pairs = df.groupBy(*keys, F.floor(F.col("idx") / 2).alias("i")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("x"))).alias("even"), F.max(F.when(F.col("idx") % 2 == 1, F.col("x"))).alias("odd"))
    w = Window.partitionBy(*keys).orderBy("i")
    after = F.coalesce(F.lead("even").over(w), F.col("even"))
    lifted = pairs.withColumn("d", F.col("odd") - (F.col("even") + after) / 2)
    here = F.coalesce("d", F.lag("d").over(w), F.lit(0.0))
    before = F.coalesce(F.lag("d").over(w), F.col("d"), F.lit(0.0))
    return lifted.select(*keys, F.col("i").alias("idx"), (F.col("even") + (before + here) / 4).alias("s"), "d")


def le_gall_inverse(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("idx")
    here = F.coalesce("d", F.lag("d").over(w), F.lit(0.0))
    before = F.coalesce(F.lag("d").over(w), F.col("d"), F.lit(0.0))
    even = df.withColumn("even", F.col("s") - (before + here) / 4)
    both = even.withColumn("odd", F.col("d") + (F.col("even") + F.coalesce(F.lead("even").over(w), F.col("even"))) / 2)
    pair = F.explode(F.array(F.struct((2 * F.col("idx")).alias("idx"), F.col("even").alias("x")), F.struct((2 * F.col("idx") + 1).alias("idx"), F.col("odd").alias("x")))).alias("e")
    return both.select(*keys, pair).select(*keys, "e.idx", "e.x").where("x IS NOT NULL")


# ---- envelopes


def envelope(xs: Column, attack: float, release: float) -> Column:
    """One-pole follower of |x| over an ordered array: the state moves to a larger value by `attack`, to a smaller by `release`."""
    zero = F.struct(F.lit(0.0).alias("e"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        e = s["e"] + F.when(F.abs(x) > s["e"], attack).otherwise(release) * (F.abs(x) - s["e"])
        return F.struct(e.alias("e"), F.array_append(s["out"], e).alias("out"))

    return F.aggregate(xs, zero, step)["out"]


# ---- tapers


def taper(n: int, kind: str, parameter: float | None = None, periodic: bool = False) -> list[float]:
    """Rectangular, hann, hamming, blackman, blackman-harris, kaiser; symmetric unless periodic."""
    if n == 1:
        return [1.0]
    i, m = np.arange(n), n if periodic else n - 1
    z = 2 * np.pi * i / m
    if kind == "rectangular":
        w = np.ones(n)
    elif kind == "hann":
        w = 0.5 - 0.5 * np.cos(z)
    elif kind == "hamming":
        w = 0.54 - 0.46 * np.cos(z)
    elif kind == "blackman":
        a = 0.16 if parameter is None else parameter
        w = (1 - a) / 2 - 0.5 * np.cos(z) + a / 2 * np.cos(2 * z)
    elif kind == "blackman-harris":
        w = 0.35875 - 0.48829 * np.cos(z) + 0.14128 * np.cos(2 * z) - 0.01168 * np.cos(3 * z)
    elif kind == "kaiser":
        b = 8.6 if parameter is None else parameter
        w = np.i0(b * np.sqrt(np.maximum(0, 1 - (2 * i / m - 1) ** 2))) / np.i0(b)
    else:
        raise ValueError(f"unknown taper {kind}")
    return w.tolist()


def taper_metrics(w: list[float]) -> dict[str, float]:
    s, ss = math.fsum(w), math.fsum(v * v for v in w)
    return {"coherent_gain": s / len(w), "enbw": len(w) * ss / s**2}


# ---- queries

KERNEL = [0.25, 0.5, -0.125, 1.0]


def _kernel_query(span: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return convolve(user_series(spark, sf_dir), ["user_id"], KERNEL, span).withColumn("y", F.round("y", 5))

    return run


_S = f"s AS ({USER_SERIES_SQL}), n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id), k AS (SELECT unnest([0, 1, 2, 3]) AS j, unnest({KERNEL}) AS h)"


def _full_sql(place: str, where: str, final: str = "i") -> str:
    return f"WITH {_S}, f AS (SELECT user_id, {place} AS i, sum(x * h) AS y FROM s JOIN n USING (user_id) CROSS JOIN k GROUP BY user_id, {place}) SELECT user_id, {final} AS idx, round(y, 5) AS y FROM f JOIN n USING (user_id) WHERE {where}"


def q_overlap_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convolve_overlap_save(user_series(spark, sf_dir), ["user_id"], KERNEL, 16).withColumn("y", F.round("y", 5))


def q_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convolve_blocks(user_series(spark, sf_dir), ["user_id"], KERNEL, 16).withColumn("y", F.round("y", 5))


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(user_series(spark, sf_dir))


def _paired(s: DataFrame) -> DataFrame:
    return s.withColumn("y", F.col("x") * F.when(F.col("idx") % 2 == 0, 1.0).otherwise(-0.5))


def q_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All norms of one table of sums, written once; the events are dealt by users over all cores, so that no task sorts more than a part."""
    events = spread(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id")
    sums, out = staged(lag_sums(_paired(series(events, ["user_id"], ["ts", "event_id"], "value")), ["user_id"], 2), "lag-sums"), None
    for norm in ("none", "biased", "unbiased", "coefficient"):
        part = normed(sums, ["user_id"], 2, norm).select("user_id", "lag", F.lit(norm).alias("norm"), F.round("r", 5).alias("r"))
        out = part if out is None else out.unionByName(part)
    return out


CORRELATE_SQL = f"""WITH s AS ({USER_SERIES_SQL}), t AS (SELECT *, x * CASE WHEN idx % 2 = 0 THEN 1.0 ELSE -0.5 END AS y FROM s), l AS (SELECT unnest([-2, -1, 0, 1, 2]) AS lag),
 n AS (SELECT user_id, count(*) AS n, sum(x * x) AS xx, sum(y * y) AS yy FROM t GROUP BY user_id),
 r AS (SELECT a.user_id, lag, n, xx, yy, coalesce(sum(a.x * b.y), 0) AS r FROM n JOIN t a USING (user_id) CROSS JOIN l LEFT JOIN t b ON b.user_id = a.user_id AND b.idx = a.idx + lag WHERE n > 2 GROUP BY ALL)
SELECT user_id, lag, norm, round(CASE norm WHEN 'none' THEN r WHEN 'biased' THEN r / n WHEN 'unbiased' THEN r / (n - abs(lag)) ELSE r / sqrt(xx * yy) END, 5) AS r FROM r, (SELECT unnest(['none', 'biased', 'unbiased', 'coefficient']) AS norm)"""


def q_savgol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savitzky_golay(user_series(spark, sf_dir), ["user_id"], 2, 2).withColumn("y", F.round("y", 5))


SAVGOL_SQL = f"""WITH s AS ({USER_SERIES_SQL}), w AS (SELECT user_id, idx, (-3 * lag(x, 2) OVER o + 12 * lag(x) OVER o + 17 * x + 12 * lead(x) OVER o - 3 * lead(x, 2) OVER o) / 35 AS y FROM s WINDOW o AS (PARTITION BY user_id ORDER BY idx))
SELECT user_id, idx, round(y, 5) AS y FROM w WHERE y IS NOT NULL"""


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_series(spark, sf_dir).withColumn("x", F.col("idx") * 2.5 - 2 * math.pi * F.floor((F.col("idx") * 2.5 + math.pi) / (2 * math.pi)))


def q_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unwrap(_phases(spark, sf_dir), ["user_id"]).withColumn("y", F.round("y", 6))


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros("ts") / F.lit(3_600e6)).alias("t"), "event_id", F.col("value").alias("x"))
    return e


def q_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trapezoid(_times(spark, sf_dir), ["user_id"], "t", "x", ["t", "event_id"]).withColumn("area", F.round("area", 3))


def q_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = without_duplicates(_times(spark, sf_dir).withColumnRenamed("event_id", "idx"), ["user_id"], "t", "x")
    return interpolate_linear(clean, ["user_id"], "t", "x", 24.0).withColumn("y", F.round("y", 4))


def q_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = without_duplicates(_times(spark, sf_dir).withColumnRenamed("event_id", "idx"), ["user_id"], "t", "x")
    a, b = (interpolate_smooth(clean, ["user_id"], "t", "x", 24.0, kind).withColumnRenamed("y", kind) for kind in ("cubic", "monotone"))
    return a.join(b, ["user_id", "t"]).select("user_id", "t", F.round("cubic", 4).alias("cubic"), F.round("monotone", 4).alias("monotone"))


_T = "t AS (SELECT user_id, epoch_us(ts) / 3600e6 AS t, event_id, value AS x FROM events)"


def q_haar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return haar(user_series(spark, sf_dir), ["user_id"]).select("user_id", "idx", F.round("s", 5).alias("s"), F.round("d", 5).alias("d"))


def q_wavelet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest error of both wavelets' inverses of their transforms, over all users."""
    s = user_series(spark, sf_dir)
    found = []
    for name, back in (("haar", haar_inverse(haar(s, ["user_id"]), ["user_id"])), ("le_gall", le_gall_inverse(le_gall(s, ["user_id"]), ["user_id"]))):
        both = s.join(back.withColumnRenamed("x", "z"), ["user_id", "idx"], "left")
        found.append(both.agg(F.lit(name).alias("wavelet"), F.round(F.max(F.abs(F.col("x") - F.col("z"))), 6).alias("error"), F.count("z").alias("n")))
    return found[0].unionByName(found[1])


def q_le_gall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return le_gall(user_series(spark, sf_dir), ["user_id"]).select("user_id", "idx", F.round("s", 5).alias("s"), F.round("d", 5).alias("d"))


def q_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_series(spark, sf_dir).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "x"))), lambda r: r["x"]).alias("xs"))
    return rows.select("user_id", F.posexplode(envelope(F.col("xs"), 0.5, 0.1)).alias("idx", "e")).withColumn("e", F.round("e", 5))


ENVELOPE_SQL = f"""WITH RECURSIVE s AS ({USER_SERIES_SQL}), r(user_id, idx, e) AS (
 SELECT user_id, 0::bigint, 0.5 * abs(x) FROM s WHERE idx = 0
 UNION ALL SELECT s.user_id, s.idx, r.e + CASE WHEN abs(s.x) > r.e THEN 0.5 ELSE 0.1 END * (abs(s.x) - r.e) FROM r JOIN s ON s.user_id = r.user_id AND s.idx = r.idx + 1)
SELECT user_id, idx, round(e, 5) AS e FROM r"""


def q_tapers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tapers of 16 points as Column expressions of the place."""
    z = 2 * math.pi * F.col("id") / 15
    kinds = {"hann": 0.5 - 0.5 * F.cos(z), "hamming": 0.54 - 0.46 * F.cos(z), "blackman": 0.42 - 0.5 * F.cos(z) + 0.08 * F.cos(2 * z), "blackman_harris": 0.35875 - 0.48829 * F.cos(z) + 0.14128 * F.cos(2 * z) - 0.01168 * F.cos(3 * z)}
    return spark.range(16).select(F.col("id").alias("idx"), *(F.round(c, 6).alias(k) for k, c in kinds.items()))


QUERIES = {
    "signal_convolve_full": (_kernel_query("full"), _full_sql("idx + j", "true")),
    "signal_convolve_same": (_kernel_query("same"), _full_sql("idx + j", "i >= 1 AND i < n + 1", "i - 1")),
    "signal_convolve_valid": (_kernel_query("valid"), _full_sql("idx + j", "i >= 3 AND i < n", "i - 3")),
    "signal_convolve_circular": (_kernel_query("circular"), _full_sql("(idx + j) % n", "true")),
    "signal_convolve_blocks": (q_blocks, _full_sql("idx + j", "true")), "signal_overlap_save": (q_overlap_save, _full_sql("idx + j", "true")),
    "signal_correlate": (q_correlate, CORRELATE_SQL),
    "signal_savitzky_golay": (q_savgol, SAVGOL_SQL),
    "signal_unwrap": (q_unwrap, f"SELECT user_id, idx, round(idx * 2.5, 6) AS y FROM ({USER_SERIES_SQL})"),
    "signal_trapezoid": (q_trapezoid, f"WITH {_T}, a AS (SELECT user_id, (t - lag(t) OVER w) * (x + lag(x) OVER w) / 2 AS a FROM t WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, round(coalesce(sum(a), 0), 3) AS area FROM a GROUP BY user_id"),
    "signal_interpolate_linear": (q_interpolate, f"WITH {_T}, d AS (SELECT user_id, t, avg(x) AS x FROM t GROUP BY ALL), e AS (SELECT user_id, t AS t0, x AS x0, lead(t) OVER w AS t1, lead(x) OVER w AS x1 FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t)), g AS (SELECT *, unnest(range(ceil(t0 / 24)::bigint, CASE WHEN t1 IS NULL THEN floor(t0 / 24)::bigint + 1 ELSE ceil(t1 / 24)::bigint END)) AS g FROM e) SELECT user_id, g * 24.0::double AS t, round(CASE WHEN t1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (g * 24 - t0) / (t1 - t0) END, 4) AS y FROM g"),
    "signal_interpolate_smooth": (q_smooth, None),
    "signal_haar": (q_haar, f"WITH s AS ({USER_SERIES_SQL}), p AS (SELECT user_id, idx // 2 AS i, coalesce(max(x) FILTER (idx % 2 = 0), 0) AS a, coalesce(max(x) FILTER (idx % 2 = 1), 0) AS b FROM s GROUP BY ALL) SELECT user_id, i AS idx, round((a + b) * sqrt(0.5), 5) AS s, round((a - b) * sqrt(0.5), 5) AS d FROM p"),
    "signal_le_gall": (q_le_gall, f"WITH s AS ({USER_SERIES_SQL}), p AS (SELECT user_id, idx // 2 AS i, max(x) FILTER (idx % 2 = 0) AS e, max(x) FILTER (idx % 2 = 1) AS o FROM s GROUP BY ALL), d AS (SELECT *, o - (e + coalesce(lead(e) OVER w, e)) / 2 AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, i AS idx, round(e + (coalesce(lag(d) OVER w, d, 0) + coalesce(d, lag(d) OVER w, 0)) / 4, 5) AS s, round(d, 5) AS d FROM d WINDOW w AS (PARTITION BY user_id ORDER BY i)"),
    "signal_wavelet_round_trip": (q_wavelet_round_trip, "SELECT w AS wavelet, 0.0::double AS error, (SELECT count(*) FROM events) AS n FROM (SELECT unnest(['haar', 'le_gall']) AS w)"),
    "signal_envelope": (q_envelope, ENVELOPE_SQL),
    "signal_tapers": (q_tapers, "SELECT i AS idx, round(0.5 - 0.5 * cos(z), 6) AS hann, round(0.54 - 0.46 * cos(z), 6) AS hamming, round(0.42 - 0.5 * cos(z) + 0.08 * cos(2 * z), 6) AS blackman, round(0.35875 - 0.48829 * cos(z) + 0.14128 * cos(2 * z) - 0.01168 * cos(3 * z), 6) AS blackman_harris FROM (SELECT i, 2 * pi() * i / 15 AS z FROM range(16) t(i))"),
}
