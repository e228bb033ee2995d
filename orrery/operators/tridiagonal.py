"""Tridiagonal systems of any length, and the cubic splines that they give, over blocks of rows.

Each block is solved for its own right-hand side and for unit values of the unknowns just before and after it, which leaves two
equations a block: its first and last unknown in terms of its neighbours' last and first. These make a small system of blocks of two,
solved in one task (two numbers a block), after which every block is completed by itself. No pivoting: rows must be dominated by their
diagonals, as a spline's are; a zero pivot raises.

Rows are `df(idx, low, mid, high, rhs)` with idx from 0 without gaps; the first row's `low` and the last one's `high` are ignored. Null
values raise; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.sources.scratch import staged
from orrery.sources.tables import indexed, table

BLOCK = 1 << 16
_PARTS = ("own", "before", "after")


def solve_rows(low: np.ndarray, mid: np.ndarray, high: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """One system in order of its rows, by elimination; `rhs` may have several columns. Linear in the rows."""
    n = len(mid)
    upper, x = np.zeros(n), np.array(rhs, float)
    for i in range(n):
        pivot = mid[i] - (low[i] * upper[i - 1] if i else 0.0)
        if pivot == 0 or not np.isfinite(pivot):
            raise ArithmeticError("a zero pivot")
        upper[i] = high[i] / pivot if i + 1 < n else 0.0
        x[i] = (x[i] - (low[i] * x[i - 1] if i else 0.0)) / pivot
    for i in range(n - 2, -1, -1):
        x[i] -= upper[i] * x[i + 1]
    return x


def _block(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places, and the solutions for the block's own right-hand side and for its neighbours."""
    at = group.column("idx").to_numpy()
    order = np.argsort(at)
    low, mid, high, rhs = (group.column(c).to_numpy(zero_copy_only=False).astype(float)[order] for c in ("low", "mid", "high", "rhs"))
    if np.isnan(low + mid + high + rhs).any():
        raise ValueError("a missing value")
    sides = np.zeros((len(mid), 3))
    sides[:, 0], sides[0, 1], sides[-1, 2] = rhs, -low[0], -high[-1]
    return at[order], solve_rows(low, mid, high, sides)


def _ends(frame: pd.DataFrame) -> pd.DataFrame:
    """First and last unknown of each block, from the blocks' end rows in order: a system of blocks of two, eliminated downwards."""
    frame = frame.sort_values("block").reset_index(drop=True)
    n, first, last = len(frame), frame[[f"first_{p}" for p in _PARTS]].to_numpy(), frame[[f"last_{p}" for p in _PARTS]].to_numpy()
    # z_b = (first_b, last_b) = own_b + before_b last_(b-1) + after_b first_(b+1); going down, z_b = d_b + e_b first_(b+1)
    d, e = np.zeros((n, 2)), np.zeros((n, 2))
    for b in range(n):
        own, before, after = (np.array([first[b, k], last[b, k]]) for k in range(3))
        if b == 0:
            d[b], e[b] = own, after
            continue
        # last_(b-1) = d[1] + e[1] first_b
        front = 1 - before[0] * e[b - 1, 1]
        lead = (own[0] + before[0] * d[b - 1, 1]) / front, after[0] / front
        d[b] = lead[0], own[1] + before[1] * (d[b - 1, 1] + e[b - 1, 1] * lead[0])
        e[b] = lead[1], after[1] + before[1] * e[b - 1, 1] * lead[1]
    z = np.zeros((n, 2))
    for b in range(n - 1, -1, -1):
        z[b] = d[b] + e[b] * (z[b + 1, 0] if b + 1 < n else 0.0)
    earlier, later = np.concatenate([[0.0], z[:-1, 1]]), np.concatenate([z[1:, 0], [0.0]])
    return pd.DataFrame({"block": frame["block"], "earlier": earlier, "later": later})


def solve(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """idx, x."""
    last = df.agg(F.max("idx")).first()[0]
    ended = df.withColumn("low", F.when(F.col("idx") == 0, 0.0).otherwise(F.col("low"))).withColumn("high", F.when(F.col("idx") == (last or 0), 0.0).otherwise(F.col("high")))
    rows = staged(ended.select(F.col("idx").cast("long").alias("idx"), "low", "mid", "high", "rhs", F.floor(F.col("idx") / block).cast("long").alias("block")), "tridiagonal")

    def reduced(group: pa.Table) -> pa.Table:
        at, x = _block(group)
        ends = {f"{side}_{p}": [x[i, k]] for side, i in (("first", 0), ("last", -1)) for k, p in enumerate(_PARTS)}
        return pa.table({"block": [int(at[0]) // block], **ends})

    names = ", ".join(f"{side}_{p} double" for side in ("first", "last") for p in _PARTS)
    small = staged(rows.groupBy("block").applyInArrow(reduced, f"block long, {names}"), "tridiagonal-ends")
    reach = staged(small.groupBy(F.lit(0).alias("all")).applyInPandas(_ends, "block long, earlier double, later double"), "tridiagonal-reach")

    def completed(group: pa.Table, ends: pa.Table) -> pa.Table:
        at, x = _block(group)
        earlier, later = ends.column("earlier")[0].as_py(), ends.column("later")[0].as_py()
        return pa.table({"idx": at, "x": x[:, 0] + x[:, 1] * earlier + x[:, 2] * later})

    return rows.groupBy("block").cogroup(reach.groupBy("block")).applyInArrow(completed, "idx long, x double")


def _beside(df: DataFrame, columns: list[str], block: int) -> DataFrame:
    """`df` with each column of the rows before and after, p_ and n_: the rows at the ends of a block are also sent to its neighbour, so
    each block is a window of its own."""
    own = F.floor(F.col("idx") / block)
    place = F.struct(own.alias("at"), F.lit(False).alias("guest"))
    low, high = F.struct((own - 1).alias("at"), F.lit(True).alias("guest")), F.struct((own + 1).alias("at"), F.lit(True).alias("guest"))
    none = F.array().cast("array<struct<at:bigint,guest:boolean>>")
    dealt = df.withColumn("_to", F.explode(F.concat(F.array(place), F.when(F.col("idx") % block == 0, F.array(low)).otherwise(none), F.when(F.col("idx") % block == block - 1, F.array(high)).otherwise(none))))
    w = Window.partitionBy("_to.at").orderBy("idx")
    more = dealt.select("*", *(F.lag(c).over(w).alias(f"p_{c}") for c in columns), *(F.lead(c).over(w).alias(f"n_{c}") for c in columns))
    return more.where(~F.col("_to.guest")).drop("_to")


def spline_rows(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """The natural spline's system for `samples(idx, t, x)`, t rising: second derivatives are its unknowns, zero at both ends."""
    near = _beside(samples, ["t", "x"], block)
    before, after = F.col("t") - F.col("p_t"), F.col("n_t") - F.col("t")
    inner = F.col("p_t").isNotNull() & F.col("n_t").isNotNull()
    rising = F.when((before <= 0) | (after <= 0), F.raise_error(F.lit("times must rise")).cast("double"))
    slope = (F.col("n_x") - F.col("x")) / after - (F.col("x") - F.col("p_x")) / before
    cell = lambda c, end: F.coalesce(rising, F.when(inner, c).otherwise(end))
    return near.select("idx", cell(before, 0.0).alias("low"), cell(2 * (before + after), 1.0).alias("mid"), cell(after, 0.0).alias("high"), cell(6 * slope, 0.0).alias("rhs"))


def spline(samples: DataFrame, step: float, reach: int = 0, outside: str = "reject", block: int = BLOCK) -> DataFrame:
    """t, y: the natural cubic spline through `samples(idx, t, x)` at the multiples of `step` from the first time to the last.

    `reach` steps more on both sides, which `outside` treats: "reject" raises, "clamp" gives the end's value, "linear" goes on with the
    slope of the outermost two samples.
    """
    if outside not in ("reject", "clamp", "linear"):
        raise ValueError(f"no such rule: {outside}")
    if reach and outside == "reject":
        raise ValueError("times outside the samples")
    held = staged(samples.select(F.col("idx").cast("long").alias("idx"), F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x")), "samples")
    bent = held.join(solve(spline_rows(held, block), block).withColumnRenamed("x", "m"), "idx")
    ends = _beside(bent, ["t", "x", "m"], block)
    here, first, last = F.col("t"), F.col("p_t").isNull(), F.col("n_t").isNull()
    low = F.ceil(here / step) - F.when(first, reach).otherwise(0)
    high = F.when(last, F.floor(here / step) + reach).otherwise(F.ceil(F.col("n_t") / step) - 1)
    grid = ends.where(low <= high).withColumn("g", F.explode(F.sequence(low, high)))
    at, width = F.col("g") * step, F.col("n_t") - here
    u = (at - here) / width
    inside = (1 - u) * F.col("x") + u * F.col("n_x") + width**2 / 6 * (((1 - u) ** 3 - (1 - u)) * F.col("m") + (u**3 - u) * F.col("n_m"))
    slope = F.when(at < here, (F.col("n_x") - F.col("x")) / width).otherwise((F.col("x") - F.col("p_x")) / (here - F.col("p_t")))
    beyond = F.col("x") + (F.coalesce(slope, F.lit(0.0)) * (at - here) if outside == "linear" else 0.0)
    return grid.select(at.alias("t"), F.when((at < here) | F.col("n_t").isNull(), F.when(at == here, F.col("x")).otherwise(beyond)).otherwise(inside).alias("y"))


# ---- queries


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each distinct time of the events, in hours: one series, in order."""
    events = table(spark, sf_dir, "events").groupBy((F.unix_micros("ts") / F.lit(3_600e6)).alias("t")).agg(F.avg("value").alias("x"))
    return indexed(events.where(F.col("x").isNotNull()), ["t"])


def q_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A natural spline through all events, at every sixth hour and two days beyond both ends, in blocks of 300 samples."""
    return spline(_hours(spark, sf_dir), 6.0, 8, "linear", block=300).select("t", F.round("y", 4).alias("y"))


SPLINE_SQL = """
WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY t) - 1 AS i, t, x FROM (SELECT epoch_us(ts) / 3600e6::double AS t, avg(value) AS x FROM events GROUP BY ts) WHERE x IS NOT NULL),
k AS (SELECT i, t, x, lag(t) OVER w AS pt, lag(x) OVER w AS px, lead(t) OVER w AS nt, lead(x) OVER w AS nx FROM s WINDOW w AS (ORDER BY i)),
r AS (SELECT i, CASE WHEN pt IS NULL OR nt IS NULL THEN 0 ELSE t - pt END AS a, CASE WHEN pt IS NULL OR nt IS NULL THEN 1 ELSE 2 * (nt - pt) END AS b, CASE WHEN pt IS NULL OR nt IS NULL THEN 0 ELSE nt - t END AS c,
 CASE WHEN pt IS NULL OR nt IS NULL THEN 0 ELSE 6 * ((nx - x) / (nt - t) - (x - px) / (t - pt)) END AS d FROM k),
f AS (SELECT i, c / b AS u, d / b AS v FROM r WHERE i = 0 UNION ALL SELECT r.i, r.c / (r.b - r.a * f.u), (r.d - r.a * f.v) / (r.b - r.a * f.u) FROM f JOIN r ON r.i = f.i + 1),
m AS (SELECT i, v AS m FROM f WHERE i = (SELECT max(i) FROM f) UNION ALL SELECT f.i, f.v - f.u * m.m FROM m JOIN f ON f.i = m.i - 1),
e AS (SELECT k.*, m.m, lead(m.m) OVER (ORDER BY k.i) AS nm FROM k JOIN m USING (i)),
g AS (SELECT *, unnest(range((ceil(t / 6) - CASE WHEN pt IS NULL THEN 8 ELSE 0 END)::bigint, (CASE WHEN nt IS NULL THEN floor(t / 6) + 9 ELSE ceil(nt / 6) END)::bigint)) * 6.0::double AS z FROM e),
u AS (SELECT *, (z - t) / (nt - t) AS u, nt - t AS w FROM g)
SELECT z AS t, round(CASE WHEN nt IS NULL THEN x + (x - px) / (t - pt) * (z - t) WHEN z < t THEN x + (nx - x) / w * (z - t)
 ELSE (1 - u) * x + u * nx + w * w / 6 * (((1 - u) ^ 3 - (1 - u)) * m + (u ^ 3 - u) * nm) END, 4) AS y FROM u
"""

QUERIES = {"signal_spline_long": (q_spline, SPLINE_SQL)}
