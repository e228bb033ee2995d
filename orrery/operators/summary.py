"""Deterministic mergeable quantile summaries (Greenwald and Khanna) with rank bounds of their own.

A summary is a row: n, exact, values, gaps, slacks. Up to `Policy.exact` observations it holds them all. Beyond, entry i stands for
`gaps[i]` observations up to and with `values[i]`: the value's least possible rank is the sum of gaps so far, its greatest that sum plus
`slacks[i]`. As long as gap + slack is at most 2 * error * n, some entry is within error * n ranks of any rank asked for, and each
estimate says between which ranks its value lies for certain. A policy's limit of entries is never passed: rather, it raises.

Groups of at most `Policy.exact` rows are collected and sorted by Spark as they are. Rows of the others are summed up a task at a time, in
sorted runs merged into the group's summary (two sorted lists with rank bounds make one), so what is shuffled is a summary a task and
group; those of a group are merged in two steps, first in about as many parts as the square root of the tasks, so that no task reads one
of every task. Everything is deterministic for a given division of rows into tasks, and the bounds hold for any.

Entries whose slack has used up the allowance can't be joined any more, so that summaries merged one after another would grow with
their number. Therefore each step has a share of the error of its own (`SHARES`): what comes into a step leaves at least a third of the
allowance free, and what leaves it has at most about 3 / error entries, however many came in.

Null values are left out; NaN and infinities raise; a group without values has no row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.scratch import staged
from orrery.sources.tables import table

STATE = "n long, exact boolean, values array<double>, gaps array<long>, slacks array<long>"
#: Rows of a group that are sorted and merged at once.
RUN = 1 << 15
#: Of the error: what a task's summaries use, those of a part, and the group's.
SHARES = (1 / 3, 2 / 3, 1.0)


@dataclass(frozen=True)
class Policy:
    """`error`: of ranks, as a share of n, below a half; `exact`: how many observations are kept as they are; `most`: entries at most."""

    error: float
    exact: int = 32
    most: int = 1 << 16

    def __post_init__(self):
        if not 0 <= self.error < 0.5:
            raise ValueError("the rank error must lie in [0, 0.5)")
        if self.exact < 1 or self.most < self.exact:
            raise ValueError("exact must be 1 or more, and most no less")

    def allowance(self, n: int, share: float = 1.0) -> int:
        return int(2 * self.error * share * n)


class Summary:
    """Sorted values with gaps and slacks (see above) of n observations."""

    def __init__(self, policy: Policy, values: np.ndarray, gaps: np.ndarray | None = None, slacks: np.ndarray | None = None):
        self.policy, self.values = policy, np.asarray(values, float)
        self.gaps = np.ones(len(self.values), np.int64) if gaps is None else np.asarray(gaps, np.int64)
        self.slacks = np.zeros(len(self.values), np.int64) if slacks is None else np.asarray(slacks, np.int64)

    @classmethod
    def of(cls, policy: Policy, values: np.ndarray) -> Summary:
        return cls.whole(policy, values).reduced()

    @classmethod
    def whole(cls, policy: Policy, values: np.ndarray) -> Summary:
        """An entry an observation."""
        if not np.isfinite(values).all():
            raise ValueError("non-finite value")
        return cls(policy, np.sort(values))

    @property
    def n(self) -> int:
        return int(self.gaps.sum())

    @property
    def exact(self) -> bool:
        return self.n <= self.policy.exact

    def merged(self, other: Summary) -> Summary:
        return self.beside(other).reduced()

    @classmethod
    def of_all(cls, rows: list[Summary], share: float = 1.0) -> Summary:
        """Merged in a tree, so that no summary is merged more often than it must, and reduced once, at the end."""
        while len(rows) > 1:
            rows = [rows[i].beside(rows[i + 1]) if i + 1 < len(rows) else rows[i] for i in range(0, len(rows), 2)]
        return rows[0].reduced(share)

    def beside(self, other: Summary) -> Summary:
        """All entries of both. Ranks add up: between two neighbours of the other side a value's rank there is known to the upper neighbour's bounds."""
        if self.policy != other.policy:
            raise ValueError("summaries of different policies")

        def widened(a: Summary, b: Summary) -> np.ndarray:
            above = np.searchsorted(b.values, a.values, "right")
            between = (above > 0) & (above < len(b.values))
            next_up = np.minimum(above, max(0, len(b.values) - 1))
            return a.slacks + np.where(between, b.gaps[next_up] + b.slacks[next_up] - 1, 0) if len(b.values) else a.slacks

        values = np.concatenate([self.values, other.values])
        order = np.argsort(values, kind="stable")
        slacks = np.concatenate([widened(self, other), widened(other, self)])[order]
        slacks[[0, -1]] = 0  # the least and the greatest are known
        return Summary(self.policy, values[order], np.concatenate([self.gaps, other.gaps])[order], slacks)

    def reduced(self, share: float = 1.0) -> Summary:
        """Entries joined to the one above while gap + gap + slack stays within the allowance, from the top down; never the least. The
        limit of entries holds for the whole allowance: a summary that keeps to a share of it is on its way."""
        made = self._reduced(share)
        return made.checked() if share == 1 else made

    def _reduced(self, share: float) -> Summary:
        if self.exact or len(self.values) < 3:
            return self
        allowed, gaps, slacks = self.policy.allowance(self.n, share), self.gaps.tolist(), self.slacks.tolist()
        kept = [len(gaps) - 1]
        for i in range(len(gaps) - 2, 0, -1):
            above = kept[-1]
            if gaps[i] + gaps[above] + slacks[above] <= allowed:
                gaps[above] += gaps[i]
            else:
                kept.append(i)
        at = np.array([*kept, 0][::-1])
        return Summary(self.policy, self.values[at], np.array(gaps)[at], self.slacks[at])

    def checked(self) -> Summary:
        if len(self.values) > self.policy.most:
            raise ValueError(f"the rank error needs {len(self.values)} entries, {self.policy.most} are allowed")
        return self

    def estimate(self, q: float) -> tuple[float, float, float]:
        """A value, and the least and greatest share of the way from the first to the last rank at which it can lie."""
        if not 0 <= q <= 1:
            raise ValueError(f"no quantile: {q}")
        n = self.n
        if self.exact:
            at = q * (n - 1)
            low, part = int(np.floor(at)), at - np.floor(at)
            value = self.values[low] + (self.values[int(np.ceil(at))] - self.values[low]) * part
            return float(value), q if n > 1 else 0.0, q if n > 1 else 0.0
        least = np.cumsum(self.gaps)
        most = least + self.slacks
        beyond = np.flatnonzero(most > q * (n - 1) + 1 + self.policy.error * n)
        i = max(0, int(beyond[0]) - 1) if len(beyond) else len(least) - 1
        i = 0 if q == 0 else len(least) - 1 if q == 1 else i
        return float(self.values[i]), (least[i] - 1) / (n - 1), (most[i] - 1) / (n - 1)

    def row(self) -> tuple:
        return self.n, self.exact, self.values.tolist(), self.gaps.tolist(), self.slacks.tolist()


def _table(keys: list[str], schema: pa.Schema, found: list[tuple[tuple, Summary]]) -> pa.Table:
    rows = [(*key, *s.row()) for key, s in found]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow_schema(df: DataFrame, keys: list[str], more: str = "") -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    named = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    text = ", ".join([*named, STATE])
    return text, to_arrow_schema(df.sparkSession.createDataFrame([], text).schema)


def summarize(df: DataFrame, value: str, keys: list[str], policy: Policy) -> DataFrame:
    """keys and the summary's columns: a row a group."""
    rows = df.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    if not keys:
        return sketched(rows, value, keys, policy)
    large = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > policy.exact).select(*(F.col(k).alias(f"_{k}") for k in keys)), "summary-large")
    if large.isEmpty():
        return collected(rows, value, keys)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    small = collected(rows.join(large, same, "left_anti"), value, keys)
    return sketched(rows.join(large, same, "left_semi"), value, keys, policy).unionByName(small)


def collected(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Summaries of groups of few rows: all their values."""
    bad = F.raise_error(F.lit("non-finite value")).cast("double")
    finite = F.when(F.isnan(value) | (F.abs(value) == float("inf")), bad).otherwise(F.col(value))
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(finite)).alias("values"))
    alike = lambda n: F.transform("values", lambda _: F.lit(n).cast("long"))
    return lists.select(*keys, F.size("values").cast("long").alias("n"), F.lit(True).alias("exact"), "values", alike(1).alias("gaps"), alike(0).alias("slacks"))


def sketched(df: DataFrame, value: str, keys: list[str], policy: Policy) -> DataFrame:
    """Summaries of groups of any size."""
    text, schema = _arrow_schema(df, keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Summary] = {}
        waiting: dict[tuple, list[np.ndarray]] = {}

        def take(key: tuple) -> None:
            new = Summary.whole(policy, np.concatenate(waiting.pop(key)))
            held[key] = Summary.of_all([held[key], new] if key in held else [new], SHARES[0])

        for batch in batches:
            rows = pa.table({**{f"k{i}": batch.column(k) for i, k in enumerate(keys)}, "v": batch.column(value)}).append_column("one", pa.array(np.zeros(batch.num_rows, np.int8)))
            groups = rows.group_by([f"k{i}" for i in range(len(keys))] or ["one"], use_threads=False).aggregate([("v", "list")])
            lists = groups.column("v_list").combine_chunks()
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for at, g in enumerate(groups.drop_columns("v_list").to_pylist()):
                key = tuple(g[f"k{i}"] for i in range(len(keys)))
                waiting.setdefault(key, []).append(values[ends[at] : ends[at + 1]])
                if sum(map(len, waiting[key])) >= RUN:
                    take(key)
        for key in list(waiting):
            take(key)
        yield from _table(keys, schema, list(held.items())).to_batches()

    return merge(df.select(*keys, value).mapInArrow(partial, text), keys, policy)


def merge(parts: DataFrame, keys: list[str], policy: Policy) -> DataFrame:
    """Summaries of one policy merged by group, in two steps."""
    text, schema = _arrow_schema(parts, keys)

    def step(share: float) -> Callable[[pa.Table], pa.Table]:
        def together(group: pa.Table) -> pa.Table:
            columns = [group.column(c) for c in ("values", "gaps", "slacks")]
            rows = [Summary(policy, *(c[i].values.to_numpy() for c in columns)) for i in range(group.num_rows)]
            return _table(keys, schema, [(tuple(group.column(k)[0].as_py() for k in keys), Summary.of_all(rows, share))])

        return together

    spark = parts.sparkSession
    some = max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    dealt = parts.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(some)))
    first = dealt.groupBy(*keys, "_part").applyInArrow(step(SHARES[1]), text)
    return first.groupBy(*keys).applyInArrow(step(SHARES[2]), text)


def estimates(summaries: DataFrame, keys: list[str], policy: Policy, qs: list[float]) -> DataFrame:
    """keys, q, value, low, high (the value's rank for certain, as a share), n, entries, exact."""
    named = ", ".join(f"`{k}` {summaries.schema[k].dataType.simpleString()}" for k in keys)

    if not all(0 <= q <= 1 for q in qs):
        raise ValueError(f"no quantile: {qs}")
    summaries = staged(summaries, "summaries")  # read twice below
    # of a group that is held whole the values are at hand; the others' bounds are worked out from their entries
    at = F.col("q") * (F.col("n") - 1)
    low = F.get("values", F.floor(at).cast("int"))
    share = F.when(F.col("n") > 1, F.col("q")).otherwise(0.0)
    each = summaries.where("exact").select(*keys, "n", "values", F.explode(F.array(*map(F.lit, map(float, qs)))).alias("q"))
    whole = each.select(*keys, "q", (low + (F.get("values", F.ceil(at).cast("int")) - low) * (at - F.floor(at))).alias("value"), share.alias("low"), share.alias("high"), "n", F.col("n").alias("entries"), F.lit(True).alias("exact"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, Summary(policy, r["values"], r["gaps"], r["slacks"])) for r in batch.to_pylist()]
            each = [(r, s, q, *s.estimate(q)) for r, s in rows for q in qs]
            own = {k: pa.array([r[k] for r, *_ in each], batch.schema.field(k).type) for k in keys}
            numbers = {name: pa.array([e[i] for e in each], pa.float64()) for i, name in ((2, "q"), (3, "value"), (4, "low"), (5, "high"))}
            counts = {"n": pa.array([s.n for _, s, *_ in each], pa.int64()), "entries": pa.array([len(s.values) for _, s, *_ in each], pa.int64()), "exact": pa.array([s.exact for _, s, *_ in each], pa.bool_())}
            yield pa.RecordBatch.from_pydict({**own, **numbers, **counts})

    return whole.unionByName(summaries.where("NOT exact").mapInArrow(asked, f"{named}{', ' if keys else ''}q double, value double, low double, high double, n long, entries long, exact boolean"))


# ---- queries

SIZES = Policy(0.0002, 32, 40_000)
PRICES = Policy(0.01, 64, 4096)
MIDDLE = [0.11, 0.31, 0.51, 0.71, 0.91]


def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities, of which each of 50 holds a fiftieth of the rows: an estimate off by more than the error would be another one."""
    lines = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_quantity")
    got = estimates(summarize(lines, "l_quantity", ["l_linestatus"], SIZES), ["l_linestatus"], SIZES, MIDDLE)
    return got.select("l_linestatus", "q", "value", "n", F.round((F.col("low") + F.col("high")) / 2, 2).alias("rank"))


SUMMARY_SQL = f"""
SELECT l_linestatus, q, value, n, round(q, 2) AS rank FROM (
 SELECT l_linestatus, unnest({MIDDLE}::double[]) AS q, unnest(v) AS value, n FROM (SELECT l_linestatus, quantile_disc(l_quantity, {MIDDLE}) AS v, count(*) AS n FROM lineitem GROUP BY l_linestatus))
"""


def q_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price quantiles against the table itself: the estimate's true rank lies within the bounds it came with and within the error of the
    quantile asked for, the entries within their limit; the ends are exact."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"))
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = estimates(summarize(lines, "x", ["l_returnflag"], PRICES), ["l_returnflag"], PRICES, qs)
    # the estimates are few: a group times seven; a row is compared with all of its group's
    true = lines.join(F.broadcast(got), "l_returnflag").groupBy("l_returnflag", "q", "value", "low", "high", "n", "entries").agg(F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto"))
    first, last = F.col("below") / (F.col("n") - 1), (F.col("upto") - 1) / (F.col("n") - 1)
    inside = (first <= F.col("high") + 1e-12) & (last >= F.col("low") - 1e-12)
    near = (first <= F.col("q") + PRICES.error + 1e-4) & (last >= F.col("q") - PRICES.error - 1e-4)
    return true.select("l_returnflag", "q", "n", inside.alias("inside"), near.alias("near"), (F.col("entries") <= PRICES.most).alias("bounded"), F.when(F.col("q").isin(0.0, 1.0), F.col("value")).alias("end"))


RANKS_SQL = """
SELECT l_returnflag, q, count(*) AS n, true AS inside, true AS near, true AS bounded, CASE q WHEN 0 THEN min(l_extendedprice) WHEN 1 THEN max(l_extendedprice) END AS "end"
FROM lineitem, (SELECT unnest([0.0::double, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) AS q) GROUP BY l_returnflag, q
"""


def q_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few observations a group: the summary holds them all and interpolates."""
    few = Policy(0.01, 256, 256)
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    return estimates(summarize(orders, "o_totalprice", ["o_custkey"], few), ["o_custkey"], few, [0.25, 0.5, 0.9]).select("o_custkey", "q", F.round("value", 4).alias("value"), "n", "exact")


EXACT_SQL = """
SELECT o_custkey, unnest([0.25, 0.5, 0.9]::double[]) AS q, round(unnest(v), 4) AS value, n, true AS exact
FROM (SELECT o_custkey, quantile_cont(o_totalprice, [0.25, 0.5, 0.9]) AS v, count(*) AS n FROM orders GROUP BY o_custkey)
"""

QUERIES = {"stats_summary": (q_summary, SUMMARY_SQL), "stats_summary_ranks": (q_ranks, RANKS_SQL), "stats_summary_exact": (q_exact, EXACT_SQL)}
