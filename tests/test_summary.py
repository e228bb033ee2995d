"""Quantile summaries: golden figures, bounds that hold for any division of the rows, limits."""

import numpy as np
import pytest
from orrery.operators.summary import Policy, Summary, estimates, merge, summarize
from pyspark.sql import functions as F


def test_golden_halves():
    policy = Policy(0.02, 8, 256)
    both = Summary.of(policy, np.arange(0, 100, 2)).merged(Summary.of(policy, np.arange(1, 100, 2)))
    value, low, high = both.estimate(0.5)
    assert (value, round(low, 3), round(high, 3), len(both.values), both.exact) == (50, 0.495, 0.505, 49, False)


def test_small_data_is_exact():
    s = Summary.of(Policy(0.02, 32, 512), np.array([9.0, 1.0, 5.0, 3.0]))
    assert s.exact and len(s.values) == 4 and s.estimate(0.5) == (4.0, 0.5, 0.5)
    assert Summary.of(Policy(0.02), np.array([7.0])).estimate(0.9) == (7.0, 0.0, 0.0)


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold(seed):
    rng, policy = np.random.default_rng(seed), Policy(0.02, 32, 512)
    x = rng.permutation([np.arange(10_000.0), rng.integers(0, 30, 10_000).astype(float), rng.normal(size=10_000) ** 3][seed % 3])
    parts = [Summary.of(policy, p) for p in np.split(x, np.sort(rng.integers(0, len(x), 25)))  if len(p)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merged(p)
    assert whole.n == len(x) and len(whole.values) <= 512 and (whole.gaps + whole.slacks).max() <= policy.allowance(len(x))
    for q in (0, 0.1, 0.33, 0.5, 0.9, 1):
        value, low, high = whole.estimate(q)
        first, last = (x < value).sum() / (len(x) - 1), ((x <= value).sum() - 1) / (len(x) - 1)
        assert first <= high + 1e-9 and low - 1e-9 <= last
        assert first <= q + 0.0201 and last >= q - 0.0201


def test_limits():
    for bad in ((0.5, 1, 1), (float("nan"), 1, 1), (-0.1, 1, 1), (0.1, 0, 1), (0.1, 9, 8)):
        with pytest.raises(ValueError):
            Policy(*bad)
    tight = Policy(0.0, 2, 2)
    with pytest.raises(ValueError, match="needs 3 entries"):
        Summary.of(tight, np.array([1.0, 2.0])).merged(Summary.of(tight, np.array([3.0])))
    with pytest.raises(ValueError, match="different policies"):
        Summary.of(tight, np.array([1.0])).merged(Summary.of(Policy(0.1), np.array([1.0])))
    with pytest.raises(ValueError, match="no quantile"):
        Summary.of(tight, np.array([1.0])).estimate(1.5)


def test_table_of_summaries(spark):
    rng = np.random.default_rng(3)
    rows = [(None if k == 0 else f"g{k % 3}", float(v)) for k, v in zip(rng.integers(0, 9, 6000), rng.normal(size=6000), strict=True)] + [("few", 1.0), ("few", None), ("none", None)]
    df, policy = spark.createDataFrame(rows, "g string, x double").repartition(7), Policy(0.01, 16, 1000)
    made = summarize(df, "x", ["g"], policy)
    got = estimates(made, ["g"], policy, [0.2, 0.5]).collect()
    assert {r["g"] for r in got} == {None, "g0", "g1", "g2", "few"}
    for r in got:
        x = np.array([v for g, v in rows if g == r["g"] and v is not None])
        first, last = (x < r["value"]).sum() / max(1, len(x) - 1), ((x <= r["value"]).sum() - 1) / max(1, len(x) - 1)
        assert r["n"] == len(x) and first <= r["high"] + 1e-9 and r["low"] <= last + 1e-9 and r["exact"] == (len(x) <= 16)
    again = merge(made.unionByName(made), ["g"], policy)
    assert {r["g"]: r["n"] for r in again.collect()} == {r["g"]: 2 * r["n"] for r in got}
    assert [r["n"] for r in summarize(df, "x", [], policy).collect()] == [sum(v is not None for _, v in rows)]
    assert summarize(df.where("false"), "x", ["g"], policy).count() == 0
    with pytest.raises(Exception, match="non-finite"):
        summarize(df.select("g", F.lit(float("nan")).alias("x")), "x", ["g"], policy).collect()


def test_entries_stay_few_however_many_tasks(spark):
    """Ties and many merges: the entries once grew with the tasks, past their limit."""
    rng, policy = np.random.default_rng(8), Policy(0.005, 16, 700)
    x = rng.integers(0, 50, 120_000)
    df = spark.createDataFrame([(int(v),) for v in x], "x long").withColumn("g", F.lit("a")).repartition(120)
    got = estimates(summarize(df, "x", ["g"], policy), ["g"], policy, [0.11, 0.31, 0.51, 0.71, 0.91]).collect()
    assert sorted(r["value"] for r in got) == [float(v) for v in np.quantile(x, [0.11, 0.31, 0.51, 0.71, 0.91], method="inverted_cdf")]
    assert all(r["n"] == len(x) and r["entries"] <= 3 / policy.error for r in got)


def test_few_rows_a_group_run_no_python(spark):
    df, policy = spark.range(4000).selectExpr("id % 1000 AS g", "id * 1.0 AS x"), Policy(0.01, 256, 256)
    made = estimates(summarize(df, "x", ["g"], policy), ["g"], policy, [0.5])
    assert made.where("value = g + 1500.0 AND n = 4 AND entries = 4 AND exact AND low = 0.5").count() == 1000
    plan = summarize(df, "x", ["g"], policy)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" not in plan
