"""Descriptive, robust, fairness and claim statistics as grouped aggregations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.tables import indexed, table

#: The four-fifths rule's threshold (fixed value).
FOUR_FIFTHS = 0.8


def finite(x: str | Column) -> Column:
    """The value; raises on NaN or an infinity."""
    c = (F.col(x) if isinstance(x, str) else x).cast("double")
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("non-finite value")).cast("double")).otherwise(c)


def describe(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """n, total, mean, population and sample variance, least, most by group."""
    x = finite(value)
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.var_samp(x).alias("sample_variance"), F.min(x).alias("least"), F.max(x).alias("most")
    )


def exact_quantiles(df: DataFrame, value: str, keys: list[str], qs: list[float]) -> DataFrame:
    """Quantiles at position q (n - 1), interpolated; exact, so each group's distinct values are counted in one aggregation buffer."""
    return df.groupBy(*keys).agg(F.percentile(finite(value), F.array(*map(F.lit, qs))).alias("v")).select(*keys, F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("v").alias("v"))).alias("z")).select(*keys, F.col("z")["q"].alias("q"), F.col("z")["v"].alias("value"))


def sketch_quantiles(df: DataFrame, value: str, keys: list[str], qs: list[float], accuracy: int = 200) -> DataFrame:
    """Quantiles from mergeable KLL summaries: bounded memory a group, partial summaries merged after the shuffle.

    q, value, and the rank interval [low, high] that the summary's size guarantees.
    """
    summary = df.groupBy(*keys).agg(F.kll_sketch_agg_double(finite(value), F.lit(accuracy)).alias("s"))
    error = 2.296 / accuracy**0.9433  # fixed values: the summary's normalised rank error at 99 % confidence
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("s", F.lit(q)).alias("value")) for q in qs])).alias("e")
    return summary.select(*keys, each).select(*keys, "e.q", "e.value").select(*keys, "q", "value", F.greatest(F.col("q") - error, F.lit(0.0)).alias("low"), F.least(F.col("q") + error, F.lit(1.0)).alias("high"))


def merged_sketches(parts: DataFrame, sketch: str, keys: list[str]) -> DataFrame:
    """Summaries of parts merged by group."""
    return parts.groupBy(*keys).agg(F.kll_merge_agg_double(sketch).alias(sketch))


def entropy(df: DataFrame, category: str, keys: list[str]) -> DataFrame:
    """Shannon entropy in bits of a category's shares by group."""
    counts = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("c"))
    # H = log2(n) - sum(c log2 c) / n: one more aggregation, no join back to the totals
    n = F.sum("c")
    return counts.groupBy(*keys).agg((F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("entropy"))


def vector_entropy(p: Column) -> Column:
    """Of a probability vector; raises unless it sums to 1 within 1e-12."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    return F.when(F.abs(total - 1) > 1e-12, F.raise_error(F.lit("probabilities must sum to 1")).cast("double")).otherwise(bits)


def bayes(prior: Column, likelihood: Column, evidence: Column) -> Column:
    post = F.try_divide(prior * likelihood, evidence)
    return F.when(post.isNull() | (post < 0) | (post > 1), F.raise_error(F.lit("not a probability")).cast("double")).otherwise(post)


def bayes_binary(prior: Column, hit: Column, false_alarm: Column) -> Column:
    return bayes(prior, hit, prior * hit + (1 - prior) * false_alarm)


def selection(df: DataFrame, group: str, selected: Column) -> DataFrame:
    """Selected, total and selection rate by group."""
    return df.groupBy(group).agg(F.count_if(selected).alias("selected"), F.count(F.lit(1)).alias("total"), F.avg(selected.cast("double")).alias("rate"))


def disparate_impact(df: DataFrame, reference: Column, selected: Column) -> DataFrame:
    """One row: both rates, their ratio (comparison over reference), and whether it meets the four-fifths rule."""
    rate = lambda c: F.avg(F.when(c, selected.cast("double")))
    return df.agg(rate(reference).alias("reference_rate"), rate(~reference).alias("comparison_rate")).withColumn("ratio", F.try_divide("comparison_rate", "reference_rate")).withColumn("passes", F.col("ratio") >= FOUR_FIFTHS)


def median_absolute_deviation(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Median and raw median absolute deviation by group; medians, a row a group, are joined back."""
    medians = df.groupBy(*keys).agg(F.percentile(finite(value), F.lit(0.5)).alias("median"))
    return df.join(medians, keys).groupBy(*keys).agg(F.first("median").alias("median"), F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"))


def regression(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def claims(*named: tuple[str, DataFrame]) -> DataFrame:
    """Long rows (metric, subject, value) from (metric, DataFrame of subject, value)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(m).alias("metric"), F.col("subject").cast("string"), F.col("value").cast("double")) for m, df in named])


# ---- bootstrap


def splitmix(state: np.ndarray) -> np.ndarray:
    """SplitMix64's output function of states (fixed constants of the published generator)."""
    with np.errstate(over="ignore"):
        z = state.astype(np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


GOLDEN = 0x9E3779B97F4A7C15


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """Outputs number `first` to `first + count - 1` of the generator seeded with `seed`; any block can be computed alone."""
    with np.errstate(over="ignore"):
        return splitmix(np.uint64(seed & (2**64 - 1)) + np.uint64(GOLDEN) * (np.arange(count, dtype=np.uint64) + np.uint64(first + 1)))


def below(x: np.ndarray, n: int) -> np.ndarray:
    """Multiply-shift map of 64-bit draws to 0 … n - 1: the high word of x n, for n < 2^32."""
    high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    return ((high * np.uint64(n) + ((low * np.uint64(n)) >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


#: Values of an arm that one task resamples.
BOOTSTRAP_BLOCK = 1 << 18


def _shared(counts: np.ndarray, block: int, blocks: int, sizes: tuple[int, int], seed: int, arm: int) -> np.ndarray:
    """How many of each replicate's draws fall into a block: the draws are split binomially between the halves of the blocks, and so on
    down to one, each split by a generator of its own, so that every task finds the same numbers for the splits it shares."""
    length, n = sizes
    low, high = 0, blocks
    while high - low > 1:
        middle = (low + high) // 2
        left = min(middle * length, n) - low * length
        share = left / (min(high * length, n) - low * length)
        first = np.random.Generator(np.random.Philox(key=[seed, arm * 2**62 + low * 2**31 + high])).binomial(counts, share)
        counts, low, high = (first, low, middle) if block < middle else (counts - first, middle, high)
    return counts


def _resampled(values: DataFrame, n: int, arm: int, first: int, stride: int, seed: int, resamples: int, block: int) -> DataFrame:
    """replicate, total: sums of n draws from `values(idx, x)`."""
    blocks = -(-n // block)

    def one(group: pa.Table) -> pa.Table:
        own = int(group.column("idx")[0].as_py()) // block
        x = group.column("x").to_numpy(zero_copy_only=False)[np.argsort(group.column("idx").to_numpy())]
        counts = _shared(np.full(resamples, n), own, blocks, (block, n), seed, arm)
        totals = np.empty(resamples)
        for r in range(resamples):
            if blocks == 1:  # the one seeded stream, in which each replicate's draws have their place
                at = draws(seed, r * stride + first, n)
            else:
                at = np.random.Generator(np.random.Philox(key=[seed, 2**63 + arm * 2**62 + own * 2**31 + r])).integers(0, 2**64, counts[r], np.uint64)
            totals[r] = x[below(at, len(x))].sum()
        return pa.table({"replicate": np.arange(resamples), "total": totals})

    dealt = values.withColumn("block", F.floor(F.col("idx") / block)).groupBy("block").applyInArrow(one, "replicate long, total double")
    return dealt.groupBy("replicate").agg(F.sum("total").alias("total"))


def bootstrap_mean_difference(df: DataFrame, arm: str, value: str, baseline: str, candidate: str, seed: int = 19, resamples: int = 2000, level: float = 0.95, block: int = BOOTSTRAP_BLOCK) -> DataFrame:
    """Percentile interval of mean(candidate) - mean(baseline): both arms resampled independently, baseline's draws first in each replicate.

    An arm's values lie in blocks, each resampled by one task for all replicates. An arm of one block takes its draws from one seeded
    stream; of a larger arm each replicate's draws are first split over the blocks (see `_shared`). What is shuffled is a sum a block
    and replicate. Values are taken in order of column `pos` if there is one, else of themselves; null values are left out.
    """
    x = finite(value)
    arms = df.where(F.col(arm).isin(baseline, candidate) & F.col(value).isNotNull()).select(F.col(arm).alias("arm"), x.alias("x"), *([F.col("pos")] if "pos" in df.columns else []))
    known = {r["arm"]: r for r in arms.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")).collect()}  # two rows
    if len(known) < 2:
        raise ValueError("both arms need values")
    sizes = [known[k]["n"] for k in (baseline, candidate)]
    each = []
    for i, name in enumerate((baseline, candidate)):
        placed = indexed(arms.where(F.col("arm") == name), ["pos"] if "pos" in arms.columns else ["x"])
        each.append(_resampled(placed.select("idx", "x"), sizes[i], i, sizes[0] * i, sum(sizes), seed, resamples, block))
    effects = each[0].withColumnRenamed("total", "base").join(each[1], "replicate").select((F.col("total") / sizes[1] - F.col("base") / sizes[0]).alias("effect"))
    tail = (1 - level) / 2
    effect = float(known[candidate]["mean"] - known[baseline]["mean"])
    return effects.agg(F.lit(effect).alias("effect"), F.percentile("effect", F.lit(tail)).alias("low"), F.percentile("effect", F.lit(1 - tail)).alias("high"), F.count(F.lit(1)).alias("resamples"))


# ---- queries


def q_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = describe(table(spark, sf_dir, "events"), "value", ["event_type"])
    return t.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("total", "mean", "variance", "sample_variance", "least", "most")))


def q_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_quantiles(table(spark, sf_dir, "events"), "value", ["event_type"], [0.0, 0.1, 0.5, 0.9, 1.0]).select("event_type", "q", F.round("value", 6).alias("value"))


def q_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KLL estimates beside the true ranks of their values: `inside` says that the guaranteed interval holds the true rank."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"))
    qs = [0.1, 0.5, 0.9]
    got = sketch_quantiles(lines, "x", ["l_returnflag"], qs)
    wide = got.groupBy("l_returnflag").pivot("q", qs).agg(F.first(F.struct("value", "low", "high")))
    ranks = lines.join(F.broadcast(wide), "l_returnflag").groupBy("l_returnflag").agg(*(F.avg((F.col("x") <= F.col(f"`{q}`.value")).cast("double")).alias(f"r{q}") for q in qs), *(F.first(F.col(f"`{q}`")).alias(f"b{q}") for q in qs))
    inside = reduce(lambda a, q: a & F.col(f"`r{q}`").between(F.col(f"`b{q}`.low"), F.col(f"`b{q}`.high")), qs, F.lit(True))
    return ranks.select("l_returnflag", F.lit(3).alias("quantiles"), inside.alias("inside"))


def q_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy(table(spark, sf_dir, "lineitem"), "l_linenumber", ["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus", F.round("entropy", 6).alias("entropy"))


def q_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return median_absolute_deviation(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


def q_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection(table(spark, sf_dir, "labels"), "quality", F.col("toxic") == 1).withColumn("rate", F.round("rate", 6))


def q_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = disparate_impact(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return t.select(*(F.round(c, 6).alias(c) for c in ("reference_rate", "comparison_rate", "ratio")), "passes")


def q_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, s = F.col("toxic") == 1, F.col("quality") == 0
    t = table(spark, sf_dir, "labels").agg(F.avg(y.cast("double")).alias("prior"), F.avg(F.when(y, s.cast("double"))).alias("hit"), F.avg(F.when(~y, s.cast("double"))).alias("alarm"))
    return t.select(F.round("prior", 6).alias("prior"), F.round(bayes_binary(F.col("prior"), F.col("hit"), F.col("alarm")), 6).alias("posterior"))


def q_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = describe(e, "value", ["event_type"])
    made = claims(
        ("mean", d.select(F.col("event_type").alias("subject"), F.col("mean").alias("value"))), ("variance", d.select(F.col("event_type").alias("subject"), F.col("variance").alias("value"))),
        ("entropy", entropy(e.withColumn("all", F.lit("event_type")), "event_type", ["all"]).select(F.col("all").alias("subject"), F.col("entropy").alias("value"))),
        ("disparate-impact", disparate_impact(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0).select(F.lit("labels").alias("subject"), F.col("ratio").alias("value"))),
    )
    return made.withColumn("value", F.round("value", 6))


def q_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return t.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of purchases less that of clicks, over all events of these types."""
    events = table(spark, sf_dir, "events").select("event_type", "value", F.col("event_id").alias("pos"))
    return bootstrap_mean_difference(events, "event_type", "value", "click", "purchase", resamples=200).select(*(F.round(c, 6).alias(c) for c in ("effect", "low", "high")), "resamples")


def _mixed(z: str, shift: int, factor: int) -> str:
    return f"((xor({z}, {z} >> {shift})::uhugeint * {factor}) % 18446744073709551616)::ubigint"


BOOTSTRAP_SQL = f"""
WITH e AS (SELECT event_type = 'purchase' AS b, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL),
v AS (SELECT b, count(*) AS n, avg(x) AS mean FROM e GROUP BY b),
s AS (SELECT sum(n)::bigint AS total, max(CASE WHEN b THEN 0 ELSE n END) AS base FROM v),
d AS (SELECT b, r, n, unnest(range(n)) + r * total + CASE WHEN b THEN base ELSE 0 END AS place FROM v, s, (SELECT unnest(range(200)) AS r)),
z0 AS (SELECT b, r, n, ((19 + {GOLDEN}::uhugeint * (place + 1)::uhugeint) % 18446744073709551616)::ubigint AS z FROM d),
z1 AS (SELECT b, r, n, {_mixed("z", 30, 0xBF58476D1CE4E5B9)} AS z FROM z0), z2 AS (SELECT b, r, n, {_mixed("z", 27, 0x94D049BB133111EB)} AS z FROM z1),
pick AS (SELECT b, r, ((xor(z, z >> 31)::uhugeint * n::uhugeint) >> 64)::bigint AS i FROM z2),
t AS (SELECT b, r, avg(x) AS m FROM pick JOIN e USING (b, i) GROUP BY b, r),
f AS (SELECT r, sum(CASE WHEN b THEN m ELSE -m END) AS effect FROM t GROUP BY r)
SELECT (SELECT round(sum(CASE WHEN b THEN mean ELSE -mean END), 6) FROM v) AS effect, round(quantile_cont(effect, 0.025), 6) AS low, round(quantile_cont(effect, 0.975), 6) AS high, count(*) AS resamples FROM f
"""


QUERIES = {
    "stats_describe": (q_describe, "SELECT event_type, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(var_samp(value), 6) AS sample_variance, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY event_type"),
    "stats_quantile": (q_quantile, "SELECT event_type, q::double AS q, round(quantile_cont(value, q), 6) AS value FROM events, (SELECT unnest([0.0, 0.1, 0.5, 0.9, 1.0]) AS q) GROUP BY event_type, q".replace("quantile_cont(value, q)", "CASE q WHEN 0.0 THEN quantile_cont(value, 0.0) WHEN 0.1 THEN quantile_cont(value, 0.1) WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.9 THEN quantile_cont(value, 0.9) ELSE quantile_cont(value, 1.0) END")),
    "stats_quantile_sketch": (q_sketch, "SELECT DISTINCT l_returnflag, 3 AS quantiles, true AS inside FROM lineitem"),
    "stats_entropy": (q_entropy, "WITH c AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY l_returnflag, l_linestatus) AS p FROM c) SELECT l_returnflag, l_linestatus, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY ALL"),
    "stats_mad": (q_mad, "SELECT event_type, round(median(value), 6) AS median, round(mad(value), 6) AS mad FROM events GROUP BY event_type"),
    "stats_selection_rate": (q_selection, "SELECT quality, count(*) FILTER (toxic = 1) AS selected, count(*) AS total, round(avg((toxic = 1)::int), 6) AS rate FROM labels GROUP BY quality"),
    "stats_disparate_impact": (q_impact, "WITH r AS (SELECT avg((toxic = 0)::int) FILTER (quality = 1) AS a, avg((toxic = 0)::int) FILTER (quality <> 1) AS b FROM labels) SELECT round(a, 6) AS reference_rate, round(b, 6) AS comparison_rate, round(b / a, 6) AS ratio, b / a >= 0.8 AS passes FROM r"),
    "stats_bayes_binary": (q_bayes, "SELECT round(avg((toxic = 1)::int), 6) AS prior, round(count(*) FILTER (toxic = 1 AND quality = 0) / count(*) FILTER (quality = 0), 6) AS posterior FROM labels"),
    "stats_claims": (q_claims, "SELECT 'mean' AS metric, event_type AS subject, round(avg(value), 6) AS value FROM events GROUP BY event_type UNION ALL SELECT 'variance', event_type, round(var_pop(value), 6) FROM events GROUP BY event_type UNION ALL SELECT 'entropy', 'event_type', round(entropy(event_type), 6) FROM events UNION ALL SELECT 'disparate-impact', 'labels', round(avg((toxic = 0)::int) FILTER (quality <> 1) / avg((toxic = 0)::int) FILTER (quality = 1), 6) FROM labels"),
    "stats_regression": (q_regression, "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag"),
    "stats_bootstrap": (q_bootstrap, BOOTSTRAP_SQL),
}
