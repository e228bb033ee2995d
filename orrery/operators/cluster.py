"""k-means and Gaussian mixtures on array columns: Spark sums the statistics of each round, the driver holds the model alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.sequence import Units
from orrery.sources.tables import table


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _total(points: DataFrame, count, size: int) -> np.ndarray:
    """Sum of the vectors of `size` numbers that `count` makes of each task's points."""
    rows = points.mapInPandas(count, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


# ---- k-means


@dataclass
class KMeans:
    centers: np.ndarray
    inertia: float
    work: int
    rounds: int


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centers[None]) ** 2).sum(2)


def _restart_seeds(seed: int, restarts: int) -> list[int]:
    return [Units(seed ^ r).next() for r in range(restarts)]


def plus_plus(points: DataFrame, value: str, key: str, k: int, units: Units, n: int) -> np.ndarray:
    """k-means++ starts: a uniform point, then points by squared distance to the nearest start so far.

    The draw over squared distances walks the points in order of `key`: sums per range of keys locate the range, and only that range is
    read to find the point. Ranges hold about 4096 points.
    """
    ordered = points.select(key, value)
    parts = max(1, -(-n // 4096))
    cuts = ordered.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    from bisect import bisect_right

    bucket = F.udf(lambda x: bisect_right(cuts, x), "int")(key) if cuts else F.lit(0)
    dealt = ordered.withColumn("b", bucket)
    sizes = {r["b"]: r["n"] for r in dealt.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
    target, centers = units.next() % n, []
    for b in sorted(sizes):
        if target < sizes[b]:
            centers.append(np.array(dealt.where(F.col("b") == b).orderBy(key).collect()[target][value], float))
            break
        target -= sizes[b]
    while len(centers) < k:
        now = np.array(centers)

        def weigh(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            for batch in batches:
                d = _distances(_matrix(batch[value]), now).min(1)
                yield pd.DataFrame({"i": batch["b"], "v": d}).groupby("i", as_index=False).sum()

        sums = {r["i"]: r["v"] for r in dealt.mapInPandas(weigh, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        left = units.unit() * sum(sums[b] for b in sorted(sums))
        for b in sorted(sums):
            if left < sums[b] or b == max(sums):
                x = _matrix(dealt.where(F.col("b") == b).orderBy(key).select(value).toPandas()[value])
                run = np.cumsum(_distances(x, now).min(1))
                centers.append(x[min(int(np.searchsorted(run, left, side="right")), len(x) - 1)])
                break
            left -= sums[b]
    return np.array(centers)


def fit_kmeans(points: DataFrame, value: str, key: str, k: int, seed: int = 4, restarts: int = 4, rounds: int = 50, start: np.ndarray | None = None) -> KMeans:
    """Lloyd's rounds from k-means++ starts, or once from `start`; empty clusters take the points farthest from their centers, one each. Of the restarts the lowest inertia
    wins, ties to the first; centers come in lexicographic order. `work`: distances computed."""
    points = points.select(key, value).cache()
    n = points.count()
    if n < k:
        raise ValueError("fewer points than clusters")
    best, work = None, 0
    for s in _restart_seeds(seed, restarts if start is None else 1):
        centers = plus_plus(points, value, key, k, Units(s), n) if start is None else np.array(start, float)
        d = centers.shape[1]
        for number in range(rounds):

            def sums(batches: Iterator[pd.DataFrame], centers=centers) -> Iterator[pd.DataFrame]:
                out = np.zeros((k, d + 2))
                for batch in batches:
                    x = _matrix(batch[value])
                    dist = _distances(x, centers)
                    near = dist.argmin(1)
                    np.add.at(out[:, :d], near, x)
                    out[:, d] += np.bincount(near, minlength=k)
                    out[:, d + 1] += np.bincount(near, dist.min(1), k)
                yield pd.DataFrame({"i": np.arange(out.size), "v": out.ravel()})

            total = _total(points, sums, k * (d + 2)).reshape(k, d + 2)
            work += n * k
            fresh = np.where(total[:, d : d + 1] > 0, total[:, :d] / np.maximum(total[:, d : d + 1], 1), centers)
            if len(empty := np.flatnonzero(total[:, d] == 0)):
                # the worst-fit points, farthest first, one place each
                far = points.mapInPandas(lambda bs, c=centers: (pd.DataFrame({key: b[key], "x": b[value], "d": _distances(_matrix(b[value]), c).min(1)}) for b in bs), f"{key} long, x array<double>, d double")
                worst = far.groupBy("x").agg(F.max("d").alias("d"), F.min(key).alias(key)).orderBy(F.desc("d"), key).limit(len(empty)).collect()
                for at, row in zip(empty, worst, strict=False):
                    fresh[at] = row["x"]
            done = np.allclose(fresh, centers, rtol=0, atol=1e-12)
            centers, inertia = fresh, float(total[:, d + 1].sum())
            if done:
                break
        if best is None or inertia < best.inertia:
            best = KMeans(np.array(sorted(centers.tolist())), inertia, 0, number + 1)
    points.unpersist()
    best.work = work
    return best


def assign(points: DataFrame, value: str, model: KMeans) -> DataFrame:
    """`points` with cluster and squared distance; ties to the lowest cluster. Centers are literals: pure Column expressions."""
    centers = [F.array(*[F.lit(float(v)) for v in c]) for c in model.centers]
    x = F.transform(value, lambda v: v.cast("double"))
    far = lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    ranked = F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)]))
    return points.withColumn("_near", ranked).withColumn("cluster", F.col("_near.i")).withColumn("distance", F.col("_near.d")).drop("_near")


# ---- Gaussian mixtures


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray  # k x d (diagonal) or k x d x d (full)
    log_likelihood: float = float("nan")
    rounds: int = 0
    n: int = 0

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + k * d + self.covariances.size if self.covariances.ndim == 2 else k - 1 + k * d + k * d * (d + 1) // 2

    @property
    def aic(self) -> float:
        return 2 * self.parameters - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return self.parameters * float(np.log(self.n)) - 2 * self.log_likelihood

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for j, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            if self.covariances.ndim == 2:
                quad, det = ((x - m) ** 2 / c).sum(1), np.log(c).sum()
            else:
                low = np.linalg.cholesky(c)
                quad, det = (np.linalg.solve(low, (x - m).T) ** 2).sum(0), 2 * np.log(np.diag(low)).sum()
            out[:, j] = np.log(w) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + det + quad)
        return out


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(1, keepdims=True)))[:, 0]


def fit_gmm(points: DataFrame, value: str, key: str, k: int, seed: int = 4, full: bool = False, regularization: float = 1e-6, tolerance: float = 1e-9, rounds: int = 100, start: np.ndarray | None = None) -> Mixture:
    """Expectation-maximisation from k-means++ means (or the means `start`), equal weights and the global covariance; stops when the mean log-likelihood gains no
    more than `tolerance`. Components come in lexicographic order of means."""
    points = points.select(key, value).cache()
    n = points.count()
    means = plus_plus(points, value, key, k, Units(_restart_seeds(seed, 1)[0]), n) if start is None else np.array(start, float)
    d = means.shape[1]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, ss = np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch[value])
            s += x.sum(0)
            ss += x.T @ x
        yield pd.DataFrame({"i": np.arange(d + d * d), "v": np.concatenate([s, ss.ravel()])})

    v = _total(points, moments, d + d * d)
    mean = v[:d] / n
    spread = v[d:].reshape(d, d) / n - np.outer(mean, mean) + regularization * np.eye(d)
    model = Mixture(np.full(k, 1 / k), means, np.array([spread if full else np.diag(spread)] * k), n=n)
    last = -np.inf
    for number in range(1, rounds + 1):

        def expect(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            ll, mass, s, ss = 0.0, np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
            for batch in batches:
                x = _matrix(batch[value])
                joint = model.log_joint(x)
                norm = _log_sum(joint)
                r = np.exp(joint - norm[:, None])
                ll += norm.sum()
                mass += r.sum(0)
                s += r.T @ x
                for j in range(k):
                    y = x - model.means[j]  # about the old mean, so that squares don't cancel
                    ss[j] += (r[:, j : j + 1] * y).T @ y
            out = np.concatenate([[ll], mass, s.ravel(), ss.ravel()])
            yield pd.DataFrame({"i": np.arange(len(out)), "v": out})

        v = _total(points, expect, 1 + k + k * d + k * d * d)
        model.log_likelihood, model.rounds = float(v[0]), number
        if v[0] - last <= tolerance:
            break
        last = v[0]
        mass, s, ss = np.maximum(v[1 : 1 + k], 1e-8), v[1 + k : 1 + k + k * d].reshape(k, d), v[1 + k + k * d :].reshape(k, d, d)
        means = s / mass[:, None]
        shift = means - model.means
        cov = ss / mass[:, None, None] - shift[:, :, None] * shift[:, None, :] + regularization * np.eye(d)
        model = Mixture(mass / mass.sum(), means, cov if full else np.array([np.diag(c) for c in cov]), last, number, n)  # the likelihood is that before this update
    points.unpersist()
    order = sorted(range(k), key=lambda j: model.means[j].tolist())
    return Mixture(model.weights[order], model.means[order], model.covariances[order], model.log_likelihood, model.rounds, n)


def responsibilities(points: DataFrame, value: str, key: str, model: Mixture) -> DataFrame:
    """key, component (ties to the lowest), responsibilities, log density."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            joint = model.log_joint(_matrix(batch[value]))
            norm = _log_sum(joint)
            r = np.exp(joint - norm[:, None])
            yield pd.DataFrame({key: batch[key], "component": r.argmax(1), "responsibilities": r.tolist(), "log_density": norm})

    return points.select(key, value).mapInPandas(of, f"{key} long, component int, responsibilities array<double>, log_density double")


# ---- queries


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))


def q_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    model = fit_kmeans(points, "v", "vec_id", 4, restarts=2, rounds=20)
    return assign(points, "v", model).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 4).alias("inertia"))


FIXED = KMeans(np.array([[-0.1, -0.1, -0.1, -0.1], [0.1, -0.1, 0.1, -0.1], [0.1, 0.1, 0.1, 0.1]]), 0.0, 0, 0)


def q_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four components, for which the centers and the SQL are written."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("v"))
    return assign(points, "v", FIXED).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


def _far(c) -> str:
    return " + ".join(f"(embedding[{i + 1}]::double - ({v}))^2" for i, v in enumerate(c))


ASSIGN_SQL = f"""WITH d AS (SELECT vec_id, {", ".join(f"{_far(c)} AS d{i}" for i, c in enumerate(FIXED.centers.tolist()))} FROM embeddings)
SELECT vec_id, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster, round(least(d0, d1, d2), 6) AS distance FROM d"""


WIDE = KMeans(np.array([np.full(64, -0.1), np.resize([0.1, -0.1], 64), np.full(64, 0.1)]), 0.0, 0, 0)


def q_assign_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components, to centers of 64."""
    return assign(_points(spark, sf_dir), "v", WIDE).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


_WIDE_CELLS = "(SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::double AS x FROM embeddings)"
ASSIGN_WIDE_SQL = f"""WITH d AS (SELECT vec_id, sum((x + 0.1) ^ 2) AS d0, sum((x - CASE WHEN pos % 2 = 0 THEN 0.1 ELSE -0.1 END) ^ 2) AS d1, sum((x - 0.1) ^ 2) AS d2 FROM {_WIDE_CELLS} GROUP BY vec_id)
SELECT vec_id, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster, round(least(d0, d1, d2), 6) AS distance FROM d"""


def q_gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    model = fit_gmm(points, "v", "vec_id", 3, rounds=15)
    return responsibilities(points, "v", "vec_id", model).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("log_density"), 3).alias("log_likelihood"))


def q_kmeans_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of Lloyd's rounds over all components from fixed centers: the centers they give, and the inertia before the last."""
    model = fit_kmeans(_points(spark, sf_dir), "v", "vec_id", 3, rounds=2, start=WIDE.centers)
    rows = [(i, j, float(v)) for i, c in enumerate(model.centers) for j, v in enumerate(c)]
    return spark.createDataFrame(rows, "cluster int, pos int, center double").select("cluster", "pos", F.round("center", 6).alias("center"), F.lit(round(model.inertia, 4)).alias("inertia"))


def _nearest(centers: str) -> str:
    return f"SELECT x.vec_id, c.c, sum((x.x - c.x) ^ 2) AS d FROM x JOIN {centers} c ON c.pos = x.pos GROUP BY x.vec_id, c.c QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY d, c.c) = 1"


KMEANS_ROUND_SQL = f"""WITH x AS {_WIDE_CELLS}, c0 AS (SELECT c, pos, CASE WHEN c = 0 THEN -0.1 WHEN c = 2 OR pos % 2 = 0 THEN 0.1 ELSE -0.1 END AS x FROM (SELECT unnest([0, 1, 2]) AS c), (SELECT unnest(range(64)) AS pos)),
n0 AS ({_nearest("c0")}), c1 AS (SELECT c, pos, avg(x) AS x FROM n0 JOIN x USING (vec_id) GROUP BY c, pos), n1 AS ({_nearest("c1")}),
c2 AS (SELECT c, pos, avg(x) AS x FROM n1 JOIN x USING (vec_id) GROUP BY c, pos), named AS (SELECT c, row_number() OVER (ORDER BY list(x ORDER BY pos)) - 1 AS cluster FROM c2 GROUP BY c)
SELECT cluster, pos, round(x, 6) AS center, (SELECT round(sum(d), 4) FROM n1) AS inertia FROM c2 JOIN named USING (c)"""


def q_gmm_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of expectation-maximisation from fixed means: the mixture it gives, read from its second round's likelihood on."""
    model = fit_gmm(_points(spark, sf_dir), "v", "vec_id", 3, rounds=1, start=WIDE.centers * 0.5)
    rows = [(i, j, float(model.weights[i]), float(model.means[i, j]), float(model.covariances[i, j])) for i in range(3) for j in range(64)]
    out = spark.createDataFrame(rows, "component int, pos int, weight double, mean double, variance double")
    return out.select("component", "pos", *(F.round(c, 5).alias(c) for c in ("weight", "mean", "variance")), F.lit(round(model.log_likelihood, 3)).alias("log_likelihood"))


GMM_ROUND_SQL = f"""WITH x AS {_WIDE_CELLS}, g AS (SELECT pos, var_pop(x) + 1e-6 AS v FROM x GROUP BY pos),
m AS (SELECT c, pos, 0.5 * CASE WHEN c = 0 THEN -0.1 WHEN c = 2 OR pos % 2 = 0 THEN 0.1 ELSE -0.1 END AS m FROM (SELECT unnest([0, 1, 2]) AS c), (SELECT unnest(range(64)) AS pos)),
j AS (SELECT vec_id, c, ln(1.0 / 3) - 0.5 * sum(ln(2 * pi()) + ln(v) + (x - m) ^ 2 / v) AS j FROM x JOIN m USING (pos) JOIN g USING (pos) GROUP BY vec_id, c),
z AS (SELECT vec_id, max(j) + ln(sum(exp(j - top))) AS z FROM (SELECT *, max(j) OVER (PARTITION BY vec_id) AS top FROM j) GROUP BY vec_id),
r AS (SELECT vec_id, c, exp(j - z) AS r FROM j JOIN z USING (vec_id)), w AS (SELECT c, sum(r) AS w FROM r GROUP BY c),
e AS (SELECT c, pos, sum(r * x) / any_value(w) AS mean FROM r JOIN x USING (vec_id) JOIN w USING (c) GROUP BY c, pos),
v AS (SELECT c, pos, sum(r * (x - mean) ^ 2) / any_value(w) + 1e-6 AS variance FROM r JOIN x USING (vec_id) JOIN w USING (c) JOIN e USING (c, pos) GROUP BY c, pos),
named AS (SELECT c, row_number() OVER (ORDER BY list(mean ORDER BY pos)) - 1 AS component FROM e GROUP BY c)
SELECT component, pos, round(w / (SELECT sum(w) FROM w), 5) AS weight, round(mean, 5) AS mean, round(variance, 5) AS variance, (SELECT round(sum(z), 3) FROM z) AS log_likelihood
FROM e JOIN v USING (c, pos) JOIN w USING (c) JOIN named USING (c)"""


QUERIES = {"kmeans_fit": (q_kmeans, None), "kmeans_assign": (q_assign, ASSIGN_SQL), "kmeans_assign_wide": (q_assign_wide, ASSIGN_WIDE_SQL), "gmm_fit": (q_gmm, None), "kmeans_round": (q_kmeans_round, KMEANS_ROUND_SQL), "gmm_round": (q_gmm_round, GMM_ROUND_SQL)}
