"""Golden values and definitions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from orrery.functions import arrays as A
from orrery.functions import expr as E
from orrery.functions import scalar as S
from orrery.operators import cluster, numeric, sequence, series, spectral, stats, tensor
from orrery.sources import blocks
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_scalars(spark):
    r = one(spark, S.sub(S.mul(F.lit(6), F.lit(7)), F.lit(2)), S.rational_text(S.rational_of(F.lit("6/8"))), S.add(F.lit(2**63 - 1), F.lit(1)), S.rem(F.lit(-7), F.lit(3)), S.divide(F.lit(-1.0), F.lit(0.0)), S.power(F.lit(3), F.lit(40)))
    assert [int(r[0]), r[1], int(r[2]), int(r[3]), r[4], int(r[5])] == [40, "3/4", 2**63, -1, -math.inf, 3**40]
    for bad in (S.rational_of(F.lit("1/0")), S.compare(F.lit(float("nan")), F.lit(1.0)), S.power(F.lit(2), F.lit(-1))):
        with pytest.raises(PySparkException):
            one(spark, bad)
    cf = S.fraction_coefficients(F.lit(-7), F.lit(3))
    r = one(spark, cf, S.rational_text(S.fraction_convergent(cf)), S.gcd(F.lit(2**62), F.lit(3 * 2**40)))
    assert [int(x) for x in r[0]] == [-3, 1, 2] and r[1] == "-7/3" and int(r[2]) == 2**40


def test_bootstrap_golden(spark):
    rows = [("base", i, x) for i, x in enumerate((101.0, 99.0, 100.0, 102.0, 98.0))] + [("new", i, x) for i, x in enumerate((91.0, 89.0, 90.0, 92.0, 88.0))]
    df = spark.createDataFrame(rows, "arm string, pos int, x double")
    got = stats.bootstrap_mean_difference(df, "arm", "x", "base", "new", 19, 2000, 0.95).first()
    assert got["effect"] == -10.0 and math.isclose(got["low"], -11.8, abs_tol=0.05) and math.isclose(got["high"], -8.2, abs_tol=0.05)
    mad = stats.median_absolute_deviation(df, "x", ["arm"]).where("arm = 'base'").first()
    assert mad["median"] == 100.0 and mad["mad"] == 1.0


def test_descriptive(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", x) for x in (9.0, 1.0, 5.0, 3.0)], "g string, x double")
    got = {r["g"]: r for r in stats.describe(df, "x", ["g"]).collect()}
    assert got["a"]["mean"] == 3.0 and got["a"]["variance"] == 2.0 and got["a"]["sample_variance"] == 2.5
    q = {(r["g"], r["q"]): r["value"] for r in stats.exact_quantiles(df, "x", ["g"], [0.5]).collect()}
    assert q["b", 0.5] == 4.0
    with pytest.raises(PySparkException):
        stats.describe(spark.createDataFrame([("a", float("nan"))], "g string, x double"), "x", ["g"]).collect()
    r = one(spark, stats.vector_entropy(F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25))), stats.bayes_binary(F.lit(0.01), F.lit(0.9), F.lit(0.05)))
    assert r[0] == 1.5 and math.isclose(r[1], 0.009 / (0.009 + 0.0495))
    picks = spark.createDataFrame([("ref", i < 80) for i in range(100)] + [("cmp", i < 48) for i in range(80)], "g string, s boolean")
    got = stats.disparate_impact(picks, F.col("g") == "ref", F.col("s")).first()
    assert math.isclose(got["ratio"], 0.75) and not got["passes"]


def test_sketch_ranks(spark):
    df = spark.range(10_000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("x"))
    for r in stats.sketch_quantiles(df, "x", ["k"], [0.05, 0.5, 0.95]).collect():
        assert r["low"] <= r["value"] / 10_000 <= r["high"] and abs(r["value"] / 10_000 - r["q"]) < 0.021
    halves = df.groupBy("k", (F.col("x") % 2).alias("h")).agg(F.kll_sketch_agg_double("x").alias("s"))
    merged = stats.merged_sketches(halves, "s", ["k"]).select(F.kll_sketch_get_quantile_double("s", F.lit(0.5)).alias("m")).first()
    assert abs(merged["m"] - 5000) < 210


def test_hidden_markov_golden(spark):
    m = sequence.EXAMPLE
    x = np.array([0, 0, 1, 1])
    assert round(m.forward_backward(x)[0], 6) == -2.852590 and m.viterbi(x).tolist() == [0, 0, 1, 1]
    rows = [(s, t, v) for s, seq in enumerate(([0, 0, 1, 1, 1, 0], [0, 1, 1, 0, 0, 0])) for t, v in enumerate(seq)]
    df = spark.createDataFrame(rows, "s int, t long, x int")
    _, found = sequence.fit(df, "s", 2, 2, 23, 6, 1e-6)
    assert math.isclose(found[-1], -7.624864, abs_tol=2e-4) and all(b >= a - 1e-9 for a, b in zip(found, found[1:]))
    got = sequence.decode(df.where("s = 0"), "s", m).orderBy("t").collect()
    assert [r["path"] for r in got] == m.viterbi(np.array([0, 0, 1, 1, 1, 0])).tolist()


def test_fnv():
    assert sequence.fnv1a64(b"") == 0xCBF29CE484222325 and sequence.fnv1a64(b"a") == 0xAF63DC4C8601EC8C


POINTS = [(-3.1, -3.0), (-3.0, -2.9), (-2.9, -3.1), (4.9, 5.0), (5.0, 5.1), (5.1, 4.9)]


def test_clusters_golden(spark):
    df = spark.createDataFrame([(i, list(p)) for i, p in enumerate(POINTS)], "i long, v array<double>")
    model = cluster.fit_kmeans(df, "v", "i", 2)
    assert np.allclose(model.centers, [[-3, -3], [5, 5]]) and math.isclose(model.inertia, 0.08, abs_tol=1e-9)
    assert [r["cluster"] for r in cluster.assign(df, "v", model).orderBy("i").collect()] == [0, 0, 0, 1, 1, 1]
    mixture = cluster.fit_gmm(df, "v", "i", 2)
    assert math.isclose(mixture.log_likelihood, 8.877666, abs_tol=1e-4) and math.isclose(mixture.aic, 0.244668, abs_tol=1e-3) and math.isclose(mixture.bic, -1.629497, abs_tol=1e-3)
    full = cluster.fit_gmm(df, "v", "i", 2, full=True)
    assert np.allclose(full.means, model.centers, atol=1e-6)


def test_tensors(spark):
    v = A.vec(F.array(F.lit(1), F.lit(2), F.lit(3)))
    r = one(spark, A.broadcasted(v, A.scalar(F.lit(10)), lambda a, b: a + b), A.to_integers(A.vec(F.array(F.lit(1.5), F.lit(2.5)))), A.trace(A.eye(4)), A.matmul(A.eye(2), A.mat(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), 2, 2)), A.block(A.mat(F.array(*map(F.lit, range(12))), 3, 4), [1, 1], [2, 2]), A.transpose(A.mat(F.array(*map(F.lit, range(6))), 2, 3)))
    assert r[0]["data"] == [11.0, 12.0, 13.0] and r[1]["data"] == [2, 2] and r[2] == 4.0 and r[3]["data"] == [1.0, 2.0, 3.0, 4.0]
    assert r[4]["data"] == [5.0, 6.0, 9.0, 10.0] and r[5]["data"] == [0.0, 3.0, 1.0, 4.0, 2.0, 5.0]
    for bad in (A.reshape(v, 2, 2)["data"], A.index(v, 3), A.to_integers(A.vec(F.array(F.lit(float("nan")))))["data"], A.to_single(A.vec(F.array(F.lit(1e300))))["data"], A.inverse(A.zeros(2, 2), 2)["data"], A.broadcasted(v, A.vec(F.array(F.lit(1), F.lit(2))), lambda a, b: a + b)["data"]):
        with pytest.raises(PySparkException):
            one(spark, bad)
    assert math.isnan(one(spark, A.most(A.vec(F.array(F.lit(1.0), F.lit(float("nan"))))))[0])


def test_determinants():
    m = [[2 if i == j else int(j > i) for j in range(20)] for i in range(20)]
    assert tensor.bareiss(m) == 1048576
    assert tensor.bareiss([[Fraction(1, 2), 1], [1, Fraction(1, 3)]]) == Fraction(-5, 6) and tensor.bareiss([[0, 1], [1, 0]]) == -1
    assert tensor.half_precision(np.array([1.0, 65504.0, 1e-8])).tolist()[:2] == [1.0, 65504.0]
    assert tensor.half_precision(np.array([1.00390625, 3.14159]), brain=True).tolist() == [1.0, 3.140625]


def series_of(spark, x):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k int, idx long, x double")


def values(df, c="y"):
    return [r[c] for r in df.orderBy("idx").collect()]


def test_convolution_and_smoothing(spark):
    df = series_of(spark, [1, 2, 3])
    assert values(series.convolve(df, ["k"], [1.0, -1.0])) == [1, 1, 1, -3]
    assert values(series.convolve(df, ["k"], [1.0, -1.0], "valid")) == [1, 1] and values(series.convolve(df, ["k"], [1.0, -1.0], "circular")) == [-2, 1, 1]
    x = np.random.default_rng(0).normal(size=50)
    for block in (7, 64):
        assert np.allclose(values(series.convolve_blocks(series_of(spark, x), ["k"], [1.0, 2.0, -1.0], block)), np.convolve(x, [1, 2, -1]))
    cubic = series.savitzky_golay(series_of(spark, [i**3 for i in range(12)]), ["k"], 2, 3, 2)
    assert np.allclose(values(cubic), [6 * i for i in range(2, 10)])
    for n in (1, 2, 7, 8):
        y = series_of(spark, x[:n])
        assert np.allclose(values(series.le_gall_inverse(series.le_gall(y, ["k"]), ["k"]), "x"), x[:n])
        assert np.allclose(values(series.haar_inverse(series.haar(y, ["k"]), ["k"]), "x")[:n], x[:n])
    assert series.haar_levels(series_of(spark, x[:8]), ["k"], 3).count() == 8
    m = series.taper_metrics(series.taper(64, "hann", periodic=True))
    assert math.isclose(m["coherent_gain"], 0.5) and math.isclose(m["enbw"], 1.5)
    assert np.allclose(series.taper(9, "kaiser", 5.0), np.kaiser(9, 5.0))
    dup = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, 2.0, 1.5), (0, 2, 2.0, 2.5), (0, 3, 3.0, 3.0)], "k int, idx long, t double, x double")
    clean = series.without_duplicates(dup, ["k"], "t", "x")
    assert [r["y"] for r in series.interpolate_linear(clean, ["k"], "t", "x", 1.0).orderBy("t").collect()] == [1.0, 2.0, 3.0]
    with pytest.raises(PySparkException):
        series.without_duplicates(dup, ["k"], "t", "x", "reject").collect()
    for kind in ("cubic", "monotone"):
        assert np.allclose([r["y"] for r in series.interpolate_smooth(clean, ["k"], "t", "x", 0.5, kind).orderBy("t").collect()], [1, 1.5, 2, 2.5, 3])


def test_transforms(spark):
    impulse = series_of(spark, [1, 0, 0, 0]).withColumnRenamed("k", "s")
    assert [(r["re"], r["im"]) for r in spectral.fft(impulse, ["s"], one_sided=False).orderBy("k").collect()] == [(1.0, 0.0)] * 4
    x = np.random.default_rng(3).normal(size=24)
    tone = spectral.fft(series_of(spark, [math.cos(2 * math.pi * 3 * n / 16) for n in range(16)]).withColumnRenamed("k", "s"), ["s"]).orderBy("k").collect()
    assert [round(math.hypot(r["re"], r["im"]), 9) for r in tone] == [0, 0, 0, 8, 0, 0, 0, 0, 0]
    two = spectral.fft_two_pass(spark.createDataFrame(list(enumerate(x.tolist())), "idx long, x double"), 24, 4).orderBy("k").collect()
    assert np.allclose([complex(r["re"], r["im"]) for r in two], np.fft.fft(x))
    v = spectral.slepian(32, 2.5, 4)
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-8)
    t = np.arange(400)
    mean, a, e = spectral.burg_fit(np.sin(0.3 * t) + 2, 2)
    assert np.allclose(a, [-2 * math.cos(0.3), 1], atol=0.02) and e < 0.01
    assert np.allclose(spectral.solve_toeplitz(np.array([4.0, 1, 2]), np.array([4.0, 3, 5]), np.array([1.0, 2, 3])), np.linalg.solve([[4, 3, 5], [1, 4, 3], [2, 1, 4]], [1, 2, 3]))
    seen = spectral.predict(series_of(spark, np.sin(0.3 * t)).withColumnRenamed("k", "s"), ["s"], 2, 2).orderBy("step").collect()
    assert np.allclose([r["y"] for r in seen], np.sin(0.3 * np.array([400, 401])), atol=0.05)


def test_symbols(spark):
    x, y = E.Var("x"), E.Var("y")
    assert E.simplify(x * 0 + y * 1 + 2 + 3) == E.lift(5) + y and (x**1) == x and (x**0) == E.lift(1)
    assert E.evaluate(E.differentiate(x**3 + E.sin(x) * y, "x"), {"x": 2.0, "y": 3.0}) == pytest.approx(12 + 3 * math.cos(2))
    assert E.evaluate(E.differentiate(x**y, "y"), {"x": 2.0, "y": 3.0}) == pytest.approx(8 * math.log(2))
    assert E.evaluate(E.integrate(x**2 * 3 + 1 / y, "x"), {"x": 2.0, "y": 4.0}) == pytest.approx(8.5)
    assert E.integrate(x**-1, "x") == E.ln(x) and E.free_variables(y * x + x) and E.to_json(x + 1) == '["add", "1", "x"]'
    with pytest.raises(ValueError):
        E.integrate(E.sin(x), "x")
    with pytest.raises(ValueError):
        E.register_derivative("sin", lambda u: u)
    assert E.differentiate(E.call("unknown", x), "x") == E.Op("diff", (E.call("unknown", x), x))
    f = E.Function(["x"], x**2)
    assert E.evaluate(f(3), {}) == 9 and len((f + E.Function(["y"], y)).grad()) == 2
    with pytest.raises(TypeError):
        f(1, 2)


def test_numeric(spark):
    square, three = lambda x: x * x, F.lit(3.0)
    r = one(spark, numeric.central3(square, three), numeric.richardson(square, three), *(m(F.sin, F.lit(0.0), F.lit(math.pi)) for m in numeric.QUADRATURE.values()), F.element_at(numeric.solve(lambda x, y: y, F.lit(0.0), F.lit(1.0), F.lit(1.0)), -1)["y"])
    assert r[0] == pytest.approx(6, abs=1e-6) and r[1] == pytest.approx(6, abs=1e-6) and all(v == pytest.approx(2, abs=1e-4) for v in r[2:-1]) and r[-1] == pytest.approx(math.e, rel=1e-8)
    rows = spark.createDataFrame([(0, 0.0, math.pi), (1, -1.0, 2.0)], "k int, a double, b double")
    got = {r["k"]: r for r in numeric.adaptive(rows, "k", "a", "b", lambda x: F.abs(F.sin(x))).collect()}
    assert got[0]["value"] == pytest.approx(2, abs=1e-9) and got[1]["value"] == pytest.approx(2 - math.cos(1) - math.cos(2), abs=1e-6) and got[1]["intervals"] > 1
    back = one(spark, numeric.solve(lambda x, y: y, F.lit(1.0), F.lit(math.e), F.lit(0.05), 0.1))[0]
    assert back[-1]["x"] == pytest.approx(0.05) and back[-1]["y"] == pytest.approx(math.exp(0.05), rel=1e-4)
    end = numeric.solve_adaptive(rows.withColumn("y", F.lit(1.0)), "k", lambda x, y: y, "a", "y", "b").orderBy("k").collect()
    assert [r["y"] for r in end] == pytest.approx([math.exp(math.pi), math.exp(3)], rel=1e-6)
    with pytest.raises(ValueError):
        numeric.solve(lambda x, y: y, F.lit(0.0), F.lit(1.0), F.lit(1.0), 0)
    with pytest.raises(ValueError):
        numeric.register(numeric.QUADRATURE, "simpson", numeric.simpson)


def test_blocks(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("idx"), F.rand(1).alias("x"))
    blocks.write_blocks(df, str(tmp_path / "b"), 16)
    back = blocks.read_blocks(spark, str(tmp_path / "b"), 2, 3)
    assert sorted(r["idx"] for r in back.collect()) == list(range(32, 64)) and blocks.plan_digest({"a": 1, "b": 2}) == blocks.plan_digest({"b": 2, "a": 1})


def test_markov(spark):
    rows = [(s, p, x) for s, seq in enumerate((["sun", "rain", "sun"], ["sun", "sun", "rain"])) for p, x in enumerate(seq)]
    pairs = sequence.transitions(spark.createDataFrame(rows, "s int, p int, x string"), "s", ["p"], "x")
    m = sequence.transition_matrix(pairs)
    got = {(r["from_state"], r["to_state"]): (r["n"], r["p"]) for r in m.collect()}
    assert got["sun", "rain"] == (2, 3 / 5) and got["rain", "rain"] == (0, 1 / 3) and sequence.row_stochastic(m).isEmpty()
    with pytest.raises(PySparkException):
        sequence.markov_score(spark.createDataFrame([(0, "sun", "snow")], "s int, from_state string, to_state string"), m, "s").collect()


def test_clustering_reads_whole_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)  # four groups that the first four components can't tell
    rows = [(i, [0.0] * 4 + (10.0 * np.eye(60)[i % 4] + rng.normal(0, 0.1, 60)).tolist()) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    clusters, components = cluster.q_kmeans(spark, str(tmp_path)).collect(), cluster.q_gmm(spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in clusters) == sum(r["n"] for r in components) == 80
    assert sum(r["inertia"] for r in clusters) > 1  # the prefix alone gives 0
    assert cluster._points(spark, str(tmp_path)).first()["v"][4] != 0
