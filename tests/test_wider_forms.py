"""Holdouts, stable text, Gaussian emissions, overlap-save, streams in parts, states of cells, tensors of structs, packed bits."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from orrery.functions import arrays as A
from orrery.functions import scalar as S
from orrery.operators import numeric, sequence, series
from orrery.streaming import windows
from pyspark.sql import functions as F

DAYS = [(0, "rain"), (0, "rain"), (0, "sun"), (1, "sun"), (1, "rain"), (2, "sun"), (3, "rain"), (3, "sun")]


def weather(spark, rows):
    return spark.createDataFrame([(s, i, w) for i, (s, w) in enumerate(rows)], "s int, t int, w string")


def test_last_sequences_are_held_out(spark):
    matrix, scores = sequence.fit_markov(weather(spark, DAYS), "s", ["t"], "w", held_out=1)
    p = {(r["from_state"], r["to_state"]): r["p"] for r in matrix.collect()}
    assert p == pytest.approx({("rain", "rain"): 0.5, ("rain", "sun"): 0.5, ("sun", "rain"): 2 / 3, ("sun", "sun"): 1 / 3})
    got = {r["s"]: (r["held_out"], r["log_likelihood"]) for r in scores.collect()}
    assert got.keys() == {0, 1, 3} and got[3] == (True, pytest.approx(math.log(0.5))) and not got[0][0]
    with pytest.raises(ValueError, match="none to learn"):
        sequence.fit_markov(weather(spark, DAYS), "s", ["t"], "w", held_out=4)
    _, new = sequence.fit_markov(weather(spark, [*DAYS, (4, "snow"), (4, "rain")]), "s", ["t"], "w", held_out=1)
    with pytest.raises(Exception, match="outside the vocabulary"):
        new.collect()


def test_states_of_single_rows_belong_to_the_vocabulary(spark):
    matrix, _ = sequence.fit_markov(weather(spark, [(0, "a"), (0, "b"), (1, "c")]), "s", ["t"], "w")
    assert {r["from_state"] for r in matrix.collect()} == {"a", "b", "c"}


def test_equal_models_have_equal_text(spark):
    corpus = {"id": "c", "source": "made up", "license": "CC0", "hash": f"fnv1a64:{sequence.fnv1a64(b'x'):016x}"}
    texts = {sequence.stable_text(sequence.fit_markov(weather(spark, rows), "s", ["t"], "w")[0], "CHAIN-1", 1.0, 0, corpus) for rows in (DAYS, [*DAYS[3:5], *DAYS[:3], *DAYS[5:]])}
    (text,) = texts
    assert text.splitlines() == [
        "CHAIN-1", "additive-smoothing-bits=3ff0000000000000", "held-out-sequences=0", "corpus-id=63", f"corpus-source={b'made up'.hex()}", f"corpus-license={b'CC0'.hex()}",
        f"corpus-hash={corpus['hash'].encode().hex()}", "states=2", f"state=0:{b'rain'.hex()}", f"state=1:{b'sun'.hex()}", "transition=0:0:1", "transition=0:1:2", "transition=1:0:1",
    ]


def test_values_at_places_of_the_sorted_rows(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(int(i), float(i * i)) for i in rng.permutation(500)], "k int, v double").repartition(7)
    places = [0, 499, 250, 250, 17]
    assert sequence.values_at(rows, ["k"], "v", places) == [float(i * i) for i in places]


def test_gaussian_emissions_are_found(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(12):
        state = 0
        for t in range(120):
            state = state if rng.random() < 0.9 else 1 - state
            rows.append((s, t, float(rng.normal((1000.0, 1010.0)[state], (1.0, 2.0)[state]))))
    df = spark.createDataFrame(rows, "s int, t int, x double")
    # a start whose means were drawn from different states; from two values of one state more rounds are needed
    model, found = sequence.fit_gaussian(df, "s", 2, seed=11, rounds=12)
    order = model.mean.argsort()
    assert all(b >= a - 1e-6 for a, b in zip(found, found[1:], strict=False))
    assert np.allclose(model.mean[order], [1000, 1010], atol=0.3) and np.allclose(np.sqrt(model.variance[order]), [1, 2], atol=0.3)
    assert np.allclose(model.move.sum(1), 1) and (np.diag(model.move) > 0.8).all()
    once, _ = sequence.fit_gaussian(df, "s", 2, rounds=1)  # one step against its definition
    first = sequence.first_gaussian_model(df, "s", 2, 23, 1e-6)
    values = {s: np.array([x for k, _, x in rows if k == s]) for s in range(12)}
    weights = {s: first.forward_backward(x)[1] for s, x in values.items()}
    total = sum(w.sum(0) for w in weights.values())
    mean = sum(values[s] @ w for s, w in weights.items()) / total
    assert np.allclose(once.mean, mean)
    assert np.allclose(once.variance, sum(((values[s][:, None] - mean) ** 2 * w).sum(0) for s, w in weights.items()) / total)
    with pytest.raises(ValueError, match="missing"):
        sequence.fit_gaussian(df.withColumn("x", F.lit(None).cast("double")), "s", 2)


def test_both_forms_of_blocked_convolution_follow_the_direct_one(spark):
    kernel = [0.2, -0.4, 0.7, 0.1]
    rows = [(u, i, math.sin(i * 0.19 + u)) for u, n in enumerate((1, 2, 5, 10, 13)) for i in range(n)]
    df = spark.createDataFrame(rows, "u int, idx long, x double")
    want = {(u, i): y for u, n in enumerate((1, 2, 5, 10, 13)) for i, y in enumerate(np.convolve([math.sin(j * 0.19 + u) for j in range(n)], kernel))}
    for block in (3, 5, 64):
        for form in (series.convolve_overlap_save, series.convolve_blocks):
            got = {(r["u"], r["idx"]): r["y"] for r in form(df, ["u"], kernel, block).collect()}
            assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert [r["y"] for r in series.convolve_overlap_save(df.where("u = 1"), ["u"], [2.0], 1).orderBy("idx").collect()] == pytest.approx([2 * math.sin(1), 2 * math.sin(1.19)])
    with pytest.raises(ValueError, match="past"):
        series.convolve_overlap_save(df, ["u"], kernel, 2)


def test_a_streamed_convolution_carries_its_tail(spark):
    kernel, n = [1.0, 0.5, -2.0, 0.25], 23
    df = spark.createDataFrame([("a", i, float(i * i % 7)) for i in range(n)] + [("b", 1, 3.0), ("b", 20, 4.0)], "k string, t int, x double")
    cuts = [(0, 2), (2, 3), (3, 11), (11, 99)]  # parts shorter than the kernel too
    parts = [df.where((F.col("t") >= a) & (F.col("t") < b)) for a, b in cuts]
    rows = windows.resumed(parts, lambda s: windows.convolution(s, "k", "t", "x", kernel), "tail").orderBy("k", "idx").collect()
    assert [r["y"] for r in rows if r["k"] == "a"] == pytest.approx(np.convolve([float(i * i % 7) for i in range(n)], kernel)[:n].tolist())
    assert [(r["idx"], r["y"]) for r in rows if r["k"] == "b"] == [(0, 3.0), (1, 5.5)]


@pytest.mark.parametrize("method", list(numeric.STEPPERS))
def test_states_of_cells_step_as_numbers_do(spark, method):
    row = spark.range(1).select(
        numeric.solve_cells(lambda x, y: -y / 2 + numeric.Cells.of(x, F.lit(0.0)), F.lit(0.0), F.array(F.lit(1.0), F.lit(3.0)), F.lit(1.03), 0.1, method).alias("cells"),
        *(F.element_at(numeric.solve(f, F.lit(0.0), F.lit(y), F.lit(1.03), 0.1, method), -1)["y"].alias(n) for n, f, y in (("a", lambda x, y: -y / 2 + x, 1.0), ("b", lambda x, y: -y / 2, 3.0))),
    ).first()
    assert row["cells"] == pytest.approx([row["a"], row["b"]])


def test_rational_matrices_are_exact(spark):
    cells = [(1, 2), (-1, 3), (5, 7), (0, 1), (2, 9), (-4, 5)]
    made = A.tensor_of(F.array(F.lit(2), F.lit(3)), F.array(*[S.rational(F.lit(a), F.lit(b)) for a, b in cells]))
    other = A.tensor_of(F.array(F.lit(3), F.lit(1)), F.array(*[S.rational(F.lit(a), F.lit(b)) for a, b in cells[:3]]))
    zero = S.rational(F.lit(0), F.lit(1))
    product = A.matmul_of(F.col("m"), F.col("o"), zero, S.rational_add, S.rational_mul)
    got = spark.range(1).select(made.alias("m"), other.alias("o")).select(F.transform(product["data"], S.rational_text).alias("d"), product["shape"].alias("s")).first()
    x = [Fraction(*c) for c in cells]
    assert got["s"] == [2, 1] and got["d"] == [str(sum((x[3 * i + j] * x[j] for j in range(3)), Fraction(0))) for i in range(2)]
    with pytest.raises(Exception, match="match"):
        spark.range(1).select(made.alias("m")).select(A.matmul_of(F.col("m"), F.col("m"), zero, S.rational_add, S.rational_mul)).collect()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 130])
def test_packed_bits_come_back(spark, n):
    rng = np.random.default_rng(n)
    a, b = (rng.random((2, n)) < 0.5).tolist()
    df = spark.createDataFrame([(a, b)], "a array<boolean>, b array<boolean>")
    pack = lambda c: A.bits(F.array(F.lit(n)), F.col(c))
    t = df.select(pack("a").alias("a"), pack("b").alias("b"))
    x, y = F.col("a"), F.col("b")
    row = t.select(F.size("a.words").alias("w"), A.flags_of(x).alias("a"), A.flags_of(A.bits_or(x, y)).alias("o"), A.flags_of(A.bits_xor(x, y)).alias("x"), A.flags_of(A.bits_and(x, y)).alias("n")).first()
    pairs = list(zip(a, b, strict=True))
    assert row["w"] == (n + 63) // 64 and row["a"] == a
    assert (row["o"], row["x"], row["n"]) == ([p or q for p, q in pairs], [p != q for p, q in pairs], [p and q for p, q in pairs])


def test_bits_of_other_shapes_raise(spark):
    three = F.array(F.lit(True), F.lit(False), F.lit(True))
    with pytest.raises(Exception, match="differ"):
        spark.range(1).select(A.bits(F.array(F.lit(4)), three)).collect()
    with pytest.raises(Exception, match="match"):
        spark.range(1).select(A.bits_or(A.bits(F.array(F.lit(3)), three), A.bits(F.array(F.lit(3), F.lit(1)), three))).collect()


def test_complex_text(spark):
    texts = ["1.5-2i", "3+i", "4", "-1e3-i", " 0.25+7.5e-1i ", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.complex_parse(F.col("t"))).collect()]
    assert [g and complex(g["re"], g["im"]) for g in got] == [1.5 - 2j, 3 + 1j, 4 + 0j, -1000 - 1j, 0.25 + 0.75j, None]
    assert spark.range(1).select(S.complex_text(S.complex_parse(F.lit("1.5-2i")))).first()[0] == "1.5-2.0i"
    for bad in ("", "i+i", "1+2", "x"):
        with pytest.raises(Exception, match="complex"):
            spark.range(1).select(S.complex_parse(F.lit(bad))).collect()


def test_constants_as_continued_fractions(spark):
    values = {"sqrt2": math.sqrt(2), "phi": (1 + math.sqrt(5)) / 2, "e": math.e}
    row = spark.range(1).select(*(S.fraction_value(S.fraction_constant(n, F.lit(40))).alias(n) for n in values), S.fraction_constant("pi", F.lit(7)).alias("pi"), S.fraction_constant("e", F.lit(1)).alias("one")).first()
    assert {n: row[n] for n in values} == pytest.approx(values, abs=1e-12)
    assert row["pi"] == [3, 7, 15, 1, 292, 1, 1] and row["one"] == [2]
    with pytest.raises(Exception, match="first term"):
        spark.range(1).select(S.fraction_constant("phi", F.lit(0))).collect()


def test_keyed_streams_call_python_by_buckets_of_keys(spark, monkeypatch):
    """What a call costs doesn't grow with the keys: two buckets and that of null keys, whatever keys there are; each key keeps its own state."""
    monkeypatch.setattr(windows, "BUCKETS", 2)
    big = 2**60
    rows = [(None if u == 6 else big + u, i, ("x", None, "y")[(i + u) % 3], float(i * i % 5 - u)) for u in range(7) for i in range(u + 5)]
    df = spark.createDataFrame(rows, "k long, t int, s string, x double")
    parts = [df.where((F.col("t") >= a) & (F.col("t") < b)) for a, b in ((0, 3), (3, 4), (4, 99))]
    assert {r["_bucket"] for r in windows.dealt(df, "k").count().collect()} == {-1, 0, 1}
    series_of = {k: [(s, x) for kk, _, s, x in rows if kk == k] for k in {r[0] for r in rows}}

    pairs = windows.resumed(parts, lambda s: windows.transition_counts(s, "k", "t", "s"), "pairs").collect()
    assert Counter((r["k"], r["from_state"], r["to_state"]) for r in pairs) == Counter((k, a[0], b[0]) for k, xs in series_of.items() for a, b in zip(xs, xs[1:], strict=False))
    got, want = {(r["k"], r["t"]): r["e"] for r in windows.resumed(parts, lambda s: windows.envelope(s, "k", "t", "x", 0.5, 0.1), "envelope").collect()}, {}
    for k, xs in series_of.items():
        e = 0.0
        for t, (_, x) in enumerate(xs):
            e += (0.5 if abs(x) > e else 0.1) * (abs(x) - e)
            want[k, t] = e
    assert got == want
    kernel = [1.0, 0.5, -2.0, 0.25]
    got = {(r["k"], r["idx"]): r["y"] for r in windows.resumed(parts, lambda s: windows.convolution(s, "k", "t", "x", kernel), "convolved").collect()}
    want = {(k, i): y for k, xs in series_of.items() for i, y in enumerate(np.convolve([x for _, x in xs], kernel)[: len(xs)])}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
