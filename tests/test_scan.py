"""One long sequence by scans against the whole sequence in one task."""

import numpy as np
import pytest
from orrery.operators.scan import decode_long, scanned
from orrery.operators.sequence import EXAMPLE, Hmm
from orrery.sources.scratch import staged
from orrery.sources.tables import indexed
from pyspark.sql import functions as F

WEATHER = Hmm(np.array([0.5, 0.3, 0.2]), np.array([[0.7, 0.2, 0.1], [0.0, 0.6, 0.4], [0.3, 0.3, 0.4]]), np.array([[0.6, 0.3, 0.1], [0.2, 0.5, 0.3], [0.1, 0.1, 0.8]]))
TIED = Hmm(np.array([0.5, 0.5]), np.array([[0.5, 0.5], [0.5, 0.5]]), np.array([[0.5, 0.5], [0.5, 0.5]]))
NORMAL = Hmm(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), None, np.array([0.0, 3.0]), np.array([1.0, 2.0]))


@pytest.mark.parametrize("model, n, block, fan", [(EXAMPLE, 150, 7, 3), (WEATHER, 97, 1, 4), (WEATHER, 60, 100, 4), (TIED, 40, 6, 2), (NORMAL, 80, 9, 3)])
def test_equals_the_whole_sequence(spark, model, n, block, fan):
    rng = np.random.default_rng(n)
    x = rng.integers(0, len(model.start), n).astype(float) if model.emit is not None else rng.normal(1, 2, n)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "t long, x double").repartition(5)
    got = sorted(decode_long(df, model, block, fan).collect())
    log_likelihood, marginal, _ = model.forward_backward(x)
    assert [r["t"] for r in got] == list(range(n))
    assert [r["path"] for r in got] == model.viterbi(x).tolist()
    np.testing.assert_allclose([r["confidence"] for r in got], marginal.max(1), atol=1e-9)
    assert all(marginal[r["t"], r["state"]] >= marginal[r["t"]].max() - 1e-9 for r in got)
    assert abs(got[0]["log_likelihood"] - log_likelihood) < 1e-8 * n


def test_nothing_and_missing(spark):
    df = spark.createDataFrame([(0, 0.0), (1, None)], "t long, x double")
    assert decode_long(df.where("false"), EXAMPLE).count() == 0
    with pytest.raises(Exception, match="missing observations"):
        decode_long(df, EXAMPLE).collect()


@pytest.mark.parametrize("backward", [False, True])
def test_scan_of_sums(spark, backward):
    n = 50
    parts = staged(spark.range(n).select(F.col("id").alias("at"), F.array(F.col("id").cast("double")).alias("item")), "parts")
    got = {r["at"]: r["before"] for r in scanned(parts, lambda a, b: a + b, backward, 3).collect()}
    want = {i: sum(range(i + 1, n)) if backward else sum(range(i)) for i in range(n)}
    assert {k: v[0] if v else 0 for k, v in got.items()} == want and got[n - 1 if backward else 0] is None


def test_places_of_all_rows(spark):
    values = [(int(v), i) for i, v in enumerate(np.random.default_rng(1).permutation(500))]
    df = spark.createDataFrame(values, "v int, idx int").repartition(6)
    assert sorted((r["v"], r["place"]) for r in indexed(df, ["v"], "place").collect()) == [(i, i) for i in range(500)]
    assert indexed(df.where("false"), ["v"]).count() == 0
