"""Tiled products and panel elimination against numpy."""

import numpy as np
import pytest
from orrery.operators.tiles import cells_of, eliminate, multiplied, q_products, row_products, tiled, transposed


def cells(spark, m):
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(m) if v]
    return spark.createDataFrame(rows, "i long, j long, v double").repartition(3)


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        if r["i"] < shape[0] and r["j"] < shape[1]:
            out[r["i"], r["j"]] = r["v"]
        else:
            assert r["v"] == 0
    return out


def test_products(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(9, 14)) * (rng.random((9, 14)) < 0.7), rng.normal(size=(14, 5))
    x, y = tiled(cells(spark, a), 4), tiled(cells(spark, b), 4)
    np.testing.assert_allclose(dense(cells_of(multiplied(x, y)), (9, 5)), a @ b, atol=1e-12)
    np.testing.assert_allclose(dense(cells_of(transposed(x)), (14, 9)), a.T)
    assert multiplied(x.where("false"), y).count() == 0


@pytest.mark.parametrize("n, width", [(1, 4), (7, 3), (12, 4), (10, 16)])
def test_elimination(spark, n, width):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(n, n)), rng.normal(size=n)
    if n > 2:
        a[0, 0] = 0.0  # a pivot must be looked for
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, v double")
    found, report = eliminate(cells(spark, a), right, n, width)
    np.testing.assert_allclose([r["x"] for r in sorted(found.collect())], np.linalg.solve(a, b), rtol=1e-9, atol=1e-9)
    r = report.first()
    assert r["residual"] < 1e-9 and r["least_pivot"] > 0 and (r["swaps"] > 0) == (n > 2)


def test_singular(spark):
    right = spark.createDataFrame([(0, 1.0), (1, 1.0)], "i long, v double")
    with pytest.raises(Exception, match="singular"):
        eliminate(cells(spark, np.array([[1.0, 2.0], [2.0, 4.0]])), right, 2, 1)


def test_row_products(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(9, 6)), rng.normal(size=(9, 6))
    got = {r["i"]: r["s"] for r in row_products(tiled(cells(spark, a), 4), tiled(cells(spark, b), 4)).collect()}
    np.testing.assert_allclose([got[i] for i in range(9)], (a * b).sum(1))


def test_products_of_all_vectors_make_no_table_of_pairs(spark, tmp_path):
    """Rows between the products' tiles grow with the vectors, not with their square."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = q_products(spark, str(tmp_path))
    assert "posexplode" not in got._jdf.queryExecution().executedPlan().toString().lower()
    rows, g = {r["vec_id"]: (r["squares"], r["own"]) for r in got.collect()}, x.astype(float) @ x.astype(float).T
    np.testing.assert_allclose([rows[i] for i in range(600)], np.stack([(g**2).sum(1), g.diagonal()], 1), atol=1e-5)
