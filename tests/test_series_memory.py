"""Work of series that once grew in a task: correlation's windows a norm, series as Python objects."""

from orrery.operators.series import interpolate_smooth, q_correlate
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_norms_share_one_pass(spark, tmp_path):
    events = spark.range(60).selectExpr("id AS event_id", "timestamp_micros(id * 1000000) AS ts", "id % 4 AS user_id", "id * 0.5D AS value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = q_correlate(spark, str(tmp_path))
    assert "Window" not in plan(got) and got.count() == 4 * 5 * 4


def test_series_stay_in_arrays(spark):
    rows = [(k, float(t), None if (k, t) == (2, 3) else t * t * 1.0) for k in (1, 2) for t in range(6)] + [(3, 2.0, 7.0)]
    df = spark.createDataFrame(rows, "k long, t double, x double").where("x IS NOT NULL")
    made = interpolate_smooth(df, ["k"], "t", "x", 0.5)
    assert "MapInArrow" in plan(made)
    found = {(r["k"], r["t"]): r["y"] for r in made.collect()}
    assert len(found) == 11 + 11 + 1 and found[3, 2.0] == 7.0 and all(found[k, t] == x for k, t, x in df.collect())
    assert made.where(F.col("k") == 9).count() == 0
