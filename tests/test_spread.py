"""Small tables with much work a row are dealt over all cores: a file of a few MB is one task otherwise."""

import pytest
from orrery.plans import registry


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("few"))
    part = spark.range(40).selectExpr("id + 1 AS p_partkey", "concat('Brand#', id % 5) AS p_brand", "CAST(id % 50 + 1 AS int) AS p_size", "900.0D + id AS p_retailprice", "'a part' AS p_name")
    part.coalesce(1).write.parquet(f"{at}/part.parquet")
    orders = spark.range(40).selectExpr("id AS o_orderkey", "id * 7 AS o_custkey", "'5-LOW' AS o_orderpriority")
    orders.coalesce(1).write.parquet(f"{at}/orders.parquet")
    return at


@pytest.mark.parametrize("name", ["numeric_quadrature", "ode_fixed_step", "scalar_fraction_edges", "tensor_rational", "scalar_big", "scalar_rationals", "scalar_continued_fractions"])
def test_tasks_of_a_small_file(spark, few, name):
    assert registry.queries()[name](spark, few).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_totals_send_no_table_to_the_driver(spark, few):
    plan = registry.queries()["scalar_big_totals"](spark, few)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
