"""Every query with SQL against DuckDB on the driver's tables, if they are there."""

import os
from pathlib import Path

import duckdb
import pytest
from orrery.plans import registry

SF = os.environ.get("ORRERY_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x != x:
        return "null"
    if isinstance(x, float):
        return f"{x:.6g}" if abs(x) > 1e-9 else "0"
    return "[" + ",".join(map(plain, x)) + "]" if isinstance(x, (list, tuple)) else str(x)


def rows_of(frame, columns):
    return sorted("|".join(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
