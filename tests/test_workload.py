"""Every registered query against its SQL twin on the smallest tables."""
import math

import pytest

import __spark_entry__ as driver
from cohort_gaps.workload import oracle, queries as workload

duckdb = pytest.importorskip("duckdb")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield connection
    connection.close()


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b and type(a) is type(b)


def order(row):
    return tuple((v is None, round(v, 3) if isinstance(v, float) else v if v is not None else 0) for v in row)


@pytest.mark.parametrize("key", sorted(workload.queries()))
def test_query_equals_sql(spark, sql, sf_dir, key):
    result = driver.queries()[key](spark, sf_dir)
    rows = sorted((tuple(r) for r in result.collect()), key=order)
    found = sql.execute(driver.oracle_sql()[key])
    names = [c[0] for c in found.description]
    expected = sorted(found.fetchall(), key=order)
    assert result.columns == names
    assert len(rows) == len(expected)
    for mine, theirs in zip(rows, expected):
        assert all(same(a, b) for a, b in zip(mine, theirs)), (mine, theirs)


def test_every_query_has_a_twin():
    assert set(workload.queries()) == set(oracle.oracle_sql())
    assert set(workload.queries()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
