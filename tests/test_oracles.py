"""Every registered query against its SQL counterpart in DuckDB over the same parquet files."""

import math

import duckdb
import pytest

import __spark_entry__ as registry

TABLES = ("region", "nation", "customer", "part", "events")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


# The training-data operators have tests of their own.
NAMES = [name for name in registry.queries() if name not in registry.LLM_QUERIES]


def test_every_query_has_an_oracle():
    assert set(NAMES) == set(registry.oracle_sql()) - set(registry.LLM_ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, sf_dir, name):
    result = registry.queries()[name](spark, sf_dir)
    got = as_rows(result.columns, [tuple(r) for r in result.collect()])
    cursor = duck.execute(registry.oracle_sql()[name])
    want = as_rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    assert got[1], "an empty result proves nothing"


def test_entry(spark):
    assert registry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["category_counts", "category_session_clicks"])
def test_category_queries_scan_the_actions_twice(spark, sf_dir, name):
    """Once for the sessions, once for the visits; no further pass looks for hot keys."""
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation [" in line and "event_type" in line]
    assert len(scans) == 2
