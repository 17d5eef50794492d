"""Every query of the catalogue that has SQL gives the same rows as DuckDB."""

import os

import duckdb
import pytest

from tidemill.plans import catalogue, trip_queries  # noqa: F401  the latter registers its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def in_order(rows, columns):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(r[i] for i in by)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert in_order(found.collect(), found.columns) == in_order(cursor.fetchall(), columns)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["scan_project_cast"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema")[1]


def test_skipping_opens_fewer_files(spark):
    row = catalogue.QUERIES["files_skipped"](spark, SF).first()
    assert row["fewer"] and row["as_selected"]
