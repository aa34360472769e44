"""Every relational query against DuckDB on the same tables."""

import math

import duckdb
import pytest

from marlstone.plans import sql_queries
from marlstone.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf, oracle, name):
    got = QUERIES[name](spark, sf)
    cursor = oracle.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(sql_queries.QUERIES))
def test_text_equals_oracle(spark, sf, oracle, name):
    got = sql_queries.QUERIES[name](spark, sf)
    cursor = oracle.execute(sql_queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(names, cursor.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["scan_filter"](spark, sf))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in text
    assert "l_extendedprice" not in text


def test_plans_have_no_python_and_no_product_but_the_one_asked_for(spark, sf):
    for name, query in QUERIES.items():
        text = plan(query(spark, sf))
        assert "Python" not in text and "Pandas" not in text
        if name not in ("cross_product",):
            assert "CartesianProduct" not in text, name
