"""The SQL front end against DuckDB: the same text on the same tables."""

import math

import duckdb
import pytest

from marlstone.plans.engine import Engine
from marlstone.sources.tables import register

TABLES = "region nation customer supplier part orders lineitem".split()
QUERIES = [
    "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey",
    "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'",
    "SELECT c_mktsegment, COUNT(*), MIN(c_custkey), MAX(c_custkey) FROM customer GROUP BY c_mktsegment",
    "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) FROM orders GROUP BY o_orderpriority HAVING COUNT(*) > 10",
    "SELECT p_size, CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 20 THEN 'b' ELSE 'c' END FROM part WHERE p_size BETWEEN 5 AND 30",
    "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (1, 2, NULL)",
    "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000.0)",
    "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) OR c_custkey < 5",
    "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "SELECT n_regionkey FROM nation UNION SELECT s_nationkey FROM supplier EXCEPT SELECT 3",
    "SELECT n_regionkey FROM nation UNION ALL SELECT r_regionkey FROM region INTERSECT SELECT 2",
    "SELECT n_regionkey FROM nation EXCEPT ALL SELECT r_regionkey FROM region",
    "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE NOT (c_acctbal < 0.0 OR c_nationkey > 20)",
    "SELECT COALESCE(NULLIF(n_regionkey, 1), -1), ABS(-n_nationkey), - n_nationkey * 2 + 3 FROM nation",
    "SELECT x.n_nationkey, y.n_nationkey FROM nation x LEFT JOIN nation y ON x.n_nationkey + 20 = y.n_nationkey",
    "SELECT x.n_nationkey, y.r_regionkey FROM nation x FULL OUTER JOIN region y ON x.n_nationkey = y.r_regionkey AND y.r_regionkey > 2",
    "SELECT r_name, (SELECT COUNT(*) FROM nation WHERE n_regionkey = r_regionkey) FROM region",
    "SELECT n_regionkey IS NULL, NULLIF(n_regionkey, 0) IS NOT NULL, NULLIF(n_regionkey, 0) > 1 AND n_nationkey > 3 FROM nation",
    "SELECT COUNT(*), SUM(n_nationkey), MIN(n_name) FROM nation WHERE n_nationkey < 0",
    "SELECT CASE NULLIF(n_regionkey, 2) WHEN 1 THEN 'one' WHEN 3 THEN 'three' END FROM nation",
    "SELECT SUM(l_linenumber) + COUNT(*) * 2, COUNT(DISTINCT l_suppkey) FROM lineitem WHERE l_quantity >= 10.0",
]


@pytest.fixture(scope="module")
def both(spark, sf):
    register(spark, sf, TABLES)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return Engine(spark), con


def rows(found):
    clean = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(map(clean, r)) for r in found), key=repr)


@pytest.mark.parametrize("sql", QUERIES)
def test_same_rows(both, sql):
    engine, con = both
    assert rows(engine.sql(sql).collect()) == rows(con.execute(sql).fetchall())
