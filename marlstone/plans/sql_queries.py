"""Queries that run as text of the dialect, each with the same result in DuckDB SQL.

Those of ``SELECTS`` read the given tables.  Those of ``SCRIPTS`` create, fill,
change and read tables of a database of their own in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import scratch
from ..sources.tables import register
from .engine import Engine

TABLES = "region nation customer supplier part orders lineitem".split()

#: Name: (text of the dialect, DuckDB SQL; None if the same text means the same there).
SELECTS: dict[str, tuple[str, str | None]] = {
    "sql_expressions": (
        """SELECT p_partkey AS k, + p_size - - 2 AS signs, p_size / 7 AS cut, CAST(p_retailprice AS INTEGER) AS rounded, p_size NOT BETWEEN 10 AND 40 AS outside, NOT p_size AS zero,
           NULLIF(p_size, 3) IS 5 AS five, 1 < p_size < 2 AS chained, p_size IN () AS never, ABS(20 - p_size) AS distance FROM part""",
        """SELECT p_partkey AS k, CAST(p_size + 2 AS BIGINT) AS signs, CAST(p_size // 7 AS BIGINT) AS cut, CAST(ROUND(p_retailprice) AS INTEGER) AS rounded, p_size NOT BETWEEN 10 AND 40 AS outside,
           p_size = 0 AS zero, NULLIF(p_size, 3) IS NOT DISTINCT FROM 5 AS five, CAST(1 < p_size AS INTEGER) < 2 AS chained, FALSE AS never, CAST(ABS(20 - p_size) AS BIGINT) AS distance FROM part""",
    ),
    "sql_overflow": (
        "SELECT p_partkey AS k, 2147483647 + p_size AS more, -2147483647 - p_size AS less, 2147483647 * p_size AS times FROM part",
        "SELECT p_partkey AS k, CAST(2147483647 AS BIGINT) + p_size AS more, CAST(-2147483647 AS BIGINT) - p_size AS less, CAST(2147483647 AS BIGINT) * p_size AS times FROM part",
    ),
    "sql_comma_join": ("SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND c_acctbal > 5000.0", None),
    "sql_outer_joins": (
        "SELECT x.n_nationkey AS a, y.r_regionkey AS b, z.s_suppkey AS c FROM nation x FULL OUTER JOIN region y ON x.n_nationkey = y.r_regionkey AND y.r_regionkey > 2 LEFT JOIN supplier AS z ON x.n_nationkey = z.s_nationkey",
        None,
    ),
    "sql_groups": (
        """SELECT o_orderpriority AS p, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers, MIN(o_orderkey) AS low, SUM(o_custkey) / COUNT(*) AS ratio
           FROM orders ORDER BY 1 GROUP BY o_orderpriority HAVING COUNT(*) > 10""",
        """SELECT o_orderpriority AS p, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers, MIN(o_orderkey) AS low, CAST(SUM(o_custkey) // COUNT(*) AS BIGINT) AS ratio
           FROM orders GROUP BY o_orderpriority HAVING COUNT(*) > 10 ORDER BY 1""",
    ),
    "sql_loose_column": ("SELECT n_nationkey AS k, n_name, COUNT(*) AS n FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey", "SELECT n_nationkey AS k, ANY_VALUE(n_name) AS n_name, COUNT(*) AS n FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey"),
    "sql_case": ("SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'it''s other' END AS word, CASE WHEN o_totalprice > 100000.0 THEN 1 END AS large, COALESCE(NULLIF(o_orderstatus, 'P'), '?') AS s FROM orders", None),
    "sql_set_operations": ("SELECT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey FROM nation EXCEPT SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation WHERE n_regionkey > 1", None),
    "sql_bag_operations": ("(SELECT p_size AS k FROM part EXCEPT ALL SELECT n_nationkey FROM nation) INTERSECT ALL SELECT l_linenumber FROM lineitem", None),
    "sql_distinct_order": ("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer ORDER BY 2, 1", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer ORDER BY 2 NULLS FIRST, 1 NULLS FIRST"),
    "sql_in_subquery": ("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND s_nationkey NOT IN (SELECT NULLIF(r_regionkey, 4) + 9 FROM region WHERE r_regionkey < 4)", None),
    "sql_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000.0) AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = c.c_custkey AND p.o_orderstatus = 'P')", None),
    "sql_scalar_subqueries": (
        "SELECT r_name, (SELECT COUNT(*) FROM nation WHERE n_regionkey = r_regionkey) AS n, (SELECT MAX(s_suppkey) FROM supplier) AS top FROM region WHERE r_regionkey < (SELECT AVG(n_regionkey) + 1 FROM nation)",
        None,
    ),
    "sql_aggregate_of_subquery": ("SELECT SUM(n_regionkey + (SELECT MAX(r_regionkey) FROM region)) AS s FROM nation", "SELECT CAST(SUM(n_regionkey + (SELECT MAX(r_regionkey) FROM region)) AS BIGINT) AS s FROM nation"),
    "sql_grandparent": (
        """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
           AND EXISTS (SELECT 1 FROM lineitem l, supplier s WHERE l.l_suppkey = s.s_suppkey AND l.l_orderkey = o.o_orderkey AND s.s_nationkey = c.c_nationkey))""",
        None,
    ),
    "sql_no_from": ("SELECT 1 + 2 * 3 AS a, COUNT(*) AS n, -7 / 2 AS cut", "SELECT CAST(7 AS BIGINT) AS a, CAST(1 AS BIGINT) AS n, CAST(-3 AS BIGINT) AS cut"),
}

#: Name: (statements, of which the last gives the rows; DuckDB SQL).
SCRIPTS: dict[str, tuple[list[str], str]] = {
    "sql_create_insert": (
        [
            "CREATE TABLE account (id BIGINT PRIMARY KEY, name VARCHAR(40) NOT NULL, balance REAL, home INTEGER)",
            "INSERT INTO account SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer",
            "INSERT INTO account (name, id) VALUES ('it''s new', -1), ('another', -2)",
            "SELECT * FROM account",
        ],
        "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_nationkey AS home FROM customer UNION ALL SELECT -1, 'it''s new', NULL, NULL UNION ALL SELECT -2, 'another', NULL, NULL",
    ),
    "sql_update_delete": (
        [
            "CREATE TABLE account (id BIGINT PRIMARY KEY, name VARCHAR, balance REAL, home INTEGER)",
            "INSERT INTO account SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer",
            "UPDATE account SET balance = 0.0 WHERE balance < 0.0",
            "UPDATE account SET name = n_name FROM nation WHERE home = n_nationkey AND n_regionkey = 1",
            "DELETE FROM account USING orders WHERE id = o_custkey AND o_totalprice > 400000.0",
            "DELETE FROM account WHERE home = 3",
            "SELECT id, name, balance FROM account",
        ],
        """SELECT c_custkey AS id, CASE WHEN n_regionkey = 1 THEN n_name ELSE c_name END AS name, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey
           WHERE c_nationkey <> 3 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000.0)""",
    ),
    "sql_index_seek": (
        [
            "CREATE TABLE sale (k BIGINT, p DOUBLE, c BIGINT)",
            "INSERT INTO sale SELECT o_orderkey, o_totalprice, o_custkey FROM orders",
            "CREATE INDEX by_price ON sale (p DESC, k)",
            "SELECT k, p FROM sale WHERE p > 300000.0",
        ],
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 300000",
    ),
    "sql_system_tables": (
        [
            "CREATE TABLE a (x INTEGER PRIMARY KEY, y INTEGER UNIQUE)",
            "CREATE TABLE b (z TEXT)",
            "CREATE UNIQUE INDEX ab ON a (y DESC, x ASC)",
            "CREATE INDEX bz ON b (z)",
            """SELECT t.table_name AS t, i.index_name AS i, i.is_unique AS u, k.field_number_in_table AS f, k.field_number_in_index AS n, k.is_desc_order AS d
               FROM meta_tables t JOIN meta_indexes i ON t.table_name = i.table_name JOIN meta_index_keys k ON i.index_name = k.index_name""",
        ],
        "SELECT * FROM (VALUES ('a', 'a_pkey', TRUE, 0, 0, FALSE), ('a', 'ab', TRUE, 1, 0, TRUE), ('a', 'ab', TRUE, 0, 1, FALSE), ('b', 'bz', FALSE, 0, 0, FALSE)) v(t, i, u, f, n, d)",
    ),
    "sql_drop": (
        ["CREATE TABLE a (x INTEGER)", "CREATE TABLE b (y INTEGER)", "CREATE INDEX ai ON a (x)", "CREATE INDEX bi ON b (y)", "CREATE INDEX bj ON b (y)", "DROP INDEX bi", "DROP TABLE a", "SELECT table_name AS name, 'table' AS kind FROM meta_tables UNION ALL SELECT index_name, 'index' FROM meta_indexes"],
        "SELECT * FROM (VALUES ('b', 'table'), ('bj', 'index')) v(name, kind)",
    ),
}


def _select(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        register(spark, folder, TABLES)
        return Engine(spark).sql(text)

    return run


def _script(statements: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        register(spark, folder, TABLES)
        engine = Engine(spark, scratch(spark, "database"))
        for text in statements[:-1]:
            engine.sql(text)
        return engine.sql(statements[-1])

    return run


QUERIES = {name: _select(text) for name, (text, _) in SELECTS.items()} | {name: _script(statements) for name, (statements, _) in SCRIPTS.items()}
ORACLE_SQL = {name: sql or text for name, (text, sql) in SELECTS.items()} | {name: sql for name, (_, sql) in SCRIPTS.items()}
