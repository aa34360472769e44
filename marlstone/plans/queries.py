"""A query per operator: the DataFrame form, and the same in DuckDB SQL.

Money is summed in whole cents, so results don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalar as S
from ..operators import dml, relational as R
from ..sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """``t.orders`` reads the table orders of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)


def query(sql: str) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__.rstrip("_")] = lambda spark, folder: f(Tables(spark, folder))
        ORACLE_SQL[f.__name__.rstrip("_")] = sql
        return f

    return add


def cents(c: Column | str) -> Column:
    """Whole cents, half away from zero; Spark's ROUND of a double goes through big decimals."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.signum(c) * F.floor(F.abs(c) * 100 + 0.5)).cast("bigint")


col, lit = F.col, F.lit


@query("""
SELECT c_mktsegment, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price_cents,
       COUNT(*) AS n_lines, AVG(l_quantity) AS avg_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_quantity > 10 GROUP BY c_mktsegment ORDER BY 1""")
def flagship(t):
    joined = t.lineitem.where("l_quantity > 10").join(t.orders, col("l_orderkey") == col("o_orderkey")).join(t.customer, col("o_custkey") == col("c_custkey"))
    out = R.aggregate(joined, ["c_mktsegment"], price_cents=F.sum(cents("l_extendedprice")), n_lines=F.count(lit(1)), avg_quantity=F.avg("l_quantity"))
    return R.order_by(out, 1)


# Scans and projection.
@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def scan_filter(t):
    return t.lineitem.where(col("l_quantity") > 45).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1200")
def range_seek(t):
    return t.orders.where((col("o_orderkey") >= 100) & (col("o_orderkey") < 1200)).select("o_orderkey", "o_totalprice")


@query("SELECT *, n_nationkey + 1 AS next_key FROM nation")
def select_star(t):
    return t.nation.select("*", (col("n_nationkey") + 1).alias("next_key"))


@query("SELECT 1 AS one, 7 // 2 AS cut, 'text' AS word")
def no_from(t):
    return R.one_row(t.spark).select(lit(1).alias("one"), F.expr("CAST(7 DIV 2 AS INT)").alias("cut"), lit("text").alias("word"))


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, -l_linenumber AS minus, - - l_linenumber AS plus,
       CAST(l_partkey // 7 AS BIGINT) AS cut, l_linenumber * 3 - 2 AS line FROM lineitem""")
def project_arith(t):
    d = t.lineitem
    return d.select("l_orderkey", "l_linenumber", (col("l_extendedprice") * (1 - col("l_discount"))).alias("net"), (-col("l_linenumber")).alias("minus"), (-(-col("l_linenumber"))).alias("plus"), S.divide(d, col("l_partkey"), lit(7)).alias("cut"), (col("l_linenumber") * 3 - 2).alias("line"))


@query("SELECT p_partkey, CAST(2147483647 AS BIGINT) * p_size AS wide FROM part")
def arith_wide(t):
    d = t.part
    return d.select("p_partkey", (S.widen(d, lit(2147483647)) * S.widen(d, col("p_size"))).alias("wide"))


@query("SELECT n_name AS nation_name, r.r_name AS region_name FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey")
def aliases(t):
    return t.nation.alias("n").join(t.region.alias("r"), col("n.n_regionkey") == col("r.r_regionkey")).select(col("n_name").alias("nation_name"), col("r.r_name").alias("region_name"))


# Predicates and scalar expressions.
@query("""
SELECT p_partkey, n IS NULL AS is_null, n IN (2, 3, NULL) AS in_null, n NOT IN (2, 3) AS not_in, n BETWEEN 5 AND 20 AS within,
       NOT (n > 10 OR n IS NULL) AS negated, n > 10 AND n IS NOT NULL AS both, n IS NOT DISTINCT FROM 7 AS same, n BETWEEN NULL AND 3 AS half
FROM (SELECT p_partkey, NULLIF(p_size, 1) AS n FROM part)""")
def predicates_3vl(t):
    n = F.nullif(col("p_size"), lit(1))
    shown = dict(is_null=n.isNull(), in_null=n.isin(2, 3, None), not_in=~S.in_list(n, [2, 3]), within=n.between(5, 20), negated=~((n > 10) | n.isNull()), both=(n > 10) & n.isNotNull(), same=S.same(n, lit(7)), half=n.between(lit(None).cast("int"), lit(3)))
    return t.part.select("p_partkey", *(c.alias(k) for k, c in shown.items()))


@query("SELECT p_partkey FROM part WHERE p_size <> 10 AND p_size != 11 AND p_brand = 'Brand#11' OR p_size <= 2")
def compare(t):
    return t.part.where((col("p_size") != 10) & (col("p_size") != 11) & (col("p_brand") == "Brand#11") | (col("p_size") <= 2)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE CAST(p_size < 20 AS INT) < 1")
def compare_chained(t):
    return t.part.where((col("p_size") < 20).cast("int") < 1).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS bucket FROM part")
def case_searched(t):
    return t.part.select("p_partkey", F.when(col("p_size") < 10, "small").when(col("p_size") < 30, "middle").otherwise("large").alias("bucket"))


@query("SELECT o_orderkey, CASE NULLIF(o_orderstatus, 'P') WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status FROM orders")
def case_simple(t):
    return t.orders.select("o_orderkey", S.case_simple(F.nullif(col("o_orderstatus"), lit("P")), [(lit("F"), lit("final")), (lit("O"), lit("open"))]).alias("status"))


@query("SELECT c_custkey, CAST(ROUND(c_acctbal) AS INTEGER) AS rounded, CAST(c_nationkey AS DOUBLE) AS d, CAST(c_custkey AS VARCHAR) AS s FROM customer")
def cast_round(t):
    return t.customer.select("c_custkey", S.cast(col("c_acctbal"), "int").alias("rounded"), S.cast(col("c_nationkey"), "double").alias("d"), S.cast(col("c_custkey"), "string").alias("s"))


@query("SELECT p_partkey, COALESCE(NULLIF(p_size, 5), -1) AS filled, NULLIF(p_brand, 'Brand#11') AS brand FROM part")
def null_functions(t):
    return t.part.select("p_partkey", F.coalesce(F.nullif(col("p_size"), lit(5)), lit(-1)).alias("filled"), F.nullif(col("p_brand"), lit("Brand#11")).alias("brand"))


@query("SELECT c_custkey, ABS(c_acctbal) AS size FROM customer")
def abs_(t):
    return t.customer.select("c_custkey", F.abs("c_acctbal").alias("size"))


@query("SELECT n_nationkey FROM nation WHERE n_regionkey <> 0")
def truth_of_numbers(t):
    d = t.nation
    return d.where(S.truth(d, col("n_regionkey"))).select("n_nationkey")


# Joins.
BIG = "o_totalprice > 200000"


@query(f"SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE {BIG}")
def hash_join_inner(t):
    return R.join(t.customer, t.orders.where(BIG), col("c_custkey") == col("o_custkey")).select("c_custkey", "o_orderkey")


@query(f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE {BIG}) ON c_custkey = o_custkey")
def hash_join_left(t):
    return R.join(t.customer, t.orders.where(BIG), col("c_custkey") == col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON NULLIF(s_nationkey, 3) = n_nationkey")
def hash_join_right(t):
    return R.join(t.supplier, t.nation, F.nullif(col("s_nationkey"), lit(3)) == col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT s_suppkey, n_name FROM supplier FULL JOIN nation ON NULLIF(s_nationkey, 3) = n_nationkey")
def hash_join_full(t):
    return R.join(t.supplier, t.nation, F.nullif(col("s_nationkey"), lit(3)) == col("n_nationkey"), "full").select("s_suppkey", "n_name")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def theta_join_inner(t):
    return R.join(t.nation, t.region, col("n_regionkey") < col("r_regionkey")).select("n_name", "r_name")


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey < r_regionkey")
def theta_join_left(t):
    return R.join(t.nation, t.region, col("n_regionkey") < col("r_regionkey"), "left").select("n_name", "r_name")


@query("SELECT n_name, r_name FROM nation RIGHT JOIN region ON n_regionkey < r_regionkey")
def theta_join_right(t):
    return R.join(t.nation, t.region, col("n_regionkey") < col("r_regionkey"), "right").select("n_name", "r_name")


@query("SELECT n_name, r_name FROM nation FULL JOIN region ON n_regionkey < r_regionkey")
def theta_join_full(t):
    return R.join(t.nation, t.region, col("n_regionkey") < col("r_regionkey"), "full").select("n_name", "r_name")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_product(t):
    return R.product(t.region, t.nation).select("r_name", "n_name")


@query("SELECT c_name, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND c_acctbal > 5000")
def implicit_join(t):
    return t.customer.where("c_acctbal > 5000").join(t.nation, col("c_nationkey") == col("n_nationkey")).join(t.region, col("n_regionkey") == col("r_regionkey")).select("c_name", "n_name", "r_name")


@query("SELECT a.s_suppkey AS first_key, b.s_suppkey AS second_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_join(t):
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    return R.join(a, b, (col("a.s_nationkey") == col("b.s_nationkey")) & (col("a.s_suppkey") < col("b.s_suppkey"))).select(col("a.s_suppkey").alias("first_key"), col("b.s_suppkey").alias("second_key"))


@query(f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {BIG})")
def semi_join(t):
    return t.customer.join(t.orders.where(BIG), col("o_custkey") == col("c_custkey"), "left_semi").select("c_custkey")


@query(f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {BIG})")
def anti_join(t):
    return t.customer.join(t.orders.where(BIG), col("o_custkey") == col("c_custkey"), "left_anti").select("c_custkey")


# Aggregation.
FIGURES = "COUNT(*) AS n, COUNT(NULLIF(l_linenumber, 1)) AS n_later, CAST(SUM(l_linenumber) AS BIGINT) AS lines, AVG(l_linenumber) AS mean, MIN(l_quantity) + 0.0 AS low, MAX(l_quantity) AS high"


def figures() -> dict[str, Column]:
    return dict(n=F.count(lit(1)), n_later=F.count(F.nullif(col("l_linenumber"), lit(1))), lines=F.sum("l_linenumber"), mean=F.avg("l_linenumber"), low=F.min("l_quantity"), high=F.max("l_quantity"))


@query(f"SELECT {FIGURES} FROM lineitem")
def agg_global(t):
    return R.aggregate(t.lineitem, [], **figures())


@query(f"SELECT {FIGURES} FROM lineitem WHERE l_quantity < 0")
def agg_global_empty(t):
    return R.aggregate(t.lineitem.where("l_quantity < 0"), [], **figures())


@query(f"SELECT l_returnflag, l_linestatus, {FIGURES} FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group(t):
    return R.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], **figures())


@query("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n_suppliers, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS line_sum, AVG(DISTINCT l_linenumber) AS line_mean, COUNT(l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
def agg_distinct(t):
    return R.aggregate(t.lineitem, ["l_returnflag"], n_suppliers=F.count_distinct("l_suppkey"), line_sum=F.sum_distinct("l_linenumber"), line_mean=F.expr("avg(DISTINCT l_linenumber)"), n=F.count("l_suppkey"))


@query("SELECT o_orderpriority, CAST(SUM(o_custkey) + COUNT(*) AS BIGINT) AS mixed, CAST(SUM(o_custkey) // COUNT(*) AS BIGINT) AS ratio FROM orders GROUP BY o_orderpriority")
def agg_expr(t):
    d = R.aggregate(t.orders, ["o_orderpriority"], s=F.sum("o_custkey"), n=F.count(lit(1)))
    return d.select("o_orderpriority", (col("s") + col("n")).alias("mixed"), S.divide(d, col("s"), col("n")).alias("ratio"))


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MIN(o_orderkey) < 5000")
def having(t):
    return R.aggregate(t.orders, ["o_custkey"], n=F.count(lit(1)), least=F.min("o_orderkey")).where("n > 12 AND least < 5000").select("o_custkey", "n")


@query("SELECT c_custkey, ANY_VALUE(c_name) AS c_name, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def group_any_value(t):
    return R.aggregate(R.join(t.customer, t.orders, col("c_custkey") == col("o_custkey")), ["c_custkey"], c_name=F.any_value("c_name"), n=F.count(lit(1)))


@query("SELECT COUNT(*) AS n")
def agg_no_from(t):
    return R.aggregate(R.one_row(t.spark), [], n=F.count(lit(1)))


# Distinct and order.
@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct(t):
    return t.events.select("event_type", "user_id").distinct()


@query("SELECT p_brand, p_size, p_partkey FROM part ORDER BY 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST")
def order_by_ordinal(t):
    return R.order_by(t.part.select("p_brand", "p_size", "p_partkey"), 1, 2, 3)


# Set operations.
A, B = "SELECT p_size AS k FROM part", "SELECT CAST(l_quantity AS INTEGER) AS k FROM lineitem WHERE l_quantity > 20"
C = "SELECT l_linenumber AS k FROM lineitem"


def sides(t):
    return t.part.select(col("p_size").alias("k")), t.lineitem.where("l_quantity > 20").select(col("l_quantity").cast("int").alias("k"))


@query(f"{A} UNION ALL {B}")
def union_all(t):
    a, b = sides(t)
    return a.union(b)


@query(f"{A} UNION {B}")
def union(t):
    a, b = sides(t)
    return a.union(b).distinct()


@query(f"{A} EXCEPT {B}")
def except_(t):
    a, b = sides(t)
    return a.subtract(b)


@query(f"{A} EXCEPT ALL {B}")
def except_all(t):
    a, b = sides(t)
    return a.exceptAll(b)


@query(f"{A} INTERSECT {B}")
def intersect(t):
    a, b = sides(t)
    return a.intersect(b)


@query(f"{A} INTERSECT ALL {B}")
def intersect_all(t):
    a, b = sides(t)
    return a.intersectAll(b)


@query(f"SELECT k FROM ({A}) a WHERE NOT EXISTS (SELECT 1 FROM ({B}) b WHERE a.k IS NOT DISTINCT FROM b.k)")
def except_all_anti(t):
    return R.except_rows(*sides(t))


@query(f"SELECT k FROM ({A}) a WHERE EXISTS (SELECT 1 FROM ({B}) b WHERE a.k IS NOT DISTINCT FROM b.k)")
def intersect_all_semi(t):
    return R.intersect_rows(*sides(t))


@query(f"{A} EXCEPT ({B} INTERSECT {C})")
def setop_precedence(t):
    a, b = sides(t)
    return a.subtract(b.intersect(t.lineitem.select(col("l_linenumber").alias("k"))))


# Sub-queries.
@query("SELECT p_partkey FROM part WHERE p_size IN (1, 7, 49)")
def in_list(t):
    return t.part.where(S.in_list(col("p_size"), [1, 7, 49])).select("p_partkey")


@query("SELECT p_partkey, FALSE AS found, TRUE AS missing FROM part")
def in_empty_list(t):
    return t.part.select("p_partkey", S.in_list(col("p_size"), []).alias("found"), (~S.in_list(col("p_size"), [])).alias("missing"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_subquery(t):
    return t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), col("o_custkey") == col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(s_nationkey, 3) FROM supplier)")
def not_in_subquery_null(t):
    return R.not_in(t.nation, "n_nationkey", t.supplier.select(F.nullif(col("s_nationkey"), lit(3)).alias("k"))).select("n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey <> 3)")
def not_in_subquery(t):
    return R.not_in(t.nation, "n_nationkey", t.supplier.where("s_nationkey <> 3").select("s_nationkey")).select("n_nationkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def exists(t):
    return t.supplier.join(t.lineitem.where("l_quantity > 49"), col("l_suppkey") == col("s_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def not_exists(t):
    return t.orders.join(t.lineitem, col("l_orderkey") == col("o_orderkey"), "left_anti").select("o_orderkey")


@query("""
SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
  AND EXISTS (SELECT 1 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE l.l_orderkey = o.o_orderkey AND s.s_nationkey = c.c_nationkey))""")
def nested_correlated(t):
    # The innermost query names the outermost one: orders take the customer's nation along, so that
    # few lines are left when both keys meet in one semi join.
    buyers = t.customer.select(col("c_custkey").alias("k"), col("c_nationkey").alias("n")).distinct()
    placed = t.orders.join(buyers, col("o_custkey") == col("k")).select("o_orderkey", "k", "n")
    sold = t.lineitem.join(placed, col("l_orderkey") == col("o_orderkey")).join(t.supplier, (col("l_suppkey") == col("s_suppkey")) & (col("s_nationkey") == col("n"))).select("k", "n")
    return t.customer.join(sold, (col("k") == col("c_custkey")) & (col("n") == col("c_nationkey")), "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE CAST(ROUND(o_totalprice * 100) AS BIGINT) > 1.5 * (SELECT AVG(CAST(ROUND(o_totalprice * 100) AS BIGINT)) FROM orders)")
def scalar_subquery(t):
    mean = t.orders.agg(F.avg(cents("o_totalprice")))
    return t.orders.where(cents("o_totalprice") > 1.5 * mean.scalar()).select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_scalar(t):
    top = t.orders.groupBy(col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("top"))
    return t.orders.join(top, (col("o_custkey") == col("k")) & (col("o_totalprice") == col("top"))).select("o_orderkey")


@query("SELECT n_name, (SELECT COUNT(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers, (SELECT MAX(c_custkey) FROM customer) AS last_customer FROM nation")
def subquery_in_select(t):
    n = t.supplier.groupBy(col("s_nationkey").alias("k")).agg(F.count(lit(1)).alias("n"))
    return t.nation.join(n, col("n_nationkey") == col("k"), "left").select("n_name", F.coalesce("n", lit(0)).alias("n_suppliers"), t.customer.agg(F.max("c_custkey")).scalar().alias("last_customer"))


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) * 1.5 / COUNT(DISTINCT o_custkey) FROM orders)")
def subquery_in_having(t):
    per = t.orders.agg(F.count(lit(1)) * lit(1.5) / F.count_distinct("o_custkey"))
    return R.aggregate(t.orders, ["o_custkey"], n=F.count(lit(1))).where(col("n") > per.scalar())


# Changes: the new state of a table.
@query("SELECT * FROM region UNION ALL SELECT 99, 'NOWHERE'")
def insert_values(t):
    return dml.insert(t.region, t.spark.sql("SELECT 99, 'NOWHERE'"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def insert_select(t):
    return dml.insert(t.region, t.nation.select(col("n_nationkey") + 100, "n_name"))


@query("SELECT p_partkey, p_size FROM part WHERE NOT COALESCE(NULLIF(p_size, 3) > 25, FALSE)")
def delete_where(t):
    return dml.delete(t.part.select("p_partkey", "p_size"), F.nullif(col("p_size"), lit(3)) > 25)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def delete_using(t):
    return dml.delete_using(t.orders, t.customer.where("c_acctbal < 0"), col("c_custkey") == col("o_custkey")).select("o_orderkey")


@query("SELECT s_suppkey, s_name, CASE WHEN s_nationkey > 12 THEN s_nationkey - 1 ELSE s_nationkey END AS s_nationkey FROM supplier")
def update_set(t):
    return dml.update(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), {"s_nationkey": col("s_nationkey") - 1}, col("s_nationkey") > 12)


@query("SELECT s_suppkey, CASE WHEN n_regionkey > 1 THEN n_name ELSE s_name END AS s_name, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def update_from(t):
    return dml.update_from(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), t.nation, "s_nationkey", "n_nationkey", {"s_name": col("n_name")}, col("n_regionkey") > 1)
