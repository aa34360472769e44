import io

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marlstone import __main__ as cli
from marlstone.operators import dml
from marlstone.plans.dialect import CODES, Parser, SqlError
from marlstone.plans.engine import Engine
from marlstone.plans.logictest import run


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db")


@pytest.fixture
def filled(engine):
    engine.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, a INTEGER, f REAL, s VARCHAR(20))")
    engine.sql("INSERT INTO t VALUES (1, 7, 2.5, 'x'), (2, NULL, -2.5, 'it''s'), (3, 0, 0.4, NULL), (4, 7, 1.0, 'back\\slash')")
    return engine


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


def test_expressions(filled):
    assert rows(filled, "SELECT 7 / 2, -7 / 2, 7 / 2.0, a / 2, f / 2 FROM t WHERE id = 1") == [(3, -3, 3.5, 3, 1.25)]
    assert rows(filled, "SELECT CAST(f AS INTEGER) FROM t ORDER BY 1") == [(-3,), (0,), (1,), (3,)]
    assert rows(filled, "SELECT id FROM t WHERE a ORDER BY 1") == [(1,), (4,)]
    assert rows(filled, "SELECT id FROM t WHERE NOT a ORDER BY 1") == [(3,)]
    assert rows(filled, "SELECT id FROM t WHERE a IS 7 ORDER BY 1") == [(1,), (4,)]
    assert rows(filled, "SELECT id FROM t WHERE a IS NOT 7 ORDER BY 1") == [(2,), (3,)]
    assert rows(filled, "SELECT id FROM t WHERE a IN () OR a NOT IN () ORDER BY 1") == [(1,), (2,), (3,), (4,)]
    assert rows(filled, "SELECT id FROM t WHERE 1 < id < 2 ORDER BY 1") == [(1,), (2,), (3,), (4,)]
    assert rows(filled, "SELECT s FROM t ORDER BY 1") == [(None,), ("back\\slash",), ("it's",), ("x",)]
    assert rows(filled, "SELECT CASE a WHEN 7 THEN 'seven' WHEN NULL THEN 'never' END FROM t WHERE id < 3 ORDER BY 1") == [(None,), ("seven",)]
    assert rows(filled, "SELECT ABS(-2.7), COALESCE(NULL, 3), NULLIF(1, 1), +-+5, 2 + 3 * 4 - 1") == [(2.7, 3, None, -5, 13)]
    assert rows(filled, "SELECT 3 BETWEEN 1 AND 5 AND TRUE, NOT 1 = 2, 5 BETWEEN NULL AND 3") == [(True, True, False)]


def test_queries(filled):
    assert rows(filled, "SELECT a, COUNT(*) FROM t ORDER BY 1 GROUP BY a") == [(None, 1), (0, 1), (7, 2)]
    assert rows(filled, "SELECT a, COUNT(*) AS n FROM t GROUP BY a HAVING COUNT(*) > 1 ORDER BY 1") == [(7, 2)]
    assert rows(filled, "SELECT SUM(id) / COUNT(*), AVG(a), COUNT(DISTINCT a) FROM t") == [(2, 14 / 3, 2)]
    assert rows(filled, "SELECT id, a FROM t GROUP BY id ORDER BY 1") == [(1, 7), (2, None), (3, 0), (4, 7)]
    assert rows(filled, "SELECT x.id, y.id FROM t x LEFT JOIN t AS y ON x.a = y.a AND x.id < y.id ORDER BY 1") == [(1, 4), (2, None), (3, None), (4, None)]
    assert rows(filled, "SELECT id FROM t WHERE id IN (SELECT MAX(id) FROM t) UNION SELECT 9 EXCEPT SELECT 4") == [(9,)]
    assert rows(filled, "SELECT id FROM t x WHERE EXISTS (SELECT 1 FROM t y WHERE y.a = x.a AND y.id > x.id)") == [(1,)]
    assert rows(filled, "SELECT id FROM t x WHERE a = (SELECT MAX(a) FROM t) ORDER BY 1") == [(1,), (4,)]
    assert rows(filled, "SELECT COUNT(*)") == [(1,)]
    assert rows(filled, "SELECT COUNT(*) FROM t x, t y") == [(16,)]
    assert rows(filled, "SELECT COUNT(*) FROM t x CROSS JOIN (t y INNER JOIN t z ON y.id = z.id)") == [(16,)]
    assert len(filled.sql("SELECT *, id + 1 FROM t").columns) == 5


@pytest.mark.parametrize(
    "sql",
    ["", "SELECT", "SELECT 1 1", "SELEC 1", "SELECT a FROM", "SELECT SUM(MAX(a)) FROM t", "SELECT a FROM t HAVING a > 1", "SELECT a FROM t ORDER BY a", "SELECT a FROM t ORDER BY 2", "SELECT nope(1)", "SELECT 'open", "SELECT zz FROM t", "SELECT 1 FROM zz", "SELECT a FROM t WHERE SUM(a) > 1", "CREATE TABLE t (a INTEGER)", "CREATE TABLE u (a NOTYPE)", "CREATE TABLE u (a INTEGER, A INTEGER)", "DROP TABLE zz", "DROP INDEX zz", "DROP INDEX t_pkey", "INSERT INTO t VALUES (1)", "INSERT INTO t (id, id) VALUES (8, 8)", "UPDATE t SET zz = 1", "SELECT (SELECT id FROM t)"],
)
def test_errors(filled, sql):
    with pytest.raises(Exception) as e:
        filled.sql(sql).collect()
    assert isinstance(e.value, SqlError) or "SCALAR_SUBQUERY" in str(e.value)


def test_changes(filled):
    assert rows(filled, "INSERT INTO t (s, id) VALUES ('new', 5)") == [(1,)]
    assert rows(filled, "SELECT * FROM t WHERE id = 5") == [(5, None, None, "new")]
    assert rows(filled, "INSERT INTO t SELECT id + 10, a, f, s FROM t") == [(5,)]
    assert rows(filled, "UPDATE t SET a = a + 1, s = 'up' WHERE a = 7") == [(4,)]
    assert rows(filled, "SELECT COUNT(*) FROM t WHERE a = 8 AND s = 'up'") == [(4,)]
    filled.sql("CREATE TABLE u (k INTEGER, v INTEGER)")
    filled.sql("INSERT INTO u VALUES (1, 100), (3, 300), (3, 301)")
    with pytest.raises(SqlError):
        filled.sql("UPDATE t SET a = v FROM u WHERE id = k")
    assert rows(filled, "UPDATE t SET a = v FROM u WHERE id = k AND v < 301") == [(2,)]
    assert rows(filled, "SELECT id, a FROM t WHERE a >= 100 ORDER BY 1") == [(1, 100), (3, 300)]
    assert rows(filled, "DELETE FROM t USING u WHERE id = k") == [(2,)]
    assert rows(filled, "DELETE FROM t WHERE id > 10") == [(5,)]
    assert rows(filled, "SELECT id FROM t ORDER BY 1") == [(2,), (4,), (5,)]
    assert rows(filled, "DELETE FROM t") == [(3,)]


def test_constraints(filled):
    for bad in ("INSERT INTO t VALUES (1, 1, 1.0, 'x')", "INSERT INTO t VALUES (8, 1, 1.0, 'x'), (8, 1, 1.0, 'x')", "INSERT INTO t VALUES (NULL, 1, 1.0, 'x')", "UPDATE t SET id = 1", "UPDATE t SET id = NULL WHERE id = 2", "CREATE UNIQUE INDEX i ON t (a)"):
        with pytest.raises(SqlError):
            filled.sql(bad)
    assert rows(filled, "SELECT COUNT(*) FROM t") == [(4,)]
    filled.sql("CREATE UNIQUE INDEX i ON t (a DESC, id)")
    filled.sql("CREATE INDEX j ON t (s)")
    filled.sql("CREATE TABLE u (a INTEGER UNIQUE, b INTEGER NOT NULL)")
    filled.sql("INSERT INTO u VALUES (NULL, 1)")
    for bad in ("INSERT INTO u VALUES (NULL, 2)", "INSERT INTO u (a) VALUES (5)"):
        with pytest.raises(SqlError):
            filled.sql(bad)
    assert rows(filled, "SELECT index_name, is_unique FROM meta_indexes ORDER BY 1") == [("i", True), ("j", False), ("t_pkey", True)]
    assert rows(filled, "SELECT field_number_in_table, is_desc_order FROM meta_index_keys WHERE index_name = 'i' ORDER BY 1") == [(0, False), (1, True)]
    filled.sql("DROP INDEX i")
    filled.sql("DROP TABLE t")
    assert rows(filled, "SELECT table_name FROM meta_tables") == [("u",)]
    assert rows(filled, "SELECT COUNT(*) FROM meta_indexes") == [(0,)]


def test_tables_survive_a_new_engine(spark, filled):
    again = Engine(spark, filled.catalog.root)
    assert again.catalog.schema("T") == filled.catalog.schema("t")
    assert rows(again, "SELECT COUNT(*) FROM t") == [(4,)]
    with pytest.raises(SqlError):
        again.sql("INSERT INTO t VALUES (1, 1, 1.0, 'x')")


def test_empty_table(engine):
    engine.sql("CREATE TABLE e (a INTEGER, b BIGINT, c BOOLEAN, d TEXT, f FLOAT, g TIMESTAMP)")
    assert rows(engine, "SELECT COUNT(*), SUM(a), MIN(d) FROM e") == [(0, None, None)]
    assert rows(engine, "SELECT a, COUNT(*) FROM e GROUP BY a") == []
    assert rows(engine, "DELETE FROM e") == [(0,)]


def test_parser_wants_every_token():
    assert Parser("SELECT 1;").parse()[0] == "query"
    with pytest.raises(SqlError):
        Parser("SELECT 1; SELECT 2").parse()


SCRIPT = """# a comment
statement ok
CREATE TABLE t1 (a INTEGER, b INTEGER)

statement ok
INSERT INTO t1 VALUES (1, 10), (2, 20), (NULL, 30)

statement error
INSERT INTO t1 VALUES (1)

query II rowsort
SELECT a, b FROM t1
----
1
10
2
20
NULL
30

query I valuesort
SELECT b FROM t1
----
3 values hashing to c2bd7dd0a47ba6a0bb4a7f6cf4e6c4f3

query R nosort
SELECT AVG(b) / 3 FROM t1
----
6.666667

skipif spark
query I nosort
SELECT nonsense
----
1

onlyif other
statement ok
SELECT nonsense

halt

statement ok
SELECT nonsense
"""


def test_logic_test_reader(engine):
    import hashlib

    good = SCRIPT.replace("c2bd7dd0a47ba6a0bb4a7f6cf4e6c4f3", hashlib.md5(b"10\n20\n30\n").hexdigest())
    assert run(engine, good) == []


def test_logic_test_reader_reports(engine):
    assert len(run(engine, "statement ok\nSELECT nope\n\nquery I nosort\nSELECT 1\n----\n2\n\nstatement error\nSELECT 1")) == 3


@pytest.mark.parametrize(
    ("sql", "code"),
    [
        ("SELECT FROM t", "EXPECTED_FIELDS"), ("INSERT t VALUES (1)", "EXPECTED_INSERT_INTO"), ("INSERT INTO t VALUES", "EXPECTED_VALUES"), ("CREATE TABLE q ()", "EXPECTED_FIELD_DEFS"), ("CREATE TABLE q (a INTEGER FOREIGN)", "EXPECTED_FIELD_CONSTRAINTS"),
        ("SELECT 1 FROM WHERE 1", "EXPECTED_TABLE_LIST"), ("DROP TABLE 5", "EXPECTED_IDENTIFIER"), ("CREATE TABLE q (a NOTYPE)", "EXPECTED_DATA_TYPE"), ("SELECT a FROM t ORDER BY a", "EXPECTED_ORDER_BY_LIST"), ("CREATE TABLE q a INTEGER", "EXPECTED_LEFT_PARANTH"),
        ("SELECT (1 FROM t", "EXPECTED_RIGHT_PARANTH"), ("SELECT 1 + FROM t", "EXPECTED_EXPRESSION"), ("SELECT 1 FROM t WHERE", "EXPECTED_EXPRESSION_IN_WHERE_CLAUSE"), ("SELECT COUNT(*) FROM t HAVING", "EXPECTED_EXPRESSION_IN_HAVING_CLAUSE"), ("SELECT 1 FROM t GROUP BY 1", "EXPECTED_GROUP_BY_LIST"),
        ("SELECT 1 FROM t WHERE SUM(a) > 1", "CANT_HAVE_AGGREGATION"), ("SELECT NOPE(1)", "CANT_CALL_FUNCTION"), ("SELECT CAST(1 AS NOPE)", "CANT_CAST_TYPE"), ("SELECT CASE 1 END", "INCORRECT_CASE_EXPRESSION"), ("SELECT SUM(MAX(a)) FROM t", "CANT_NEST_AGGREGATION"),
        ("SELECT zz FROM t", "LOGICAL_PLAN_ERROR"), ("DROP TABLE zz", "LOGICAL_PLAN_ERROR"), ("CREATE INDEX i t (a)", "EXPECTED_ON_TABLE_NAME"), ("ALTER TABLE t", "QUERY_NOT_SUPPORTED"),
    ],
)
def test_errors_carry_a_reason(filled, sql, code):
    with pytest.raises(SqlError) as e:
        filled.sql(sql).collect()
    assert e.value.code == code and code in CODES


def test_integers_that_outgrow_32_bits(filled):
    assert rows(filled, "SELECT 2147483647 + 1, -2147483647 - 2, 65536 * 65536, id + 2147483647 FROM t WHERE id = 4") == [(2**31, -(2**31) - 1, 2**32, 2**31 + 3)]
    assert rows(filled, "SELECT SUM((SELECT MAX(a) FROM t)) FROM t") == [(28,)]


def test_sub_queries_may_name_columns_two_levels_out(filled):
    nested = "SELECT x.id FROM t x WHERE EXISTS (SELECT 1 FROM t y WHERE y.id > x.id AND {})"
    assert rows(filled, nested.format("EXISTS (SELECT 1 FROM t z WHERE z.a = x.a AND z.id = y.id)")) == [(1,)]
    assert rows(filled, nested.format("x.a IN (SELECT z.a FROM t z WHERE z.id = y.id AND z.id > x.id)")) == [(1,)]


def test_plans_are_shown(filled):
    assert "Physical Plan" in filled.explain("SELECT id FROM t WHERE a = 7") and "PushedFilters" in filled.explain("SELECT id FROM t WHERE a = 7")


def folders(engine):
    found = engine.catalog._fs.globStatus(engine.catalog._path("*/*")) or []
    return len(list(found))


def test_rejected_changes_and_old_versions_leave_no_files(spark, filled):
    before = folders(filled)
    for bad in ("INSERT INTO t VALUES (1, 1, 1.0, 'x')", "UPDATE t SET id = 1"):
        with pytest.raises(SqlError):
            filled.sql(bad)
    assert folders(filled) == before
    filled.sql("UPDATE t SET a = 1")
    filled.sql("CREATE TABLE u (a INTEGER)")
    filled.sql("INSERT INTO u VALUES (1)")
    filled.sql("DROP TABLE u")
    assert folders(filled) == before + 2 and filled.catalog.vacuum() == 2 and folders(filled) == 1
    assert rows(Engine(spark, filled.catalog.root), "SELECT COUNT(*) FROM t WHERE a = 1") == [(4,)]


def test_a_second_writer_fails_and_a_torn_write_is_not_seen(spark, filled):
    other = Engine(spark, filled.catalog.root)
    filled.sql("INSERT INTO t VALUES (8, 1, 1.0, 'x')")
    with pytest.raises(SqlError):
        other.sql("INSERT INTO t VALUES (9, 1, 1.0, 'x')")
    assert other.catalog.get("t").paths and rows(Engine(spark, filled.catalog.root), "SELECT COUNT(*) FROM t") == [(5,)]
    out = filled.catalog._fs.create(filled.catalog._path("half.tmp"), True)
    out.write(bytearray(b"{"))
    out.close()
    assert rows(Engine(spark, filled.catalog.root), "SELECT COUNT(*) FROM t") == [(5,)]


def test_an_index_clusters_the_files(spark, engine, tmp_path):
    spark.range(20_000).selectExpr("id * 7919 % 20000 AS k", "id AS v").repartition(4).createOrReplaceTempView("source_rows")
    engine.sql("CREATE TABLE big (k BIGINT, v BIGINT)")
    engine.sql("INSERT INTO big SELECT k, v FROM source_rows")
    engine.sql("CREATE INDEX by_k ON big (k)")
    (path,) = engine.catalog.get("big").paths
    spans = []
    for file in sorted((tmp_path / "db" / path).glob("*.parquet")):
        for g in range(pq.ParquetFile(file).metadata.num_row_groups):
            stats = pq.ParquetFile(file).metadata.row_group(g).column(0).statistics
            spans.append((stats.min, stats.max))
    spans.sort()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0 and spans[-1][1] == 19_999
    assert rows(engine, "SELECT k FROM big WHERE k >= 19998 ORDER BY 1") == [(19_998,), (19_999,)]
    engine.sql("INSERT INTO big VALUES (-1, 0)")
    engine.compact("big")
    assert len(engine.catalog.get("big").paths) == 1 and rows(engine, "SELECT COUNT(*), MIN(k) FROM big") == [(20_001, -1)]


def test_an_update_from_fails_whatever_columns_are_read(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([(1, "x"), (1, "y")], "j int, w string")
    with pytest.raises(Exception, match="several source rows"):
        dml.update_from(target, source, "k", "j", {"v": F.col("w")}).select("k").collect()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "build", lambda master: spark)
    text = """CREATE TABLE q (a INTEGER, s TEXT); INSERT INTO q VALUES (1, 'semi;colon'),
    (0, 'two'); -- a comment; with one
SELECT s FROM q ORDER BY 1; SELECT 1 / a FROM q; SELECT nope;
\\p
SELECT a FROM q WHERE a = 1;
\\s
SELECT 5;
\\h
quit
SELECT 7;
"""
    cli.main(f"file://{tmp_path}/db", io.StringIO(text))
    shown = capsys.readouterr().out
    assert "semi;colon\ntwo\n2 rows" in shown and "DIVIDE_BY_ZERO" in shown and shown.count("error:") == 2
    assert "Physical Plan" in shown and "rows are not shown" in shown and "\n5\n" not in shown and "quit" in shown and "\n7\n" not in shown


def test_logic_test_labels_modes_and_faults(engine, monkeypatch):
    script = "query I nosort same\nSELECT 1\n----\n1\n\nquery I nosort same\nSELECT 2\n----\n2\n\nquery I sideways\nSELECT 1\n----\n1"
    assert [x.partition(": ")[2][:12] for x in run(engine, script)] == ["another resu", "unknown sort"]
    monkeypatch.setattr(engine, "sql", lambda text: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(engine, "statement error\nSELECT 1")


def test_not_in_a_query_knows_null_and_forces_no_broadcast(spark, filled):
    filled.sql("CREATE TABLE u (k INTEGER)")
    assert rows(filled, "SELECT id FROM t WHERE a NOT IN (SELECT k FROM u) ORDER BY 1") == [(1,), (2,), (3,), (4,)]
    filled.sql("INSERT INTO u VALUES (7), (9)")
    assert rows(filled, "SELECT id FROM t WHERE id < 9 AND a NOT IN (SELECT k FROM u) ORDER BY 1") == [(3,)]
    assert rows(filled, "SELECT id FROM t x WHERE a NOT IN (SELECT k FROM u WHERE k > x.id + 6) ORDER BY 1") == [(1,), (3,), (4,)]
    assert rows(filled, "SELECT id FROM t WHERE a NOT IN (SELECT k FROM u) OR id = 1 ORDER BY 1") == [(1,), (3,)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in filled.explain("SELECT id FROM t WHERE a NOT IN (SELECT k FROM u)")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    filled.sql("INSERT INTO u VALUES (NULL)")
    assert rows(filled, "SELECT id FROM t WHERE a NOT IN (SELECT k FROM u)") == []


def test_tables_of_another_database_are_not_seen(spark, tmp_path):
    one, two = (Engine(spark, f"file://{tmp_path}/{k}") for k in "ab")
    one.sql("CREATE TABLE lonely (a INTEGER)")
    one.sql("INSERT INTO lonely VALUES (1)")
    two.sql("CREATE TABLE both (a INTEGER)")
    with pytest.raises(SqlError):
        two.sql("SELECT * FROM lonely")
    assert rows(one, "SELECT * FROM lonely") == [(1,)]
    one.sql("DROP TABLE lonely")
    with pytest.raises(SqlError):
        one.sql("SELECT * FROM lonely")
