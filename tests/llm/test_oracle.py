"""Queries of the training-data operators against their SQL."""

import duckdb
import pytest

from marlstone.llm.oracle import ORACLE_SQL
from marlstone.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = [tuple(dict(zip(names, r, strict=True))[c] for c in got.columns) for r in cursor.fetchall()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
