"""Queries of the operators that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from assayloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    a = sorted(map(str, (tuple(r[c] for c in names) for r in got.collect())))
    assert a == sorted(map(str, want.fetchall())) and a
