"""Every registered query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from assayloom.plans import exports  # noqa: F401  registers its queries too
from assayloom.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf_dir, con):
    assert name in ORACLE_SQL, "a core query has its SQL"
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert a == b and len(a) > 0


def test_rounding_of_halves_equals_sql(spark, tmp_path):
    """F1 of round 4: percents that lie half way between two roundings, and values without one."""
    firsts = [1.28, 6.4, 32.0, 160.0, 320.0, 0.0, 0.07]
    rows = [(1000 * u + k, u, first if k == 0 else k / 100 if k < 900 else -k / 100) for u, first in enumerate(firsts) for k in range(1000)]
    rows += [(9000, 9, 1e-300), (9001, 9, 1e300), (9002, 9, 1e5), (9003, 9, None), (9004, 9, float("nan")), (9005, 9, float("-inf"))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double").selectExpr("event_id", "user_id", "timestamp '2024-01-01 00:00:00' as ts", "value")
    df.write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = c.execute(f"select event_id, mass_pct from ({ORACLE_SQL['initial_mass_pct']}) order by event_id").fetchall()
    got = [(r["event_id"], r["mass_pct"]) for r in QUERIES["initial_mass_pct"](spark, str(tmp_path)).orderBy("event_id").collect()]
    assert len(got) == len(rows) and [repr(x) for x in got] == [repr(x) for x in want]


def test_entry_and_registration(spark, monkeypatch):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0


def test_rest_works_without_llm(spark):
    """Nothing outside the subpackage imports it."""
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[1] / "assayloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import) assayloom\.llm", p.read_text()), p
