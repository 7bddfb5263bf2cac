"""Each query with an oracle against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from orbitlake.plans import catalog_queries, orbit_queries, store_queries  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(rows):
    value = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog_queries.ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = catalog_queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(catalog_queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert _rows(tuple(r[c] for c in cols) for r in df.collect()) == _rows(tuple(r[i] for i in at) for r in cur.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
