"""Every registered query against its SQL twin at sf0.001; rows-only where there is none."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_queries import TABLES, compare

QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]).startswith("ok")
    else:
        rows = df.collect()
        assert rows, "a query of these tables has rows"
        for r in rows:
            assert not any(isinstance(v, float) and v != v for v in r), "no figure may be undefined"


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
