"""Every query against its SQL twin in DuckDB, on the same Parquet files."""

import decimal
import importlib.util

import duckdb
import pytest

from sondera.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    r = con.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(norm(x[i]) for i in at)) for x in r.fetchall())
    got = sorted(repr(tuple(norm(x[c]) for c in cols)) for x in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry_works_with_and_without_the_corpus_operators(spark, sf):
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and set(QUERIES) <= set(q)
    has = importlib.util.find_spec("sondera.llm") is not None
    assert has == any(n.startswith("op1_") for n in q)
