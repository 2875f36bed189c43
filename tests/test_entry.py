"""The registered queries agree with their SQL, and the entry query runs."""

import collections

import duckdb
import pytest

import __spark_entry__ as entry
from readloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    return collections.Counter(tuple(tuple(r[k]) if isinstance(r[k], list) else r[k] for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.records > 0 and row.bases == 32 * row.records and row.n_invalid == 0
