"""Every registered query of the core library against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from lodestrata.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    show = lambda v: "%.9g" % v if isinstance(v, float) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_against_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
