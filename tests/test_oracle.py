"""Each query of the library itself against its SQL, on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from kinetra.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def content(pdf):
    plain = pdf[sorted(pdf.columns)].astype(object).where(pdf[sorted(pdf.columns)].notna(), None)
    return sorted(map(repr, plain.itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert content(catalog.QUERIES[name](spark, SF).toPandas()) == content(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_entry_is_imported_without_a_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
