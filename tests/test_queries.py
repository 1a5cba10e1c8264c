"""Every registered query against its SQL twin on the smallest driver tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans import ORACLES, QUERIES
from scripts.compare import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, FOLDER)
    got = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    if name not in ORACLES:
        assert len(got)
        return
    cursor = db.execute(ORACLES[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_runs(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
