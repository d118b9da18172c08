"""Queries of the package against their SQL, on the smallest tables."""

import duckdb
import pytest

from rostrum.llm.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda columns, found: sorted(str([v for _, v in sorted(zip(columns, r, strict=True))]) for r in found)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_row(spark, name):
    table = "pages" if name.startswith("op8_") else "documents"
    assert QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
