"""Every registered query of the core against its SQL on the smallest tables; the rest must give rows."""

import datetime
import math

import duckdb
import pytest

from rostrum.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    own = duckdb.connect()
    for t in TABLES:
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return own


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return v
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return round(float(v), 5) + 0.0


def rows(columns, found):
    return sorted(str([plain(v) for _, v in sorted(zip(columns, r, strict=True))]) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    if name not in ORACLES:
        assert got.limit(1).count() == 1
        return
    want = db.sql(ORACLES[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
