"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quire.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("QUIRE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    clean = lambda v: round(v, 5) if isinstance(v, float) else v
    got = sorted(([clean(r[c]) for c in columns] for r in df.collect()), key=repr)
    result = sql.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(([clean(r[names.index(c)]) for c in columns] for r in result.fetchall()), key=repr)
    assert got == want
