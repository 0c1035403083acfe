"""Every query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import os

import pytest

from quillstone import queries

duckdb = pytest.importorskip("duckdb")


def plain(rows):
    def one(x):
        if isinstance(x, (float, decimal.Decimal)):
            return round(float(x), 6)
        return x.isoformat() if isinstance(x, datetime.datetime) else x

    return sorted((tuple(one(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    if name not in queries.ORACLES:
        assert got
        return
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert got == plain(tuple(r[i] for i in place) for r in want.fetchall())
