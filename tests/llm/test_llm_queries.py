"""Every query of the operators runs over the smallest tables, and against its SQL where it has one."""

from __future__ import annotations

import pytest

from quillstone.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).collect()
    assert got
    if name in queries.ORACLES:
        con = duckdb.connect()
        for table in ("chunks", "documents"):
            con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
        want = con.sql(queries.ORACLES[name])
        assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())


def test_results_that_are_fixed(spark, sf):
    columns = {
        "p1_found": ["file_id"], "p2_found": ["file_id"], "p3_found": ["file_id", "line_no"], "p4_found": ["record_kind", "record_id", "pii_type", "value"], "p5_found": ["file_id", "line_no", "symbol"], "p6_found": ["chunk_id"], "p9_found": ["doc_id"],
    }
    for name, want in columns.items():
        df = queries.QUERIES[name](spark, sf)
        assert df.columns == want
        assert df.count() == df.distinct().count()
