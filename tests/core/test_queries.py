"""Every query against its SQL on the smallest tables, where they are there."""

import os
import time

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, name):
    import duckdb

    began = time.time()
    found = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    assert time.time() - began < 120
    sql = entry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(found.columns)
        place = [columns.index(c) for c in found.columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in place)) for r in result.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
