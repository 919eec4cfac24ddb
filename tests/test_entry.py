import os

import duckdb
import pytest

import __spark_entry__ as entry_module
import compare
from fieldqueue.plans import registry

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    got = compare.rows_of(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    db = duckdb.connect()
    for t in compare.TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    out = db.execute(sql)
    cols = [c[0] for c in out.description]
    assert sorted(cols) == sorted(df.columns) and got == compare.rows_of(cols, out.fetchall())
