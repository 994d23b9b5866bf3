import os

import pytest

import __spark_entry__ as entry

NAMES = sorted(entry.queries())


def cell(v):
    import pandas as pd

    if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    return str(int(v)) if isinstance(v, (bool, int, float)) and v == int(v) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, data, name):
    rows = entry.queries()[name](spark, data).toPandas()
    sql = entry.oracle_sql().get(name)
    if not sql:
        assert list(rows.columns)
        return
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    want = c.execute(sql).df()
    assert sorted(rows.columns) == sorted(want.columns)
    cols = sorted(rows.columns)
    assert sorted(([cell(v) for v in r] for r in rows[cols].astype(object).values.tolist()), key=str) == sorted(([cell(v) for v in r] for r in want[cols].astype(object).values.tolist()), key=str)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)


def test_entry_gives_rows(spark, data):
    assert entry.entry(spark).limit(1).count() == 1
