import os

import duckdb
import pytest

from lexspark import queries as core

SQL = core.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(v) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for f in os.listdir(d):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    df = core.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    if name not in SQL:
        assert rows
        return
    want = db.sql(SQL[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted((tuple(map(plain, r)) for r in want.select(quoted).fetchall()), key=repr)
