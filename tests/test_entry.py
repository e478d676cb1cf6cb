"""Every query of the engine's own operators equals its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from runlens import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple("NULL" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    data = got.collect()
    if name in plans.ORACLE_SQL:
        want = con.execute(plans.ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(names)
        assert rows(got.columns, data) == rows(names, want.fetchall())
    else:
        assert data


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
