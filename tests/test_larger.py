"""Queries equal their SQL where a document or a group is larger than in the given tables."""

import duckdb
import pytest

import __spark_entry__
from test_entry import rows


def check(spark, folder, name, table, sql):
    """``name`` over one table made by ``sql``."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    got = __spark_entry__.queries()[name](spark, str(folder))
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    assert want and rows(names, [tuple(r[n] for n in names) for r in got.collect()]) == rows(names, want)


def events(n, user, kinds="['click', 'view', 'signup', 'error', 'purchase']"):
    return f"""SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * i AS ts, ({user})::BIGINT AS user_id,
        ({kinds})[(1 + hash(i) % len({kinds}))::BIGINT] AS event_type, 0.5 AS value, '{{"k": ' || i % 7 || '}}' AS props FROM range({n}) r(i)"""


@pytest.mark.parametrize("n", [1200, 9000])
def test_many_errors_under_a_ceiling(spark, tmp_path, n):
    """Error lines that need more than half of the ceiling, or more than all of it."""
    check(spark, tmp_path, "cap_error_lines", "events", events(n, "i % 2"))

def test_logs_above_the_window(spark, tmp_path):
    """A log of more than 4 MiB goes through the rules whole."""
    check(spark, tmp_path, "reduce_aggressive", "events", events(130_000, "i % 4 * 15"))
