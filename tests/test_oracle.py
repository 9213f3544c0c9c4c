"""Every driver query against its SQL in DuckDB, as the driver compares them: columns by name, rows as a bag."""

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 1e6 else str(v)
    return str(v).removesuffix(" 00:00:00").removesuffix("+00:00")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(got.columns) == sorted(columns)
    order = [columns.index(c) for c in got.columns]
    a = sorted(tuple(map(plain, r)) for r in got.collect())
    b = sorted(tuple(plain(r[k]) for k in order) for r in want)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)


def test_every_query_without_sql_runs(spark):
    for name in set(entry.queries()) - set(NAMES):
        if not name.startswith("op") and name != "pipeline":
            assert entry.queries()[name](spark, DATA).count() >= 0
