"""Parts of any size, windows around names, customers without orders."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from limnos.functions import text as T


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    import duckdb

    folder, con = tmp_path_factory.mktemp("r03"), duckdb.connect()
    for name, sql in {
        "nation": "select k as n_nationkey, 'N' || k as n_name from range(3) r(k)",
        "customer": "select k as c_custkey, 'C' || k as c_name, k % 3 as c_nationkey from range(40) r(k)",
        "orders": "select k as o_orderkey, k % 30 as o_custkey, '1-URGENT' as o_orderpriority, 10.0 as o_totalprice from range(100050) r(k)",
    }.items():
        con.execute(f"copy ({sql}) to '{folder}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as from '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["viewer_parts", "anti_new_rows"])
def test_query_matches_its_sql_over_large_parts_and_cheap_orders(spark, tables, name):
    folder, con = tables
    got = entry.queries()[name](spark, folder)
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    if name == "anti_new_rows":
        assert sorted(r[0] for r in want) == list(range(30, 40))


@pytest.mark.parametrize("reach", [0, 3, 10])
def test_windows_are_those_of_the_pattern(spark, reach):
    rng = random.Random(reach)
    texts = ["".join(rng.choice(["a b", "with", " with ", " ", "x", "ü", "𝛼 ", "withal", "a b a b "]) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for name in ("with", "a b", "a b a"):
        old = F.regexp_extract_all("t", F.lit(rf"(?Us)((?:.{{0,{reach}}})(?<!\w){re.escape(name)}(?!\w).{{0,{reach}}})"), F.lit(1))
        rows = df.select(old.alias("old"), T._windows(F.col("t"), name, reach).alias("new")).collect()
        assert any(r.old for r in rows) and [r.new for r in rows] == [r.old for r in rows]


def test_windows_take_one_pass(spark):
    df = spark.range(64, numPartitions=4).select(F.concat(F.repeat(F.lit("word "), 40_000), F.lit("with and")).alias("t"))
    found = df.select(F.size(T.identity_spans(F.col("t"), ["with"])).alias("n"), F.length(T.identity_spans(F.col("t"), ["with"])[0]["window"]).alias("l")).distinct()
    assert list(map(tuple, found.collect())) == [(1, 258)]
