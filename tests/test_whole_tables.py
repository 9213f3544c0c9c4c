"""Queries that must read every row, on tables whose ids lie far apart."""

import pytest
from test_oracle import plain

import __spark_entry__ as entry

TABLES = {
    "customer": "select k as c_custkey from range(390, 1200) r(k)",
    "supplier": "select k as s_suppkey, 'Supplier ' || k as s_name, k % 25 as s_nationkey from range(1, 80) r(k)",
    "part": "select k as p_partkey, ['red', 'blue', 'old', 'hot'][k % 4 + 1] || ' ' || ['ring', 'bolt', 'plate'][k % 3 + 1] || case when k % 5 = 0 then ' large ring steel' else '' end as p_name, 'B' || k % 7 as p_brand, k % 50 as p_size from range(190, 900) r(k)",
    "lineitem": "select k as l_orderkey, k % 3 as l_linenumber, 190 + k % 100 as l_partkey, 15 + k % 9 as l_suppkey, cast(k * 1.5 as decimal(15, 2)) as l_extendedprice from range(0, 3000) r(k)",
    "events": "select k as event_id, k % 7 as user_id, 'type ' || lpad(cast(k % 83 as varchar), 2, '0') as event_type, cast(k % 90 as double) as value from range(0, 4000) r(k)",
    "documents": "select k as doc_id, 'en' as lang, 'The first forty characters are all alike, then: ' || k // 2 as text from range(0, 200) r(k)",
    "embeddings": "select k as vec_id, [sin(k), cos(k * 3), sin(k * 7)]::float[] as embedding from range(0, 250) r(k) union all select 300000 + k, [cos(k), sin(k * 5), 0.5]::float[] from range(0, 250) r(k)",
}
QUERIES = "lookup_first_match token_set_match triples geo_overlaps geo_points_in_polygons geo_within_distance vector_topk source_inventory frontier_score compare_variants quote_containment".split()


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    import duckdb

    folder, con = tmp_path_factory.mktemp("whole"), duckdb.connect()
    for name, sql in TABLES.items():
        con.execute(f"copy ({sql}) to '{folder}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as from '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", QUERIES)
def test_every_row_is_read(spark, tables, name):
    folder, con = tables
    got = entry.queries()[name](spark, folder)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    assert want and sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want
