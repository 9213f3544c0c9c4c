"""Addressable files read by many tasks, and filters pushed into a paged source."""

import json
import struct

import pytest

from limnos.sources import datasources as ds
from limnos.sources import readers as rd


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def dbf(n, cut=0):
    fields = [(b"EU_CD", b"C", 8, 0), (b"WERT", b"N", 6, 2)]
    size = 1 + sum(f[2] for f in fields)
    head = struct.pack("<B3BIHH20x", 3, 24, 1, 1, n, 32 + 32 * len(fields) + 1, size)
    head += b"".join(name.ljust(11, b"\0") + kind + b"\0" * 4 + bytes([length, dec]) + b"\0" * 14 for name, kind, length, dec in fields) + b"\r"
    body = b"".join((b"*" if k % 7 == 3 else b" ") + f"LW{k}".encode("latin-1").ljust(8) + f"{k / 4:.2f}".encode().rjust(6) for k in range(n))
    return (head + body)[: len(head) + len(body) - cut] + (b"\x1a" if not cut else b"")


def shapefile(n):
    body, index, at = b"", b"", 50
    for k in range(n):
        if k % 3 == 0:
            content = struct.pack("<idd", 1, k, -k)
        else:
            points = [(k + j, k * j / 2) for j in range(3 + k % 5)] + [(float(k), 0.0)]
            parts = [0, 2] if k % 3 == 2 else [0]
            content = struct.pack("<i4dii", 5 if k % 2 else 3, 0, 0, 1, 1, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *parts) + b"".join(struct.pack("<dd", *p) for p in points)
        index += struct.pack(">ii", at, len(content) // 2)
        body += struct.pack(">ii", k + 1, len(content) // 2) + content
        at += 4 + len(content) // 2
    return b"\0" * 100 + body, b"\0" * 100 + index


def test_dbf_ranges_equal_the_whole_file_reader(spark, tmp_path):
    ds.register(spark)
    (tmp_path / "a.dbf").write_bytes(dbf(250))
    (tmp_path / "b.DBF").write_bytes(dbf(40, cut=20))
    (tmp_path / "none.dbf").write_bytes(dbf(0))
    got = spark.read.format("dbf").option("records", 30).load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 9 + 2
    want = rd.read_dbf(spark, str(tmp_path / "*"))
    strip = lambda df: rows(df.selectExpr("regexp_extract(source_file, '[^/]+$', 0) as f", "source_row_number", "deleted", "to_json(fields) as x", "to_json(numeric_hex) as h"))
    assert strip(got) == strip(want) and got.where("deleted").count() > 30
    assert spark.read.format("dbf").load(str(tmp_path / "none.dbf")).count() == 0
    assert spark.read.format("dbf").load(f"file://{tmp_path}/a.dbf").where("fields['EU_CD'] = 'LW9'").first().numeric_hex["WERT"] == b"  2.25".hex()


@pytest.mark.parametrize("indexed", [True, False])
def test_shapes_by_index_ranges(spark, tmp_path, indexed):
    ds.register(spark)
    shapes, index = shapefile(100)
    (tmp_path / "a.shp").write_bytes(shapes)
    if indexed:
        (tmp_path / "a.shx").write_bytes(index)
    got = spark.read.format("shp").option("records", 15).load(str(tmp_path / "a.shp"))
    assert got.rdd.getNumPartitions() == (7 if indexed else 1)
    assert rows(got.drop("source_file")) == rows(rd.read_shp(spark, str(tmp_path / "a.shp")).drop("source_file"))
    assert got.count() == 100


def pages(tmp_path, sizes, layer="lakes", first=0):
    start, k = first, first
    for n in sizes:
        at = tmp_path / f"layer={layer}" / f"start={start}"
        at.mkdir(parents=True)
        features = [{"id": f"{layer}.{k + j}", "properties": {"wb": f"W{(k + j) % 4}", "n": k + j, "none": None}, "geometry": None if j % 2 else {"type": "Point", "coordinates": [1, k + j]}} for j in range(n)]
        (at / "page.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
        start, k = start + n, k + n


def test_filters_are_pushed_into_the_pages(spark, tmp_path):
    ds.register(spark)
    pages(tmp_path, [10, 10, 7])
    pages(tmp_path, [5], "rivers")
    df = spark.read.format("captured_pages").option("key", "wb").load(str(tmp_path))
    assert df.count() == 32 and df.rdd.getNumPartitions() == 4
    found = df.where("layer = 'lakes' and key in ('W1', 'W3') and start >= 10 and start < 20")
    assert rows(found.select("feature_id")) == [(f"lakes.{k}",) for k in range(10, 20) if k % 2]
    assert "Filter (" not in found._jdf.queryExecution().executedPlan().toString()  # Spark has nothing left to judge
    assert found.rdd.getNumPartitions() == 1  # the other pages are not opened
    # what the source cannot judge stays with Spark
    assert df.where("key like '%1' and properties['n'] = '9'").count() == 1
    assert df.where("layer = 'none'").count() == 0 and df.where("key = 'W1' and key = 'W2'").count() == 0


def test_capture_state_resumes_and_sees_drift(spark, tmp_path):
    ds.register(spark)
    pages(tmp_path, [4, 4, 2])
    pages(tmp_path, [4], "gap")
    pages(tmp_path, [4], "gap", first=8)
    pages(tmp_path, [3], "moved")
    expected = spark.createDataFrame([("lakes", 10, 10), ("gap", 12, 12), ("moved", 3, 5), ("new", 6, 6)], "layer string, hits long, seen_hits long")
    got = ds.capture_state(spark.read.format("captured_pages").load(str(tmp_path)), expected)
    assert rows(got) == [("gap", 2, 8, 4, 0, False, False), ("lakes", 3, 10, 10, 0, True, False), ("moved", 1, 3, 3, 0, False, True), ("new", 0, 0, 0, 0, False, False)]
