import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from limnos.sources import readers as rd
from limnos.sources import sinks
from limnos.streaming import ingest
from limnos.streaming.state import append_first


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_names():
    assert rd.column_name("Unnamed: 0") == "unnamed_0" and rd.column_name("") == "source_index" and rd.column_name("2021") == "column_2021"
    assert rd.column_names(["A-B", "A B", "a_b"]) == ["a_b", "a_b_2", "a_b_3"]
    assert rd.long_names(["DRAIN_C", "X"], ["DRAIN_CODE", "DRAIN_NAME"]) == {"DRAIN_C": "DRAIN_CODE", "X": None}


def test_csv(spark, tmp_path):
    good, bad = rd.read_csv(spark, write(tmp_path / "a.csv", "﻿A;B B;C\n1;2,5;x\n3;4;y;z\n"))
    assert good.columns[:3] == ["a", "b_b", "c"] and rows(good, "a", "b_b", "c") == [("1", "2,5", "x")] and rows(bad, "issue", "read_as")[0][0] == "width"
    with pytest.raises(ValueError):
        rd.choose_delimiter("a;b,c")
    files = rd.read_bytes(spark, str(tmp_path))
    write(tmp_path / "b.csv", "Größe;x\nä;1\n".encode("cp1252"))
    write(tmp_path / "c.csv", b"<!DOCTYPE html><p>")
    got = {r.path.rsplit("/", 1)[1]: r for r in rd.inspect_csv(rd.read_bytes(spark, str(tmp_path)), [2]).collect()}
    assert got["c.csv"].html and not got["b.csv"].html and got["b.csv"].rows == 1 and got["a.csv"].odd_widths == 3
    assert "Größe" in rows(rd.read_bytes(spark, str(tmp_path / "b.csv")).select(rd.decoded(F.col("content")).alias("t")), "t")[0][0]
    inv = {r.path.rsplit("/", 1)[1]: r for r in rd.inventory(rd.read_bytes(spark, str(tmp_path))).collect()}
    assert inv["a.csv"].adapter == "csv" and files.count() >= 1
    assert rows(spark.createDataFrame([('"a"",""b""c"',)], "l string").select(F.size(rd.unquote_line(F.col("l"), ",")).alias("n")), "n") == [(2,)]


def test_portal_dialect(spark):
    text = "'Messstelle';'Wert'\n'L'Aquila';'1,5'\n'a;b';'2'\n'x'\n"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(rd.parse_portal("t")).alias("r")).select("r.row", "r.issue").collect()
    assert [(r.row, r.issue) for r in got] == [(["Messstelle", "Wert"], None), (["L'Aquila", "1,5"], None), (["a;b", "2"], None), (["x"], "width")]


def dbf(records):
    fields = [(b"NAME", b"C", 8, 0), (b"WERT", b"N", 6, 2)]
    head = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([size, dec]) + b"\0" * 14 for n, k, size, dec in fields) + b"\r"
    return struct.pack("<BBBBIHH20x", 3, 120, 1, 1, len(records), 32 + len(head), 15) + head + b"".join(records)


def test_dbf_and_shapes(spark, tmp_path):
    write(tmp_path / "s.dbf", dbf([b" " + "Müritz".encode().ljust(8) + b"  1.50", b"*" + b"weg     " + b"  2.00", b" " + b"B\xe4r     " + b"******"]))
    got = rd.read_dbf(spark, str(tmp_path / "s.dbf")).orderBy("source_row_number").collect()
    assert [(r.source_row_number, r.deleted, r.fields["NAME"], r.fields["WERT"]) for r in got] == [(1, False, "Müritz", "1.50"), (2, True, "weg", "2.00"), (3, False, "Bär", "******")]
    assert got[2].numeric_hex["WERT"] == "2a" * 6
    point = lambda n, x, y: struct.pack(">ii", n, 10) + struct.pack("<idd", 1, x, y)
    line = struct.pack("<i4d2i2i6d", 3, 0, 0, 2, 2, 2, 3, 0, 2, 0, 0, 1, 1, 2, 2)
    write(tmp_path / "s.shp", b"\0" * 100 + point(1, 1.5, 2.5) + struct.pack(">ii", 2, len(line) // 2) + line + point(3, 5, 6))
    shapes = rd.read_shp(spark, str(tmp_path / "s.shp")).orderBy("source_row_number").collect()
    assert [(r.kind, len(r.parts)) for r in shapes] == [("point", 1), ("polyline", 2), ("point", 1)] and shapes[0].parts[0][0].y == 2.5
    assert rows(rd.shapefile(spark, str(tmp_path / "s")), "source_row_number") == [(1,), (3,)]


def test_json_and_pages(spark, tmp_path):
    good, torn = rd.read_jsonl(spark, write(tmp_path / "a.jsonl", '{"a": 1}\n\n{"a": 2}\n{"a": 3'), "a int")
    assert rows(good, "a") == [(1,), (2,)] and torn.count() == 1
    feature = lambda i, c: '{"type":"Feature","properties":{"owk":"%s"},"geometry":{"type":"Point","coordinates":%s}}' % (i, c)
    f, problems = rd.read_geojson(spark, write(tmp_path / "g.geojson", '{"type":"FeatureCollection","features":[%s,%s,%s]}' % (feature("A", "[1,2]"), feature("A", "[3,4]"), feature("B", "[999,2]"))), "owk", (0, 0, 10, 10))
    assert rows(problems, "id", "problem") == [("A", "repeated id"), ("B", "outside the envelope")] and rd.last_by_code(f, "owk").count() == 2
    html = "<html><head><title> T </title><meta name=description content=d><script type='application/ld+json'>{\"x\":1}</script><script>no</script></head><body><a href='/u'>Link <b>x</b></a><select name=s><option value=1>eins</select></body></html>"
    p = spark.createDataFrame([(html,), (None,)], "h string").select(rd.parse_page("h").alias("p")).select("p.*").collect()
    assert p[0].title == "T" and p[0].links[0].url == "/u" and p[0].links[0].label == "Link x" and p[0].json_ld == ['{"x":1}'] and p[0].description == "d" and p[0].options[0].label == "eins" and "no" not in p[0].text
    box = spark.createDataFrame([("<table><tr><th>Fläche</th><td>1 <b>km</b></td></tr><tr><th>Tiefe</th><td>2</td></tr></table>",)], "h string").select(rd.infobox(F.col("h")).alias("m")).first().m
    assert box == {"Fläche": "1 km", "Tiefe": "2"}


def test_wfs_and_search(spark):
    body = '{"features":[{"id":"f1","properties":{"k":"1"},"geometry":{"type":"Point"}},{"id":"f2","properties":{"k":"2"},"geometry":null}]}'
    good, bad = rd.wfs_pages(spark.createDataFrame([(0, body), (2, body)], "offset int, body string"), 3, {"k": "1"})
    assert rows(good, "id") == [("f1",)] and {r.problem for r in bad.collect()} == {"does not match the filter", "expected 3, found 2"}
    hits = spark.createDataFrame([("http://A.de/?utm_x=1", "t1", None, 2), ("http://a.de/", "t0", None, 1), (None, "d", "10.1234/x", 1)], "url string, title string, doi string, rank int")
    assert rows(rd.search_results(hits), "url", "title") == [("http://a.de/", "t0"), ("https://doi.org/10.1234/x", "d")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", [1, 2], 2.5), (None, None, None)], "a string, b array<int>, c double")
    sinks.write_datamart(df, str(tmp_path / "m"))
    assert rows(spark.read.csv(str(tmp_path / "m"), sep=";", header=True, escape='"'), "a", "b", "c") == [("'=1+1", "[1,2]", "2.5"), (None, None, None)]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":"=1+1","b":[1,2],"c":2.5}', '{"a":null,"b":null,"c":null}']
    points = spark.createDataFrame([("l", 0, 0, 0.0, 0.0), ("l", 0, 1, 10.0, 5.0), ("m", 0, 0, 5.0, 5.0)], "id string, part int, pos int, x double, y double")
    assert rows(sinks.map_paths(points, 100.0, 100.0), "id", "d") == [("l", "M0.0 50.0 L100.0 0.0"), ("m", "M50.0 0.0")]


def test_streams(spark, tmp_path):
    at = lambda m: dt.datetime(2020, 1, 1, 0, m)
    src, table = tmp_path / "in", str(tmp_path / "table")
    spark.createDataFrame([(1, at(1), "a"), (2, at(2), "b")], "id int, ts timestamp, k string").write.parquet(f"{src}/1")
    schema = spark.read.parquet(f"{src}/1").schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{src}/*")
    append_first(spark, stream(), table, ["id"], "ts", str(tmp_path / "c1")).awaitTermination(60)
    spark.createDataFrame([(2, at(2), "b"), (3, at(50), "a")], "id int, ts timestamp, k string").write.parquet(f"{src}/2")
    append_first(spark, stream(), table, ["id"], "ts", str(tmp_path / "c1")).awaitTermination(60)
    assert rows(spark.read.parquet(table), "id") == [(1,), (2,), (3,)]
    q = ingest.windowed_counts(stream(), "ts", "10 minutes", "5 minutes", keys=["k"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("w"), "k", "n") == [("a", 1), ("a", 1), ("b", 2)]
    assert rows(ingest.sessions(spark.read.parquet(table), "ts", "5 minutes", "1 minute", "k"), "k", "n") == [("a", 1), ("a", 1), ("b", 1)]


def test_form_of_odd_pages(spark):
    pages = [None, "", "<select name=a>", "<select><option>x</select>", "<select name=a><option>x<option value=2 selected>y --- (12 values)<p>", "<textarea name=t> a\nb", "<input name=r type=radio value=1><input name=r type=radio value=2 checked>"]
    got = [r.f for r in spark.createDataFrame(list(enumerate(pages)), "i int, h string").select("i", rd.parse_form("h").alias("f")).orderBy("i").collect()]
    assert [[(x.field, x.value) for x in f.fields] for f in got] == [[], [], [], [], [("a", "2")], [("t", "a b")], [("r", "2")]]
    assert [tuple(o) for o in got[4].options] == [("a", "x", "x", None, False), ("a", "y", "2", 12, True)]
