"""JSON forms of values, rows and graphs."""

import datetime as dt
import json
from decimal import Decimal

from limnos.functions import values as V
from limnos.operators import graph as G


def test_rows_as_objects(spark):
    at = dt.datetime(2020, 5, 1, 12, 30)
    rows = [(1, "a", dt.date(2020, 5, 1), at, at.replace(microsecond=120), Decimal("1.50"), [dt.date(1999, 1, 2)], {"k": Decimal("2.00")}, True, bytearray(b"xy")), (None,) * 10]
    df = spark.createDataFrame(rows, "n long, s string, d date, t timestamp, u timestamp, p decimal(5,2), l array<date>, m map<string,decimal(5,2)>, b boolean, x binary")
    one, none = (json.loads(r.json) for r in V.json_rows(df).collect())
    assert one == {"n": 1, "s": "a", "d": "2020-05-01", "t": "2020-05-01T12:30:00", "u": "2020-05-01T12:30:00.000120", "p": "1.50", "l": ["1999-01-02"], "m": {"k": "2.00"}, "b": True, "x": "xy"}
    assert none == dict.fromkeys(one)


def test_viewer_parts_hold_every_entry_once(spark):
    nodes = spark.createDataFrame([(str(k), "Big" if k % 10 else "Small") for k in range(200)], "key string, label string")
    edges = spark.createDataFrame([("e", str(k), str(k + 1), "T") for k in range(30)], "name string, start_key string, end_key string, type string")
    parts = {r.part: json.loads(r.json) for r in G.viewer_json(nodes, edges, size=50).collect()}
    big = [p for p in parts if p.startswith("nodes/Big/")]
    assert len(big) == 4 and {"nodes/Small", "edges/e"} < parts.keys()
    assert sorted(x["key"] for p in big for x in parts[p]) == sorted(str(k) for k in range(200) if k % 10)
    assert len(parts["edges/e"]) == 30
