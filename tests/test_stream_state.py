"""Keyed streaming state against plain folds over all rows, whatever the batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from limnos.streaming import state as st

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp, v int"


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def arrivals(n=300):
    rng = random.Random(2)
    return sorted((f"k{rng.randrange(40)}", T0 + timedelta(minutes=rng.randrange(3000)), k) for k in range(n))


def write(spark, rows, schema, folder, parts):
    ordered = sorted(rows, key=lambda r: r[1])
    size = -(-len(ordered) // parts)
    for k in range(parts):
        spark.createDataFrame(ordered[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_first_arrivals_do_not_depend_on_batches(spark, tmp_path):
    rows = arrivals()
    known = spark.createDataFrame([("k1", T0, 0), ("k2", T0, 0)], SCHEMA)
    want = sorted(min((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])) for k in {r[0] for r in rows} - {"k1", "k2"})
    for parts in (1, 3):
        write(spark, rows, SCHEMA, tmp_path / f"in{parts}", parts)
        query = st.append_first(spark, stream(spark, tmp_path / f"in{parts}", SCHEMA), str(tmp_path / f"out{parts}"), ["k"], "at", str(tmp_path / f"cp{parts}"), known=known)
        query.awaitTermination()
        got = spark.read.parquet(str(tmp_path / f"out{parts}"))
        assert [(r.k, r.at) for r in got.orderBy("k").collect()] == [r[:2] for r in want]
    # replayed rows add nothing, and no batch reads the table
    write(spark, rows[:50], SCHEMA, tmp_path / "in3", 1)
    again = st.append_first(spark, stream(spark, tmp_path / "in3", SCHEMA), str(tmp_path / "out3"), ["k"], "at", str(tmp_path / "cp3"), known=known)
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out3")).count() == len(want)
    again.explain()
    assert str(tmp_path / "out3") not in again._jsq.explainInternal(True)


def test_keys_expire_in_event_time(spark, tmp_path):
    minute = timedelta(minutes=1)
    rows = [("a", T0, 1), ("a", T0 + 5 * minute, 2), ("a", T0 + 40 * minute, 3), ("b", T0 + 41 * minute, 4), ("a", T0 + 45 * minute, 5), ("b", T0 + 300 * minute, 6)]
    write(spark, rows, SCHEMA, tmp_path / "in", 3)
    st.use_rocksdb(spark)
    out = st.first_arrivals(stream(spark, tmp_path / "in", SCHEMA), ["k"], "at", expiry=30 * minute)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 4, 6]


@pytest.mark.parametrize("parts", [1, 4])
def test_tasks_follow_the_plain_fold(spark, tmp_path, parts):
    rng = random.Random(4)
    events, schema = [], "task string, at timestamp, event string, worker string, delay double"
    for k in range(400):
        kind = rng.choice(["seen", "take", "take", "done", "failed", "failed"])
        events.append((f"t{rng.randrange(12)}", T0 + timedelta(seconds=40 * k), kind, rng.choice(["w1", "w2"]), rng.choice([None, 500.0])))
    write(spark, events, schema, tmp_path / "in", parts)
    st.use_rocksdb(spark)
    out = st.task_outcomes(stream(spark, tmp_path / "in", schema), "task", timedelta(minutes=30))
    got = []
    query = out.writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    tasks, want = {}, []
    for key, at, event, worker, delay in sorted(events, key=lambda r: r[1]):
        tasks[key], outcome = st.after_event(tasks.get(key), event, int(at.timestamp() * st.SECOND), worker, delay, 1800 * st.SECOND, 3)
        want.append((key, at, outcome))
    assert sorted((r.task, r.at, r.outcome) for r in got) == sorted(want)
    assert {o for *_, o in want} >= {"added", "known", "leased", "refused", "stale", "done", "retry", "unknown"}


def test_task_rules():
    at = lambda s: s * st.SECOND
    step = lambda task, event, s, worker="w", delay=None: st.after_event(task, event, at(s), worker, delay, 60 * st.SECOND, 3)
    task, _ = step(None, "seen", 0)
    task, _ = step(task, "take", 1)
    assert step(task, "take", 30)[1] == "refused" and step(task, "take", 61, "x")[1] == "leased"  # a lease that ran out is free
    assert step(task, "done", 61)[1] == "stale" and step(task, "done", 5, "x")[1] == "stale"
    task, outcome = step(task, "failed", 5)
    assert outcome == "retry" and task[2] == at(25) and step(task, "take", 24)[1] == "refused"
    task, _ = step(task, "take", 25)
    task, _ = step(task, "failed", 26, delay=90.0)
    assert task[:3] == ("retry", 2, at(116))
    task, _ = step(task, "take", 116)
    assert step(task, "failed", 117)[1] == "blocked"
