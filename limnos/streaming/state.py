"""Keyed streaming state: first arrivals by key with expiry, and tasks with leases, retries and blocks.

Both run as ``transformWithState`` on RocksDB: what was seen lives in the state, so no batch reads the table it
writes to. Rows of a key within a batch are taken in order of time, so the partition of input into batches does not
change the result; a batch that is run again starts from the state before it and writes the same rows. Times are
microseconds in the state, whatever the time zone of a worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds to the next try after n failures: 10 * 2^n, an hour at most; fixed values.
FIRST_WAIT, LONGEST_WAIT, MOST_DOUBLINGS = 10, 3600, 8


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class FirstArrival(StatefulProcessor):
    """The first row of each key; with ``expiry``, again the first one after a pause that long in event time."""

    def __init__(self, expiry: int | None) -> None:
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.last.get()[0] if self.last.exists() else None
        for row in sorted(rows, key=lambda r: (r["_at"] or 0, repr(r))):
            at = row["_at"] or 0
            if held is None or (self.expiry and at - held > self.expiry):
                yield row
            held = at if held is None else max(held, at)
        self.last.update((held,))
        if self.expiry:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((held + self.expiry) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.last.update((initialState["at"],))

    def close(self) -> None:
        pass


def first_arrivals(stream: DataFrame, keys: list[str], time: str, expiry: timedelta | None = None, late: str = "0 seconds", known: DataFrame | None = None) -> DataFrame:
    """Rows of ``stream`` whose keys did not come before, nor are in ``known``, which is read once, when the query first starts.

    Without ``expiry`` a key is kept for ever; with it, the state of a key goes when the watermark passes its last row by that much.
    """
    base = (stream.withWatermark(time, late) if expiry else stream).withColumn("_at", F.unix_micros(time))
    initial = known.groupBy(*keys).agg(F.max(F.unix_micros(time)).alias("at")).groupBy(*keys) if known is not None else None
    processor = FirstArrival(expiry // timedelta(microseconds=1) if expiry else None)
    return base.groupBy(*keys).transformWithState(processor, base.schema, "Append", "EventTime" if expiry else "None", initialState=initial).drop("_at")


def append_first(spark: SparkSession, stream: DataFrame, table: str, keys: list[str], time: str, checkpoint: str, expiry: timedelta | None = None, late: str = "0 seconds", known: DataFrame | None = None) -> StreamingQuery:
    """First arrivals into a Parquet table, one partition ``ingest_batch`` a batch: a batch that is run again replaces what it wrote."""
    use_rocksdb(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("ingest_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_batch").parquet(table)

    return first_arrivals(stream, keys, time, expiry, late, known).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TASK = "status string, attempts int, next_try long, lease_until long, worker string"
OUTCOME = "at long, event string, worker string, outcome string, status string, attempts int, next_try long"
SECOND = 1_000_000


class TaskStates(StatefulProcessor):
    """One task a key: new, leased, retry, done or blocked."""

    def __init__(self, key: str, lease: int, max_attempts: int) -> None:
        self.key, self.lease, self.max_attempts = key, lease, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("task", TASK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        task = tuple(self.state.get()) if self.state.exists() else None
        for row in sorted(rows, key=lambda r: (r["at"], r["event"], r["worker"] or "")):
            task, outcome = after_event(task, row["event"], row["at"], row["worker"], row["delay"], self.lease, self.max_attempts)
            status, attempts, next_try = (task or (None, 0, None))[:3]
            yield Row(**{self.key: key[0], "at": row["at"], "event": row["event"], "worker": row["worker"], "outcome": outcome, "status": status, "attempts": attempts, "next_try": next_try})
        if task:
            self.state.update(task)

    def close(self) -> None:
        pass


def after_event(task: tuple | None, event: str, at: int, worker: str | None, delay: float | None, lease: int, max_attempts: int) -> tuple[tuple | None, str]:
    """(task, outcome) after one event; times and ``lease`` in microseconds, ``delay`` in seconds.

    ``seen`` makes a task unless there is one. ``take`` leases it if it is new, due again, or leased no longer.
    ``done`` and ``failed`` count only from the worker that holds the lease; a failure waits as long as the service
    asks or the doubling says, and after ``max_attempts`` the task is blocked.
    """
    if task is None:
        return (("new", 0, None, None, None), "added") if event == "seen" else (None, "unknown")
    status, attempts, next_try, until, holder = task
    if event == "seen":
        return task, "known"
    if event == "take":
        free = status == "new" or (status == "retry" and next_try <= at) or (status == "leased" and until <= at)
        return (("leased", attempts, None, at + lease, worker), "leased") if free else (task, "refused")
    if status != "leased" or holder != worker or until <= at:
        return task, "stale"
    if event == "done":
        return ("done", attempts, None, None, None), "done"
    attempts += 1
    if attempts >= max_attempts:
        return ("blocked", attempts, None, None, None), "blocked"
    wait = max(delay or 0, min(LONGEST_WAIT, FIRST_WAIT * 2 ** min(attempts, MOST_DOUBLINGS)))
    return ("retry", attempts, at + int(wait * SECOND), None, None), "retry"


def task_outcomes(events: DataFrame, key: str, lease: timedelta, max_attempts: int = 3) -> DataFrame:
    """(key, at, event, worker, outcome, status, attempts, next_try) for each of ``events(key, at, event, worker, delay)``, a stream."""
    kind = events.schema[key].dataType.simpleString()
    timed = events.withColumn("at", F.unix_micros("at"))
    out = timed.groupBy(key).transformWithState(TaskStates(key, lease // timedelta(microseconds=1), max_attempts), f"`{key}` {kind}, {OUTCOME}", "Update", "None")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", "next_try")})
