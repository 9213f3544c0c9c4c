"""Streams over whole tables, run to their end: what keyed state keeps of them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from limnos.session import scratch
from limnos.streaming import state as X

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _events(spark, d):
    """The events as a stream of files; the last letter as a class, since a pattern also matches a single file."""
    path = f"{d}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("select user_id, event_type, min(ts) as ts from events group by 1, 2")
def stream_first_arrivals(spark, d):
    """The first event of each user and type, appended by a stream that keeps the keys it has seen."""
    table = scratch(spark)
    X.append_first(spark, _events(spark, d).select("user_id", "event_type", "ts"), table, ["user_id", "event_type"], "ts", scratch(spark)).awaitTermination()
    return spark.read.parquet(table).select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""
with recursive e as (select user_id, ts, case event_id % 3 when 0 then 'seen' when 1 then 'take' else 'failed' end as event, event_id from events),
o as (select *, row_number() over (partition by user_id order by ts, event) as k from e),
w(user_id, k, status, attempts, next_try, until, outcome) as (select distinct user_id, 0, cast(null as varchar), 0, cast(null as timestamp), cast(null as timestamp), '' from e
 union all select o.user_id, o.k,
  case outcome when 'added' then 'new' when 'leased' then 'leased' when 'retry' then 'retry' when 'blocked' then 'blocked' else status end,
  case when outcome in ('retry', 'blocked') then attempts + 1 else attempts end,
  case outcome when 'retry' then o.ts + to_seconds(cast(least(3600, 10 * power(2, least(attempts + 1, 8))) as bigint)) when 'known' then next_try when 'refused' then next_try when 'stale' then next_try when 'unknown' then next_try end,
  case outcome when 'leased' then o.ts + interval 6 hour when 'known' then until when 'refused' then until when 'stale' then until end, outcome
  from (select w.user_id, w.k, w.status, w.attempts, w.next_try, w.until, case
    when w.status is null then case when o.event = 'seen' then 'added' else 'unknown' end when o.event = 'seen' then 'known'
    when o.event = 'take' then case when w.status = 'new' or (w.status = 'retry' and w.next_try <= o.ts) or (w.status = 'leased' and w.until <= o.ts) then 'leased' else 'refused' end
    when w.status <> 'leased' or w.until <= o.ts then 'stale' when w.attempts + 1 >= 3 then 'blocked' else 'retry' end as outcome
   from w join o on o.user_id = w.user_id and o.k = w.k + 1) s join o on o.user_id = s.user_id and o.k = s.k + 1)
select user_id, outcome, count(*) as n from w where k > 0 group by 1, 2""")
def stream_task_outcomes(spark, d):
    """Events of each user as a task that is seen, taken and fails: how often each outcome came."""
    X.use_rocksdb(spark)
    event = F.when(F.col("event_id") % 3 == 0, "seen").when(F.col("event_id") % 3 == 1, "take").otherwise("failed")
    events = _events(spark, d).select("user_id", F.col("ts").alias("at"), event.alias("event"), F.lit("w").alias("worker"), F.lit(None).cast("double").alias("delay"))
    table = scratch(spark)

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    out = X.task_outcomes(events, "user_id", timedelta(hours=6))
    out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(table).groupBy("user_id", "outcome").agg(F.count("*").alias("n"))
