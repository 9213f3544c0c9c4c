"""Frontier scores, credits, partition plans and windows over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.operators import aggregates as A
from limnos.operators import crawl as C
from limnos.operators import relational as R
from limnos.operators import sequences as Q
from limnos.session import read_table as t
from limnos.streaming.ingest import windowed_counts

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("""
select l_returnflag, l_linestatus, n as expected, cast(found as bigint) as found from (select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2) p
join (select l_returnflag as f, l_linestatus as s, count(*) - case when l_returnflag = 'A' then 1 else 0 end as found from lineitem group by 1, 2) c on f = l_returnflag and s = l_linestatus where n <> found""")
def partition_reconcile(spark, d):
    parents = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).withColumn("id", F.concat("l_returnflag", "l_linestatus"))
    lost = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1) & (F.row_number().over(_first()) == 1), 1).otherwise(0)
    children = t(spark, d, "lineitem").withColumn("lost", lost).groupBy(F.concat("l_returnflag", "l_linestatus").alias("parent"), "l_linenumber").agg((F.count("*") - F.sum("lost")).alias("n"))
    bad = A.reconcile(parents.select("id", "n"), children, "id", "parent", "n")
    return bad.select(F.left("id", F.lit(1)).alias("l_returnflag"), F.right("id", F.lit(1)).alias("l_linestatus"), "expected", "found")


def _first():
    from pyspark.sql.window import Window

    return Window.partitionBy("l_returnflag", "l_linestatus", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query("""
with o as (select l_returnflag as job, 'line' as dimension, cast(l_linenumber as varchar) as label, count(*) as n from lineitem group by 1, 2, 3 union all select l_returnflag, 'status', l_linestatus, count(*) from lineitem group by 1, 2, 3
  union all select l_returnflag, 'year', cast(year(l_shipdate) as varchar), count(*) from lineitem group by 1, 2, 3),
c as (select job, dimension, count(*) as k, round(sum(greatest(1, ceil(n / 500.0))) + 0.05 * count(*), 6) as cost from o group by 1, 2 having count(*) >= 2)
select job, arg_min(dimension, row(cost, k, dimension)) as dimension, cast(min(cost) as double) as cost, arg_min(k, row(cost, k, dimension)) as children from c group by 1""")
def split_choice(spark, d):
    li = t(spark, d, "lineitem")
    part = lambda name, c: li.groupBy(F.col("l_returnflag").alias("job"), F.lit(name).alias("dimension"), c.cast("string").alias("label")).agg(F.count("*").alias("n"))
    options = part("line", F.col("l_linenumber")).union(part("status", F.col("l_linestatus"))).union(part("year", F.year("l_shipdate")))
    expected = li.groupBy(F.col("l_returnflag").alias("job")).agg(F.count("*").alias("expected"))
    return C.split_choice(options.join(expected, "job"), 500)


@query("""
with recursive y as (select year(o_orderdate) as pos, count(*) as n from orders group by 1), b as (select *, row_number() over (order by pos desc) as r from y),
g(pos, n, r, total, grp) as (select pos, n, r, n, 0 from b where r = 1 union all select b.pos, b.n, b.r, case when g.total + b.n <= 500 then g.total + b.n else b.n end, case when g.total + b.n <= 500 then g.grp else g.grp + 1 end from g join b on b.r = g.r + 1)
select cast(min(pos) as bigint) as first, cast(max(pos) as bigint) as last, cast(sum(n) as bigint) as n from g group by grp""")
def year_ranges(spark, d):
    years = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")).withColumn("pos", -F.col("y")).withColumn("k", F.lit(1))
    g = Q.greedy_groups(years, ["k"], "pos", "n", 500)
    return g.groupBy("group").agg(F.min("y").cast("long").alias("first"), F.max("y").cast("long").alias("last"), F.sum("n").alias("n")).drop("group")


@query("""
with h as (select user_id as profile, event_type as family, count(*) as n, count(*) filter (where value < 30) as empty from events where event_id % 2 = 0 group by 1, 2), b as (select profile, sum(n) as body from h group by 1)
select event_id, cast(event_id % 100 - 15 * coalesce(body, 0) - 12 * coalesce(empty, 0) - 5 * coalesce(n, 0) as bigint) as score from events left join b on b.profile = user_id left join h on h.profile = user_id and h.family = event_type where event_id % 2 = 1""")
def frontier_score(spark, d):
    """Every event is a candidate or history."""
    e = t(spark, d, "events")
    return _frontier_score(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"))


def _frontier_score(new, old):
    candidates = new.select("event_id", F.col("user_id").alias("profile"), F.col("event_type").alias("family"), (F.col("event_id") % 100).alias("priority"))
    history = old.select(F.col("user_id").alias("profile"), F.col("event_type").alias("family"), F.when(F.col("value") < 30, 0).otherwise(1).alias("new_count"))
    return C.search_scores(candidates, history).select("event_id", F.col("score").cast("long").alias("score"))


@query("""
with o as (select user_id % 10 as host, user_id as profile, event_type as branch from events where event_id % 2 = 0), h as (select host, count(*) as n from o group by 1), p as (select profile, count(*) as n from o group by 1), b as (select branch, count(*) as n from o group by 1)
select event_id, cast(event_id % 90 - 5 * coalesce(h.n, 0) - 8 * coalesce(p.n, 0) - 2 * coalesce(b.n, 0) as bigint) as score from events left join h on h.host = user_id % 10 left join p on p.profile = user_id left join b on b.branch = event_type where event_id % 2 = 1""")
def task_score(spark, d):
    e = t(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("host"), F.col("user_id").alias("profile"), F.col("event_type").alias("branch"), (F.col("event_id") % 90).alias("priority"))
    return C.task_scores(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0")).select("event_id", F.col("score").cast("long").alias("score"))


@query("""
with r as (select user_id as profile, event_id as pos, event_id % 200 as sha, event_type as topic from events), f as (select *, row_number() over (partition by profile, sha order by pos) = 1 as fresh from r),
n as (select profile, topic, min(pos) as pos from f where fresh group by 1, 2)
select f.profile, f.pos, cast(case when fresh then 3 + 2 * coalesce(k, 0) else 0 end as bigint) as gain from f left join (select profile, pos, count(*) as k from n group by 1, 2) x on x.profile = f.profile and x.pos = f.pos""")
def gain_credit(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("profile"), F.col("event_id").alias("pos"), (F.col("event_id") % 200).alias("sha"), F.array("event_type").alias("topics"))
    return A.gain_credit(e)


@query("""
with x as (select user_id as profile, cast(event_id % 50 as varchar) as url, event_id % 97 as priority, event_id % 7 as depth, value > 50 as u from events)
select profile, url, max(priority) as priority, min(depth) as depth, bool_or(u) as parent_useful from x group by 1, 2""")
def frontier_enqueue(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("profile"), (F.col("event_id") % 50).cast("string").alias("url"), (F.col("event_id") % 97).alias("priority"), (F.col("event_id") % 7).alias("depth"), (F.col("value") > 50).alias("parent_useful"), "event_id")
    return C.enqueue(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id"))


@query("""
with c as (select user_id as profile, cast(event_id as varchar) as url, event_id % 31 as importance, user_id % 3 as have, value > 50 as ok from events), r as (select *, row_number() over (partition by profile order by importance desc, url) as n from c where ok)
select profile, url, importance from r where n <= greatest(0, 4 - have)""")
def greedy_acceptance(spark, d):
    c = t(spark, d, "events").select(F.col("user_id").alias("profile"), F.col("event_id").cast("string").alias("url"), (F.col("event_id") % 31).alias("importance"), (F.col("user_id") % 3).alias("have"), (F.col("value") > 50).alias("accepted"))
    return C.accept_up_to(c, 4).select("profile", "url", "importance")


@query("select n_name as \"group\", cast(1003 // 25 + case when n_nationkey < 1003 % 25 then 1 else 0 end as bigint) as share from nation")
def budget_shares(spark, d):
    return C.budget_shares(1003, t(spark, d, "nation").select(F.col("n_name").alias("group"), F.col("n_nationkey").alias("index")))


@query("select event_type, count(*) as requests, round(sum(value), 3) as busy, round(max(value), 3) as longest from events group by 1")
def strategy_totals(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("requests"), F.round(F.sum("value"), 3).alias("busy"), F.round(F.max("value"), 3).alias("longest"))


@query("""
select k as id, 'missing' as problem from (select distinct o_custkey as k from orders) where k not in (select c_custkey from customer where c_custkey % 2 = 0)
union all select c_custkey, 'foreign' from customer where c_custkey % 2 = 0 and c_custkey not in (select o_custkey from orders)""")
def set_cover(spark, d):
    parts = t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return R.set_cover(parts, t(spark, d, "orders").select(F.col("o_custkey").alias("id")), ["id"])


@query("""
select url, string_agg(stage, ',' order by stage) as stages from (select distinct cast(user_id as varchar) as url, event_type as stage from events) group by 1""")
def source_inventory(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), "event_type")
    return C.stages_of(e.withColumnRenamed("event_type", "stage")).withColumn("stages", F.array_join("stages", ","))


@query("select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as \"end\", event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")
def window_tumbling(spark, d):
    """The streaming plan run as a batch; tests run it as a stream."""
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = windowed_counts(e, "ts", "1 hour", "10 minutes", keys=["event_type"], value="value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
with h as (select o_orderkey, case when o_orderpriority = '1-URGENT' then 'urgent' end as a, case when o_totalprice > 300000 then 'large' end as b from orders)
select o_orderkey, array_to_string(list_filter([a, b], lambda x: x is not null), ',') as reasons from h where a is not null or b is not null""")
def review_reasons(spark, d):
    rows = C.review_reasons(t(spark, d, "orders"), {"urgent": F.col("o_orderpriority") == "1-URGENT", "large": F.col("o_totalprice") > 300000})
    return rows.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))
