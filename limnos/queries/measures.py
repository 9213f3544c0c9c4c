"""Summaries, rankings, cleaning, pivots over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import text as T
from limnos.functions import values as V
from limnos.operators import aggregates as A
from limnos.operators import relational as R
from limnos.session import read_table as t

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("""
select s_suppkey, s_name, p_brand, count(*) as n, min(l_quantity) as minimum, round(avg(l_quantity), 4) as average, max(l_quantity) as maximum,
       cast(min(l_shipdate) as timestamp) as first, cast(max(l_shipdate) as timestamp) as last
from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
group by s_suppkey, s_name, p_brand order by n desc, s_suppkey, p_brand limit 1000""")
def summary_measurement(spark, d):
    """Count, range and mean per entity and parameter; the dimensions are narrow, so facts shuffle once, after partial aggregation."""
    facts = A.summary(t(spark, d, "lineitem").join(t(spark, d, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey")), ["l_suppkey", "p_brand"], "l_quantity", "l_shipdate")
    named = facts.join(t(spark, d, "supplier").select("s_suppkey", "s_name"), F.expr("l_suppkey = s_suppkey"))
    out = named.select("s_suppkey", "s_name", "p_brand", "n", "minimum", F.round("average", 4).alias("average"), "maximum", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))
    return out.orderBy(F.desc("n"), "s_suppkey", "p_brand").limit(1000)


@query("select s_suppkey, s_name, round(s_acctbal / 100.0, 4) as area_km2 from supplier where s_acctbal is not null order by s_acctbal desc, s_suppkey limit 20")
def rank_largest(spark, d):
    s = t(spark, d, "supplier").where("s_acctbal is not null").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20)
    return s.select("s_suppkey", "s_name", F.round(V.hectares_to_km2(F.col("s_acctbal")), 4).alias("area_km2"))


@query("select c_custkey, c_name, c_acctbal from customer where c_acctbal is not null order by c_acctbal desc, c_custkey limit 20")
def rank_deepest(spark, d):
    return t(spark, d, "customer").where("c_acctbal is not null").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", "c_name", "c_acctbal")


@query("""
with st as (select o_custkey, count(*) as orders, count(*) filter (where o_orderstatus = 'F') as failed, string_agg(distinct o_orderpriority, '|' order by o_orderpriority) as codes from orders group by o_custkey)
select c_custkey, cast(coalesce(orders, 0) as bigint) as status_count, cast(coalesce(failed, 0) as bigint) as failed_count, coalesce(codes, '') as codes, round(m.mean, 4) as segment_mean
from customer left join st on o_custkey = c_custkey left join (select c_mktsegment as seg, avg(c_acctbal) as mean from customer group by 1) m on m.seg = c_mktsegment""")
def relation_status_assessment(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    st = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("codes"))
    means = c.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.avg("c_acctbal").alias("mean"))
    j = c.join(st, c.c_custkey == st.o_custkey, "left").join(means, F.expr("seg = c_mktsegment"), "left")
    return j.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("status_count"), F.coalesce("failed", F.lit(0)).alias("failed_count"), F.coalesce("codes", F.lit("")).alias("codes"), F.round("mean", 4).alias("segment_mean"))


@query("""
select c_custkey, 'direkt' as derivation, o_orderstatus as status, cast(null as varchar) as via from customer join orders on o_custkey = c_custkey where o_totalprice > 300000
union all
select s_suppkey, 'abgeleitet', p_type, n_name from supplier join nation on n_nationkey = s_nationkey join lineitem on l_suppkey = s_suppkey join part on p_partkey = l_partkey where l_quantity >= 50 and p_size >= 45""")
def status_union(spark, d):
    direct = t(spark, d, "orders").where("o_totalprice > 300000").join(t(spark, d, "customer"), F.expr("o_custkey = c_custkey")).select("c_custkey", F.lit("direkt").alias("derivation"), F.col("o_orderstatus").alias("status"))
    lines = t(spark, d, "lineitem").where("l_quantity >= 50").join(t(spark, d, "part").where("p_size >= 45"), F.expr("l_partkey = p_partkey"))
    derived = lines.join(t(spark, d, "supplier"), F.expr("l_suppkey = s_suppkey")).join(t(spark, d, "nation"), F.expr("n_nationkey = s_nationkey")).select(F.col("s_suppkey").alias("c_custkey"), F.lit("abgeleitet").alias("derivation"), F.col("p_type").alias("status"), F.col("n_name").alias("via"))
    return direct.unionByName(derived, allowMissingColumns=True)


@query("select o_orderkey, c_name, year(o_orderdate) as year, coalesce(nullif(o_orderstatus, 'O'), o_orderpriority) as value from orders left join customer on c_custkey = o_custkey")
def assessment_list(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer").select("c_custkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "c_name", F.year("o_orderdate").cast("long").alias("year"), F.coalesce(F.nullif("o_orderstatus", F.lit("O")), "o_orderpriority").alias("value"))


@query("select 'customer' as entity_type, count(*) as entity_count from customer union all select 'orders', count(*) from orders union all select 'lineitem', count(*) from lineitem union all select 'part', count(*) from part")
def overview_counts(spark, d):
    return A.label_counts({n: t(spark, d, n) for n in ("customer", "orders", "lineitem", "part")})


@query("""
with per as (select p_brand, l_partkey, avg(p_size) as m from lineitem join part on l_partkey = p_partkey where p_size between 1 and 40 group by p_brand, l_partkey)
select p_brand, count(*) as entities, round(avg(m), 4) as mean from per group by p_brand""")
def group_mean_of_means(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "part").where("p_size between 1 and 40"), F.expr("l_partkey = p_partkey"))
    return A.mean_of_means(j, "l_partkey", "p_brand", "p_size").select("p_brand", "entities", F.round("mean", 4).alias("mean"))


@query("""
with v as (select l_orderkey, l_linenumber, case when l_quantity = 50 then 999 else l_quantity / 8.0 end as q from lineitem)
select coalesce(case when q = 999 then 'sentinel' when q not between 1 and 5 then 'out of scale' end, 'valid') as reason, count(*) as n, round(sum(case when q <> 999 and q between 1 and 5 then q end), 4) as total from v group by 1""")
def validity_classify(spark, d):
    q = F.when(F.col("l_quantity") == 50, 999.0).otherwise(F.col("l_quantity") / 8.0)
    v = t(spark, d, "lineitem").select(V.validity(q).alias("v"))
    return v.groupBy(F.coalesce("v.reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("v.value"), 4).alias("total"))


@query("select p_partkey, '<=' as operator, round(p_retailprice, 1) as value, 'mg' as unit, case when p_size % 2 = 0 then '<' end as qualifier, p_size / 10.0 as qualified from part")
def qualifier_parse(spark, d):
    """German quantities are written from numbers and parsed back."""
    p = t(spark, d, "part")
    written = F.concat(F.lit("<= "), T.german_number(F.round("p_retailprice", 1), 1), F.lit(" mg"))
    short = F.concat(F.when(F.col("p_size") % 2 == 0, "< ").otherwise(""), F.replace((F.col("p_size") / 10.0).cast("string"), F.lit("."), F.lit(",")))
    return p.select("p_partkey", V.quantity(written).alias("q"), V.qualified(short).alias("v")).select("p_partkey", "q.operator", "q.value", "q.unit", "v.qualifier", F.col("v.value").alias("qualified"))


@query("select o_orderkey, cast(o_orderdate as date) as day, true as partial_ok, case when o_orderkey % 2 = 0 then true else false end as reversed from orders")
def date_multi_parse(spark, d):
    o = t(spark, d, "orders")
    kinds = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy HH:mm", "dd.MM.yyyy")
    text = F.element_at(F.array(*(F.date_format(F.col("o_orderdate").cast("timestamp"), k) for k in kinds)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    month = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM")
    end = F.when(F.col("o_orderkey") % 2 == 0, "1900-01-01").otherwise("2900")
    return o.select("o_orderkey", V.date_of(text).alias("day"), V.partial_date_valid(month).alias("partial_ok"), V.interval_reversed(month, end).alias("reversed"))


@query("""
select c_custkey, cast(c_custkey as varchar) as key, lower(c_name) as norm, regexp_replace(c_name, '[^0-9]', '', 'g') as digits,
       case when c_custkey % 3 = 0 then true when c_custkey % 3 = 1 then false end as flag,
       length(c_name) || ':' || c_name || '|' || length(cast(c_nationkey as varchar)) || ':' || c_nationkey as composite from customer""")
def key_normalise(spark, d):
    c = t(spark, d, "customer")
    code = F.element_at(F.array(F.lit("Ja"), F.lit("n"), F.lit("?")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select("c_custkey", T.key_text(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".0"))).alias("key"), T.collapse_norm(F.concat(F.lit(" "), "c_name", F.lit(" ."))).alias("norm"), T.digits(F.col("c_name")).alias("digits"), V.tri_state(code).alias("flag"), T.composite_key(F.col("c_name"), F.col("c_nationkey")).alias("composite"))


@query("select cast(row_number() over (order by lower(p_type), p_type, lower(p_brand), p_brand) as bigint) as parameter_id, p_type, p_brand from (select distinct p_type, p_brand from part)")
def dim_parameter_ids(spark, d):
    return R.dense_ids(t(spark, d, "part"), ["p_type", "p_brand"], "parameter_id")


@query("select l_partkey as p_partkey, l_suppkey as s_suppkey, arg_min(l_extendedprice, row(l_orderkey, l_linenumber, l_extendedprice)) as first_price from lineitem group by 1, 2")
def lookup_first_match(spark, d):
    """The first price of every pair that lineitem holds."""
    lines = t(spark, d, "lineitem").withColumn("pos", F.struct("l_orderkey", "l_linenumber", "l_extendedprice"))
    pairs = lines.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    return R.resolve(pairs, lines, {"p_partkey": "l_partkey", "s_suppkey": "l_suppkey"}, "l_extendedprice", "first_price", "pos")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_new_rows(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    return R.new_rows(c, t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def semi_valid_refs(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("""
with x as (select c_custkey % 700 as k, cast(max(c_acctbal) as double) as v, min(c_nationkey) as n from customer group by 1), y as (select c_custkey % 900 as k, max(c_acctbal) + 1 as v, max(c_nationkey) as n from customer where c_custkey % 3 = 0 group by 1)
select coalesce(x.k, y.k) as k, greatest(x.v, y.v) as v, coalesce(y.n, x.n) as n from x full join y on x.k = y.k""")
def upsert_merge(spark, d):
    c = t(spark, d, "customer")
    old = c.groupBy((F.col("c_custkey") % 700).alias("k")).agg(F.max("c_acctbal").alias("v"), F.min("c_nationkey").alias("n"))
    new = c.where("c_custkey % 3 = 0").groupBy((F.col("c_custkey") % 900).alias("k")).agg((F.max("c_acctbal") + 1).alias("v"), F.max("c_nationkey").alias("n"))
    return R.upsert(old, new, ["k"], {"v": "max"})


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n = 1")
def lateral_top1(spark, d):
    return R.top_one(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("""
select l_orderkey, l_linenumber, l_partkey, 0 as position, 'quantity' as parameter, 'pcs' as unit, cast(cast(l_quantity as bigint) as varchar) as raw from lineitem
union all select l_orderkey, l_linenumber, l_partkey, 1, 'line', null, cast(l_linenumber as varchar) from lineitem""")
def unpivot_observations(spark, d):
    wide = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("quantity [pcs]"), F.col("l_linenumber").alias("line"))
    return R.unpivot_measures(wide, ["l_orderkey", "l_linenumber", "l_partkey"], ["quantity [pcs]", "line"])


@query("select event_type, cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1, 2")
def json_project(spark, d):
    return t(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""
select 'c_name' as "column", count(*) as rows, count(c_name) as filled, 1.0::double as share from customer union all
select 'c_positive', count(*), count(case when c_acctbal > 0 then 1 end), round(count(case when c_acctbal > 0 then 1 end) / count(*), 6) from customer""")
def profile_nonnull(spark, d):
    c = t(spark, d, "customer").select("c_name", F.when(F.col("c_acctbal") > 0, 1).alias("c_positive"))
    return A.profile(c).withColumn("share", F.round("share", 6))


@query("""
select l_suppkey, count(distinct case when year(l_shipdate) = 1995 then l_partkey end) as l_partkey_1995, count(distinct case when year(l_shipdate) = 1996 then l_partkey end) as l_partkey_1996,
       count(distinct case when year(l_shipdate) = 1995 then l_orderkey end) as l_orderkey_1995, count(distinct case when year(l_shipdate) = 1996 then l_orderkey end) as l_orderkey_1996 from lineitem group by l_suppkey""")
def count_distinct_pivot(spark, d):
    return A.distinct_pivot(t(spark, d, "lineitem").withColumn("y", F.year("l_shipdate")), "l_suppkey", "y", ["l_partkey", "l_orderkey"], [1995, 1996])


@query("""
with per as (select s_nationkey, l_returnflag, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2)
select s_nationkey, cast(sum(n) as bigint) as total, string_agg(l_returnflag || '=' || n, ',' order by l_returnflag) as counts from per group by 1""")
def rollup_counts_map(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.expr("l_suppkey = s_suppkey"))
    out = A.counts_as_map(j, "s_nationkey", "l_returnflag")
    return out.select("s_nationkey", "total", F.array_join(F.transform("members", lambda m: F.concat(m, F.lit("="), F.element_at("counts", m).cast("string"))), ",").alias("counts"))


@query("""
select o_orderpriority as topic, count(*) as jobs, count(*) filter (where o_orderstatus = 'F') as done, cast(sum(o_custkey) as bigint) as rows, cast(sum(o_custkey + case when o_orderkey % 7 = 0 then 1 else 0 end) as bigint) as expected, false as complete from orders group by 1""")
def progress_report(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("topic"), "o_orderstatus", F.col("o_custkey").alias("r"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("e"))
    return A.progress(o, "topic", "o_orderstatus", "r", "e", "F")


@query("select p_brand, p_type, count(*) as n from part group by 1, 2 having count(*) > 1")
def dup_groups(spark, d):
    return A.duplicate_groups(t(spark, d, "part"), ["p_brand", "p_type"])


@query("""
with i as (select p_partkey, p_retailprice > 1000 as a, p_size < 45 as b from part)
select case when not a then 'price' end as issue, count(*) as n from i where not a group by 1 union all select 'size', count(*) from i where not b""")
def issue_log(spark, d):
    _, issues = R.split_valid(t(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), {"price": F.col("p_retailprice") > 1000, "size": F.col("p_size") < 45})
    return issues.groupBy("issue").agg(F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, case when left(l_returnflag || l_linestatus, 1) = 'A' then '''=A' else l_returnflag end as cell, count(*) as n from lineitem group by 1, 2, 3")
def safe_csv_cells(spark, d):
    cell = V.csv_guard(F.when(F.col("l_returnflag") == "A", "=A").otherwise(F.col("l_returnflag")))
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", cell.alias("cell")).agg(F.count("*").alias("n"))
