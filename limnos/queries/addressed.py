"""Files read by ranges and pages read with pushed filters, written from whole tables to the shared scratch folder first."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.session import read_table as t
from limnos.session import scratch
from limnos.sources import datasources as D

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _dbf_head(n):
    """A header of two fields, for fewer than 128 records."""
    field = lambda name, kind, size: name.ljust(11, "\0") + kind + "\0" * 4 + chr(size) + "\0" * 15
    before, after = "\x03\x18\x01\x01", "\0\0\0" + chr(97) + "\0" + chr(17) + "\0" * 21
    return F.concat(F.lit(before), F.char(n), F.lit(after + field("KEY", "C", 10) + field("SIZE", "N", 6) + "\r"))


@query("select p_partkey, p_size as size, p_partkey % 7 = 0 as deleted, lower(hex(lpad(cast(p_size as varchar), 6, ' '))) as raw, cast(p_partkey % 100 + 1 as bigint) as number from part")
def dbf_ranges(spark, d):
    """dBASE files of a hundred parts each, read forty records a task: text, deletion marks, raw bytes, record numbers."""
    D.register(spark)
    path = scratch(spark)
    record = F.concat(F.when(F.col("p_partkey") % 7 == 0, "*").otherwise(" "), F.rpad(F.col("p_partkey").cast("string"), 10, " "), F.lpad(F.col("p_size").cast("string"), 6, " "))
    files = t(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("g")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", record.alias("r")))).alias("r"))
    body = F.concat(_dbf_head(F.size("r")), F.array_join(F.transform("r", lambda x: x["r"]), ""))
    name = F.concat(F.floor(F.col("g") / 1000).cast("string"), F.lit("/"), F.col("g").cast("string"), F.lit(".dbf"))
    files.select(name.alias("name"), F.encode(body, "UTF-8").alias("body")).write.format("whole_files").mode("append").save(path)
    rows = spark.read.format("dbf").option("records", 40).load(path)
    return rows.select(F.col("fields.KEY").cast("long").alias("p_partkey"), F.col("fields.SIZE").cast("int").alias("size"), "deleted", F.col("numeric_hex.SIZE").alias("raw"), F.col("source_row_number").alias("number"))


def _pages(spark, d, path):
    """Suppliers as features, twenty a page, in two layers."""
    key = F.col("s_suppkey")
    feature = F.concat(F.lit('{"id":"s'), key.cast("string"), F.lit('","properties":{"nation":"'), F.col("s_nationkey").cast("string"), F.lit('","name":"'), F.col("s_name"), F.lit('"},"geometry":null}'))
    layer = F.when(key % 3 == 0, "rivers").otherwise("lakes")
    rows = t(spark, d, "supplier").select(layer.alias("layer"), (F.floor(key / 20) * 20).alias("start"), feature.alias("f"))
    pages = rows.groupBy("layer", "start").agg(F.concat(F.lit('{"features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    name = F.concat(F.lit("layer="), "layer", F.lit("/start="), F.col("start").cast("string"), F.lit("/page.json"))
    pages.select(name.alias("name"), F.encode("value", "UTF-8").alias("body")).write.format("whole_files").mode("append").save(path)
    return spark.read.format("captured_pages").option("key", "nation").load(path)


@query("select 's' || s_suppkey as feature_id, cast(s_nationkey as varchar) as nation, s_name as name, cast(floor(s_suppkey / 20) * 20 as bigint) as start from supplier where s_suppkey % 3 <> 0 and s_nationkey in (1, 4, 9, 16) and s_suppkey >= 20")
def paged_filters(spark, d):
    """Four nations' features of one layer beyond the first page: layer, start and key are judged in the source, and only the pages asked for are opened."""
    D.register(spark)
    pages = _pages(spark, d, scratch(spark))
    return pages.where("layer = 'lakes' and key in ('1', '4', '9', '16') and start >= 20").select("feature_id", F.col("key").alias("nation"), F.col("properties.name").alias("name"), "start")


@query("""
with p as (select case when s_suppkey % 3 = 0 then 'rivers' else 'lakes' end as layer, cast(floor(s_suppkey / 20) * 20 as bigint) as start, count(*) as n from supplier group by 1, 2),
r as (select *, coalesce(sum(n) over (partition by layer order by start rows between unbounded preceding and 1 preceding), 0) as reached from p), g as (select *, min(cast(start = reached as int)) over (partition by layer order by start) as joined from r)
select layer, count(*) as pages, cast(sum(n) as bigint) as features, cast(coalesce(sum(n) filter (joined = 1), 0) as bigint) as next_start, 0 as repeated, false as complete, layer = 'rivers' as drifted from g group by layer""")
def paged_state(spark, d):
    """Where each layer's capture would resume: pages hold fewer features than their offsets stand for, so it is at the first gap."""
    D.register(spark)
    pages = _pages(spark, d, scratch(spark))
    hits = pages.groupBy("layer").agg((F.count("*") + 1).alias("hits")).withColumn("seen_hits", F.col("hits") + (F.col("layer") == "rivers").cast("int"))
    return D.capture_state(pages, hits)
