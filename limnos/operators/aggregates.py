"""Rollups, profiles and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def summary(df: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """Count, least, mean and greatest value, first and last time by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("minimum"), F.avg(value).alias("average"), F.max(value).alias("maximum"), F.min(time).alias("first"), F.max(time).alias("last"))


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, non-null values, share filled; one pass."""
    counts = df.agg(F.count("*").alias("_rows"), *(F.count(c).alias(c) for c in df.columns))
    long = counts.select("_rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in df.columns))).alias("e"))
    return long.select("e.column", F.col("_rows").alias("rows"), "e.filled", (F.col("e.filled") / F.nullif(F.col("_rows"), F.lit(0))).alias("share"))


def fill_rates(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, filled, rows) for arbitrary presence tests."""
    counts = df.agg(F.count("*").alias("_rows"), *(F.count_if(ok).alias(name) for name, ok in fields.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), F.col("_rows").alias("rows")) for c in fields))).alias("e")).select("e.*")


def distinct_pivot(df: DataFrame, key: str, cycle: str, metrics: list[str], cycles: list) -> DataFrame:
    """Distinct members per key, cycle and metric, as columns `metric_cycle`; the cycles are given, so no extra pass."""
    columns = [F.countDistinct(F.when(F.col(cycle) == c, F.col(m))).alias(f"{m}_{c}") for m in metrics for c in cycles]
    return df.groupBy(key).agg(*columns)


def mean_of_means(df: DataFrame, entity: str, group: str, value: str) -> DataFrame:
    """Mean by entity, then mean of those by group."""
    inner = df.groupBy(group, entity).agg(F.avg(value).alias("m"))
    return inner.groupBy(group).agg(F.count("*").alias("entities"), F.avg("m").alias("mean"))


def counts_as_map(df: DataFrame, key: str, member: str) -> DataFrame:
    """Per key: total, distinct members sorted, and a map of member counts."""
    per = df.groupBy(key, member).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(member), F.col("n"))))
    return per.groupBy(key).agg(F.sum("n").alias("total"), entries.alias("e")).select(key, "total", F.transform("e", lambda x: x[member]).alias("members"), F.map_from_entries("e").alias("counts"))


def provenance(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(row)).alias("rows"))


def progress(df: DataFrame, topic: str, status: str, rows: str, expected: str, done: str = "done") -> DataFrame:
    """Jobs, rows and expected rows by topic and whether all are done and complete."""
    complete = F.every((F.col(status) == done) & (F.col(rows) == F.col(expected)))
    return df.groupBy(topic).agg(F.count("*").alias("jobs"), F.count_if(F.col(status) == done).alias("done"), F.coalesce(F.sum(rows), F.lit(0)).alias("rows"), F.coalesce(F.sum(expected), F.lit(0)).alias("expected"), complete.alias("complete"))


def minute_report(df: DataFrame, time: str, metrics: dict[str, Column], unit: str = "minute", keys: list[str] | None = None) -> DataFrame:
    """Metrics per time unit between the first and last, empty units included."""
    slot = F.date_trunc(unit, time)
    counted = df.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in metrics.items()))
    spine = df.agg(F.min(slot).alias("a"), F.max(slot).alias("z")).select(F.explode(F.sequence("a", "z", F.expr(f"interval 1 {unit}"))).alias("slot"))
    joined = spine.join(counted, "slot", "left")
    return joined.select("slot", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", *metrics)))


def throughput(df: DataFrame, start: str, end: str) -> DataFrame:
    """Requests, total and wall seconds, mean and median duration, and mean concurrency."""
    seconds = F.unix_micros(end) / 1e6 - F.unix_micros(start) / 1e6
    wall = (F.max(F.unix_micros(end)) - F.min(F.unix_micros(start))) / 1e6
    out = df.agg(F.count("*").alias("requests"), F.sum(seconds).alias("busy_s"), wall.alias("wall_s"), F.avg(seconds).alias("mean_s"), F.percentile(seconds, 0.5).alias("median_s"))
    return out.withColumn("concurrency", F.col("busy_s") / F.nullif(F.col("wall_s"), F.lit(0.0)))


def reconcile(parents: DataFrame, children: DataFrame, key: str, parent: str, count: str) -> DataFrame:
    """Parents whose count differs from their children's sum; a parent without children counts none."""
    sums = children.groupBy(F.col(parent).alias(key)).agg(F.sum(count).alias("children"))
    return parents.select(key, count).join(sums, key, "left").select(key, F.col(count).alias("expected"), F.coalesce("children", F.lit(0)).alias("found")).where("expected <> found")


def expected_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(table, expected, found) of every table whose size differs."""
    frames = [df.agg(F.count("*").alias("found")).select(F.lit(name).alias("table"), F.lit(expected[name]).cast("long").alias("expected"), "found") for name, df in tables.items() if name in expected]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.where("expected <> found")


def label_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity_type, entity_count) over tables."""
    frames = [df.agg(F.count("*").alias("entity_count")).select(F.lit(name).alias("entity_type"), "entity_count") for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def gain_credit(reviews: DataFrame, per_source: int = 3, per_topic: int = 2) -> DataFrame:
    """Credit per review of ``reviews(profile, pos, sha, topics array)``.

    The first review of a content within a profile earns per_source and per_topic for each topic
    new to the profile; repeats earn nothing. Firsts are found by grouping, so no window holds a profile.
    """
    first = reviews.groupBy("profile", "sha").agg(F.min("pos").alias("pos"))
    firsts = reviews.join(first, ["profile", "sha", "pos"])
    fresh = firsts.select("profile", "pos", F.explode("topics").alias("topic")).groupBy("profile", "topic").agg(F.min("pos").alias("pos")).groupBy("profile", "pos").agg(F.count("*").alias("topics_new"))
    credit = firsts.select("profile", "pos").distinct().join(fresh, ["profile", "pos"], "left").select("profile", "pos", (F.lit(per_source) + per_topic * F.coalesce("topics_new", F.lit(0))).cast("long").alias("gain"))
    return reviews.select("profile", "pos").join(credit, ["profile", "pos"], "left").select("profile", "pos", F.coalesce("gain", F.lit(0)).alias("gain"))


def term_statistics(texts: DataFrame, terms: list[str]) -> DataFrame:
    """Per row of ``texts(id, text)``: distinct terms found, total hits, and a bucket; terms are a stated list."""
    low = F.lower("text")
    hits = [((F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / len(t)).cast("long") for t in terms]
    rows = texts.select("id", F.array(*hits).alias("h"))
    distinct = F.size(F.filter("h", lambda x: x > 0))
    bucket = F.when(distinct == 0, "none").when(distinct <= 2, "few").otherwise("many")
    return rows.select("id", distinct.alias("distinct_terms"), F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x).alias("hits"), bucket.alias("bucket"))


def possible_duplicates(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(id_column)).alias("ids")).where(F.size("ids") > 1)


def duplicate_rows(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """(keys, id, n) of every row whose keys repeat, with the number of such rows; no row holds a group."""
    often = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return df.select(*keys, id_column).join(often, keys)


def last_in_order(df: DataFrame, keys: list[str], value: str, order: str, alias: str) -> DataFrame:
    """Running last non-null value in order, per key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(alias, F.last(value, ignorenulls=True).over(w))


def frequency_table(df: DataFrame, name: str, code: str, count: str, place: str) -> DataFrame:
    """Rows of a summary with their place: most frequent first, then by name, those with an empty code last."""
    empty = F.coalesce(F.col(code), F.lit("")) == ""
    return df.withColumn(place, F.row_number().over(Window.orderBy(empty, F.desc(count), name)))


def manifest_counters(df: DataFrame, by: str, review: Column) -> DataFrame:
    """Per class the rows and those for review; null counts as not for review."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(review).alias("for_review"))
