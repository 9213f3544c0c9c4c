"""Joins, keys, set operations and upserts that the data model is built with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.session import cut_lineage


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key, nulls included, does not exist yet; repeats within the input come once."""
    existing = existing.select(*[existing[k].alias(f"_{k}") for k in keys])
    on = reduce(lambda a, b: a & b, (incoming[k].eqNullSafe(existing[f"_{k}"]) for k in keys))
    return incoming.join(existing, on, "left_anti").dropDuplicates(keys)


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The table after inserting only new keys; columns that either side lacks become null."""
    return existing.unionByName(new_rows(incoming, existing, keys), allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], merge: dict[str, str] | None = None) -> DataFrame:
    """The table after an update: incoming rows win, but columns in ``merge`` keep their `max` or `min` of both."""
    merge = merge or {}
    rows = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    plain = [c for c in existing.columns if c not in keys and c not in merge]
    latest = F.max_by(F.struct(*plain) if plain else F.lit(1), "_new").alias("_row")
    out = rows.groupBy(*keys).agg(latest, *(getattr(F, how)(c).alias(c) for c, how in merge.items()))
    return out.select(*[(F.col(f"_row.{c}") if c in plain else F.col(c)).alias(c) for c in existing.columns])


def reset_state(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Sets columns where the condition holds."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def resolve(df: DataFrame, reference: DataFrame, keys: dict[str, str], value: str, alias: str, first_by: str | None = None) -> DataFrame:
    """Looks ``value`` up by null-safe keys {own column: reference column}; unknown keys give null.

    With ``first_by`` the reference may repeat keys: the first row in that order counts.
    """
    refs = list(keys.values())
    picked = reference.select(*refs, value, *([first_by] if first_by else []))
    picked = picked.groupBy(*refs).agg(F.min_by(value, first_by).alias(value)) if first_by else picked
    picked = picked.select(*[F.col(r).alias(f"_k{i}") for i, r in enumerate(refs)], F.col(value).alias(alias))
    on = reduce(lambda a, b: a & b, (df[k].eqNullSafe(picked[f"_k{i}"]) for i, k in enumerate(keys)))
    return df.join(picked, on, "left").drop(*[f"_k{i}" for i in range(len(refs))])


def either_key(df: DataFrame, column: str, ids: DataFrame, id_columns: list[str], value: str, alias: str) -> tuple[DataFrame, DataFrame]:
    """Resolves a code that may stand in any of several id columns: (rows, rows without a match)."""
    long = ids.select(value, F.explode(F.array(*id_columns)).alias("_id")).where("_id is not null").groupBy("_id").agg(F.min(value).alias(alias))
    joined = df.join(long, df[column] == long["_id"], "left").drop("_id")
    return joined, joined.where(F.col(alias).isNull() & F.col(column).isNotNull())


def top_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key; give a total order for a stable answer."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def ranked(df: DataFrame, keys: list[str], score: str, order: list[Column], n: int) -> DataFrame:
    """The best n per key with rank and, on rank 1, the margin over the second."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *order)
    out = df.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead(score).over(w))
    return out.withColumn("margin", F.when(F.col("rank") == 1, F.col(score) - F.coalesce("second", F.lit(0.0)))).drop("second").where(F.col("rank") <= n)


def dense_ids(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Distinct keys numbered from 1 in case-folded order.

    Rows are numbered within range partitions and shifted by the counts of those before, so no
    single task sorts the table; only one count per partition is gathered.
    """
    order = [c for k in keys for c in (F.lower(F.coalesce(F.col(k), F.lit(""))), F.col(k))]
    sorted_ = df.select(*keys).distinct().repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    # written once: a second evaluation could draw other range bounds
    local = cut_lineage(sorted_.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order))))
    shift = local.groupBy("_p").agg(F.max("_n").alias("_size"))
    shift = shift.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(shift.select("_p", "_before")), "_p").select((F.col("_n") + F.col("_before")).cast("long").alias(id_column), *keys)


def unpivot_measures(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Wide to long: (ids, position, parameter, unit, raw), for columns named `parameter [unit]`."""
    entries = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(c).alias("header"), F.col(f"`{c}`").cast("string").alias("raw")) for i, c in enumerate(values)))
    long = df.select(*ids, F.explode(entries).alias("e")).select(*ids, "e.*")
    pattern = r"^(.*?)\s*(?:\[(.*)\])?$"
    return long.select(*ids, "position", F.regexp_extract("header", pattern, 1).alias("parameter"), F.nullif(F.regexp_extract("header", pattern, 2), F.lit("")).alias("unit"), "raw")


def split_valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, issues): an issue per failed check, with the row as JSON."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    marked = df.withColumn("_failed", failed)
    issues = marked.where(F.size("_failed") > 0).select(F.explode("_failed").alias("issue"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
    return marked.where(F.size("_failed") == 0).drop("_failed"), issues


def set_cover(parts: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """What keeps parts from being an exact cover of the whole: (keys, problem) for missing, foreign and doubly covered keys."""
    counted = parts.groupBy(*keys).agg(F.count("*").alias("n"))
    missing = whole.select(*keys).distinct().join(counted, keys, "left_anti").withColumn("problem", F.lit("missing"))
    foreign = counted.join(whole.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("foreign").alias("problem"))
    return missing.union(foreign).union(counted.where("n > 1").select(*keys, F.lit("repeated").alias("problem")))
