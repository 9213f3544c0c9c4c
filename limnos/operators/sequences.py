"""Ordered operations: neighbours, islands, greedy folds, sliding rates. Every one works per key."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.session import store


def greedy_groups(df: DataFrame, keys: list[str], order: str, size: str, limit: int, alias: str = "group") -> DataFrame:
    """Numbers consecutive rows from 0 so that a group's sizes stay within the limit; a larger row stands alone.

    Rows are dealt by ranges of key and order, so a key spreads over as many ranges as it needs. For each
    range, Arrow functions over orders and sizes work out how it leaves its last group for every way to
    enter it; the driver follows these steps, a few figures a range, and each range is then numbered alone.
    """
    s = F.coalesce(F.col(size).cast("long"), F.lit(limit + 1)).alias("_s")
    dealt = df.select("*", s).repartitionByRange(*keys, order, "_s").sortWithinPartitions(*keys, order, "_s")
    rows = store(dealt.withColumns({"_p": F.spark_partition_id().cast("long"), "_i": F.monotonically_increasing_id()}))
    thin = rows.select("_p", "_i", "_s", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_k"))
    steps = thin.groupBy("_p").applyInArrow(lambda t: _steps(t, limit), "p long, first string, last string, total long, alone boolean, at array<long>, left array<long>, n array<long>")
    entries, key, left, n = {}, None, 0, 0
    for r in steps.orderBy("p").collect():
        same = r.first == key
        entries[r.p] = (same, left, n)
        if same and r.alone:
            j = bisect_right(r.at, limit - left)
            left, n = (r.left[j], n + r.n[j]) if j < len(r.at) else (left + r.total, n)
        else:
            left, n = r.left[0], r.n[0]
        key = r.last
    numbers = thin.groupBy("_p").applyInArrow(lambda t: _numbers(t, limit, entries), "_i long, _g long").withColumnRenamed("_g", alias)
    return rows.join(numbers, "_i").drop("_i", "_p", "_s")


def _range(table: pa.Table, limit: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A range in order: sums of sizes, sizes, ends of the rows' keys, and for each row where the next group begins if one begins there."""
    table = table.sort_by("_i")
    keys, sizes = table.column("_k").to_numpy(), table.column("_s").to_numpy()
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    end = np.repeat(ends, np.diff(ends, prepend=0))
    sums = np.cumsum(sizes)
    after = np.maximum(np.searchsorted(sums, sums - sizes + limit, "right"), np.arange(1, len(sums) + 1))
    return table, sums, sizes, end, np.minimum(after, end)


def _steps(table: pa.Table, limit: int) -> pa.Table:
    """How the range leaves its last group: its sum so far and the groups begun in its key, for each row (by sums up to it) where the first group may begin."""
    table, sums, sizes, end, after = _range(table, limit)
    size = len(sums)
    begins = int(np.flatnonzero(end == size)[0])
    alone = begins == 0
    after, left, n = after.tolist(), [0] * size, [0] * size
    for i in range(size - 1, begins - 1, -1):
        far = after[i] >= size
        left[i] = int(sums[-1] - sums[i] + sizes[i]) if far else left[after[i]]
        n[i] = 1 if far else n[after[i]] + 1
    last = int(np.searchsorted(sums, limit, "right")) + 1
    at = [i for i in range(min(last, size)) if i == 0 or sizes[i] > 0] if alone else [begins]
    row = {"p": table.column("_p")[0].as_py(), "first": table.column("_k")[0].as_py(), "last": table.column("_k")[-1].as_py(), "total": int(sums[-1]), "alone": alone, "at": [int(sums[i]) for i in at], "left": [left[i] for i in at], "n": [n[i] for i in at]}
    return pa.Table.from_pylist([row], pa.schema([("p", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("total", pa.int64()), ("alone", pa.bool_()), *((c, pa.list_(pa.int64())) for c in ("at", "left", "n"))]))


def _numbers(table: pa.Table, limit: int, entries: dict[int, tuple[bool, int, int]]) -> pa.Table:
    table, sums, _, end, after = _range(table, limit)
    same, left, n = entries[table.column("_p")[0].as_py()]
    i = min(int(np.searchsorted(sums, limit - left, "right")), int(end[0])) if same else 0
    begins = np.zeros(len(sums), np.int64)
    after = after.tolist()
    while i < len(after):
        begins[i] = 1
        i = after[i]
    counts = np.cumsum(begins)
    start = np.concatenate([[0], end[:-1][end[:-1] != end[1:]]]).astype(np.int64)
    base = np.repeat(np.where(start > 0, counts[start - 1], 0), np.diff(np.append(start, len(sums))))
    number = counts - base - 1 + np.where(end == end[0], n if same else 0, 0)
    return pa.table({"_i": table.column("_i"), "_g": pa.array(number)})


def neighbours(df: DataFrame, keys: list[str], order: str, text: str, limit: int = 2500) -> DataFrame:
    """previous and next text, where they are no longer than the limit."""
    w = Window.partitionBy(*keys).orderBy(order)
    short = lambda c: F.when(F.length(c) <= limit, c)
    return df.withColumn("previous", short(F.lag(text).over(w))).withColumn("next", short(F.lead(text).over(w)))


def islands(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: (keys, first, last, n)."""
    w = Window.partitionBy(*keys).orderBy(number)
    run = df.select(*keys, number).distinct().withColumn("_r", F.col(number) - F.row_number().over(w))
    return run.groupBy(*keys, "_r").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_r")


def continued_groups(df: DataFrame, keys: list[str], order: str, signature: str, alias: str = "table_group") -> DataFrame:
    """Rows go on with the group of the row before if their signature is the same."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (~F.coalesce(F.lag(signature).over(w).eqNullSafe(F.col(signature)), F.lit(False))) | (F.row_number().over(w) == 1)
    return df.withColumn("_new", new.cast("int")).withColumn(alias, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def sliding_count(df: DataFrame, keys: list[str], time: str, seconds: int, alias: str = "recent") -> DataFrame:
    """Rows of the key in the last so many seconds, this one included."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn(alias, F.count("*").over(w))


def plateaus(df: DataFrame, keys: list[str], order: str, gain: str, n: int) -> DataFrame:
    """plateau: this and the n - 1 rows before all gained nothing."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n + 1, 0)
    return df.withColumn("plateau", (F.count("*").over(w) == n) & (F.max(F.abs(gain)).over(w) == 0))


def failure_streaks(df: DataFrame, keys: list[str], order: str, failed: Column) -> DataFrame:
    """streak: failures in a row up to this one."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_f", failed.cast("int")).withColumn("_s", F.sum(F.lit(1) - F.col("_f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum("_f").over(Window.partitionBy(*keys, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("streak", streak.cast("long")).drop("_f", "_s")


def repeated_lines(df: DataFrame, keys: list[str], page: str, text: str, least: int = 3) -> DataFrame:
    """margin: the text stands on at least so many pages of the document. Counted by grouping, then joined."""
    often = df.groupBy(*keys, text).agg(F.countDistinct(page).alias("_n")).where(F.col("_n") >= least).select(*keys, text, F.lit(True).alias("margin"))
    return df.join(often, [*keys, text], "left").withColumn("margin", F.coalesce("margin", F.lit(False)))


def running_heading(df: DataFrame, keys: list[str], order: str, heading: str, alias: str = "section") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(alias, F.last(heading, ignorenulls=True).over(w))


def first_of_equal(df: DataFrame, keys: list[str], value: str, order: str, id_column: str, alias: str = "canonical_id") -> DataFrame:
    """The id of the first row with the same value within the key; blank values stand for themselves."""
    first = df.where(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(*keys, value).agg(F.min_by(id_column, order).alias(alias))
    return df.join(first, [*keys, value], "left").withColumn(alias, F.coalesce(alias, id_column))
