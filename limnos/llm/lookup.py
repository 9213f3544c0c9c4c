"""Look-ups by a key that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot beyond this share of the rows, so there are at most SHARE hot keys, whatever the table.
SHARE = 1000


def look_up(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """``rows`` left-joined with ``table``, which holds each key once at most.

    Rows of a hot key meet its row by broadcast (SHARE rows at most) and are never shuffled;
    all others are shuffled by key. A row with a null among its keys finds nothing. ``rows`` is
    read several times, so it should be a stored table.
    """
    counts = rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n_rows"))
    total = rows.count()
    hot = F.broadcast(counts.where(F.col("n_rows") * SHARE > F.lit(total)).drop("n_rows"))
    known = rows.dropna(subset=list(keys))
    by_broadcast = known.join(F.broadcast(hot.join(table, list(keys), "left")), list(keys))
    by_shuffle = known.join(hot, list(keys), "left_anti").join(table, list(keys), "left")
    null = " or ".join(f"`{k}` is null" for k in keys)
    nothing = rows.where(null).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in keys))
    return by_shuffle.unionByName(by_broadcast).unionByName(nothing)
