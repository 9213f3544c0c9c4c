"""Writers: data marts, JSON lines, publishing with validation, map geometry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions.values import csv_guard


def datamart_columns(df: DataFrame) -> list[Column]:
    nested = lambda kind: kind.startswith(("array", "map", "struct"))
    return [(F.to_json(F.col(f"`{c}`")) if nested(kind) else csv_guard(F.col(f"`{c}`")) if kind == "string" else F.col(f"`{c}`").cast("string")).alias(c) for c, kind in df.dtypes]


def write_datamart(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(*datamart_columns(df)).write.mode(mode).csv(path, sep=";", header=True, quoteAll=False, escape='"')


def canonical_json(df: DataFrame) -> DataFrame:
    """One JSON text per row with sorted keys, nulls written."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    canonical_json(df).write.mode(mode).text(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, checks: list[Callable[[dict[str, DataFrame]], DataFrame]]) -> None:
    """Write to `<path>_build`, run checks on what was written, then swap it in; a check with rows fails the build."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    build, old = path + "_build", path + "_old"
    fs.delete(at(build), True)
    for name, df in tables.items():
        df.write.parquet(f"{build}/{name}")
    written = {name: spark.read.parquet(f"{build}/{name}") for name in tables}
    for check in checks:
        bad = check(written).limit(5).collect()
        if bad:
            raise ValueError(f"the build fails a check, nothing was published: {bad}")
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(build), at(path))
    fs.delete(at(old), True)


def map_paths(points: DataFrame, width: float, height: float) -> DataFrame:
    """Scaled SVG paths per id of ``points(id, part, pos, x, y)``: one scale for all, the y axis turned down."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    k = F.least(F.lit(width) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0)), F.lit(height) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0)))
    scaled = points.join(F.broadcast(box)).select("id", "part", "pos", F.round((F.col("x") - F.col("x0")) * k, 2).alias("sx"), F.round((F.col("y1") - F.col("y")) * k, 2).alias("sy"))
    step = F.struct("pos", F.concat_ws(" ", F.col("sx").cast("string"), F.col("sy").cast("string")).alias("at"))
    parts = scaled.groupBy("id", "part").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["at"]).alias("a"))
    return parts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "a"))), lambda p: F.concat(F.lit("M"), F.array_join(p["a"], " L"))), " ").alias("d"))
