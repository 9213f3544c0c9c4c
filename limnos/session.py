"""Session helpers shared by every operator."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the shared checkpoint folder that the cluster names.

    ``spark.checkpoint.dir`` is read from the session. A folder of our own is used only
    in local mode without the setting, as in tests; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "limnos-checkpoints"))


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does so only for plans that were collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the files."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    release_shuffles(spark)
    return out


def store(df: DataFrame) -> DataFrame:
    """As cut_lineage, for large tables: compressed Parquet in the shared checkpoint folder, deleted when the driver ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{context._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4()}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    schema = df.schema
    df.write.parquet(path.toString())
    del df
    release_shuffles(spark)
    return spark.read.schema(schema).parquet(path.toString())


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder, deleted when the driver ends."""
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{context._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4()}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
