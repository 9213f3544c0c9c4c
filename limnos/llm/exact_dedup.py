"""Exact deduplication by a stateful stream.

The documents arrive as a file stream. A streaming aggregation keeps, in RocksDB on the
executors' disks and in the checkpoint, one entry per digest of the normalised text, without a
watermark and so without expiry: how many rows had it, and of the row to keep its code points,
its doc_id (the stable identifier) and its file and row number (the content locator). Batches
are pre-aggregated before their shuffle, so a text in a third of all rows is one entry a task.
The state can be kept: a later run with the same checkpoint reads new files only.

A digest with more than one row is a hit, and hits are checked on full bytes: a bit table of
fixed size, broadcast, finds the rows that may be hits; these are grouped by digest and whole
text, again pre-aggregated, so that of equal texts one leaves each task. A digest that turns
out to stand for several texts counts for nothing: its rows are grouped by their bytes.

DataFrame functions only; no Python worker runs.

Defined results: a null text is empty, and all texts without characters after normalising are
equal; of equal texts the one with the most code points stays, then the smallest doc_id (null
last), then the last place in the files, so of repeated rows exactly one stays; an empty table
gives an empty one; other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm.lookup import look_up
from limnos.session import scratch, store

#: Characters that do not count, a fixed value.
BLANKS = r"[\x20\x09-\x0D]+"
#: Bits of the table that finds rows which may be hits, as a power of two: 262,144 rows of 64 bits at most, at any size of the input.
FILTER_BITS = 24
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space is set aside
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256(normal: Column) -> Column:
    return F.unhex(F.sha2(normal, 256))


@dataclass(frozen=True)
class DedupState:
    """Documents seen so far, by digest, in the checkpoint of a streaming query."""

    spark: SparkSession
    checkpoint: str
    digest: Callable[[Column], Column] = sha256
    text_col: str = "text"
    id_col: str = "doc_id"

    def keyed(self, docs: DataFrame) -> DataFrame:
        """(doc_id, normal, digest, claim) of a table or stream of files. The largest claim of a group stays."""
        text = F.coalesce(docs[self.text_col].cast("string"), F.lit(""))
        normal = F.regexp_replace(text, BLANKS, "")
        doc_id, place = docs[self.id_col].cast("long"), docs.metadataColumn("_metadata")
        claim = F.struct(F.char_length(text).alias("n_chars"), F.bitwise_not(doc_id).alias("id"), place["file_path"].alias("file"), place["row_index"].alias("at"))
        return docs.select(doc_id.alias("doc_id"), normal.alias("normal"), self.digest(normal).alias("digest"), claim.alias("claim"))

    def absorb(self, path: str, files_per_batch: int | None = None, bytes_per_batch: str | None = None) -> None:
        """Take in all files under ``path`` that the state has not seen, in as many batches as the bounds ask for."""
        spark = self.spark
        source = spark.readStream.schema(spark.read.parquet(path).schema)
        source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
        source = source.option("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else source
        # the last letter as a class: a pattern also matches a single file
        keyed = self.keyed(source.parquet(f"{path[:-1]}[{path[-1]}]"))
        before = {k: spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            spark.conf.set(k, v)
        try:
            entries = keyed.groupBy("digest").agg(F.count("*").alias("n"), F.max("claim").alias("keep"))
            entries.writeStream.outputMode("update").format("noop").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start().awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def entries(self) -> DataFrame:
        """(digest, n, keep): the retained state."""
        state = self.spark.read.format("statestore").load(self.checkpoint)
        return state.select("key.digest", F.col("value.count").alias("n"), F.col("value.max").alias("keep"))


def _bit(digest: Column) -> Column:
    return F.shiftright(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), 32 - FILTER_BITS)


def by_bytes(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """(digest, normal, n) of all rows that may have a digest of ``hits(digest)``: the check on full bytes."""
    cell, bit = F.shiftright(_bit(F.col("digest")), 6), F.pmod(_bit(F.col("digest")), F.lit(64)).cast("int")
    table = hits.groupBy(cell.alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    found = keyed.withColumn("cell", cell).join(F.broadcast(table), "cell").where(F.getbit("bits", bit) == 1)
    return found.groupBy("digest", "normal").agg(F.count("*").alias("n"))


def verdicts(state: DedupState, docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of ``docs``, files that the state has taken in."""
    keyed = state.keyed(docs)
    kept = ("doc_id", "digest", "claim", "sha256")
    groups = store(state.entries().where("n > 1"))
    rows = store(keyed.withColumn("sha256", sha256(F.col("normal"))).select(*kept))
    clashing = store(by_bytes(keyed, groups.select("digest")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"))
    if not clashing.isEmpty():  # these rows go by their bytes: a key longer than any digest
        own = keyed.withColumn("sha256", sha256(F.col("normal"))).join(clashing, "digest")
        own = own.withColumn("digest", F.concat("digest", F.unhex(F.lit("00")), F.col("normal").cast("binary")))
        regrouped = own.groupBy("digest").agg(F.count("*").alias("n"), F.max("claim").alias("keep"))
        groups = store(groups.join(clashing, "digest", "left_anti").unionByName(regrouped))
        rows = store(rows.join(clashing, "digest", "left_anti").unionByName(own.select(*kept)))
    found = look_up(rows, groups, "digest")
    alone = F.col("keep").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.bitwise_not("keep.id"))
    return found.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("claim") == F.col("keep"))).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))


def exact_dedup(spark: SparkSession, path: str) -> DataFrame:
    """``verdicts`` on the rows of the Parquet files under ``path``, by a fresh state in the shared folder."""
    state = DedupState(spark, scratch(spark))
    state.absorb(path)
    return verdicts(state, spark.read.parquet(path))
