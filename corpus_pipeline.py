"""From raw documents to packed training sequences, stage by stage.

Every stage takes all rows that its predecessor kept. Between stages ``run`` writes the rows to
the shared checkpoint folder, so that a stage which reads its input more than once never
repeats the work of the stages before it, and a lost executor costs one stage at most.

Every stage takes null, empty and very long texts, repeated rows and columns of any name, as its operator
defines them; an empty table of documents gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limnos.llm.decontam import decontaminate
from limnos.llm.ngram_join import keep_one_of_each
from limnos.llm.packing import pack
from limnos.llm.quality import keep_good
from limnos.llm.suffix_dedup import cut_repeats
from limnos.session import cut_lineage, read_table

#: Least repeat that the pipeline cuts. A passage of over 50 words holds as much: 51 words of over three letters, with blanks.
PASSAGE_BYTES = 220


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and the fertility bands."""
    return keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of PASSAGE_BYTES or more that repeat."""
    return cut_repeats(docs, PASSAGE_BYTES)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: SQL can express neither the tokenizers nor the packing; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
