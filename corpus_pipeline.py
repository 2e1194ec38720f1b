"""The corpus pipeline: from documents to packed training sequences.

Each stage works on all that its predecessor kept, written as Parquet and read again.  All but the last return
the columns of documents, whatever else those hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credence.llm import decontaminate, exact_dedup, langid, near_copies, packing
from credence.llm.catalog import tokenizer_path
from credence.llm.common import fresh_path, read_table, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Those without any letter (also null and empty texts) go, and those that no codeword is nearer to than to a text of which
    nothing is known.  Where no language could be learned, all with a letter stay.  Null and repeated ids are judged by their texts.
    """
    return langid.identified(docs, langid.train(docs))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies, whose 5-word shingles have a Jaccard similarity
    of at least 0.8; documents without an id stay."""
    return near_copies.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; each row is judged by its own text, so null and repeated ids lose no other text.

    Null and empty texts stay, and so do all rows if either table is empty.
    """
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"), whole_ids=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    Null and empty texts are the end id alone, null and repeated ids keep their rows, very long texts are cut into whole
    sequences, and an empty table gives no rows.
    """
    return packing.pack_tokens(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: The stages hash, train and tokenize, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):  # what a stage stored on the way goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
