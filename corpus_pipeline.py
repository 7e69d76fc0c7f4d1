"""The corpus pipeline: documents without toxic ones, exact and near copies, mixed by source and packed into sequences.

Every stage takes any rows with the columns of documents: nulls in any column, empty and very long texts, repeated rows
and ids, empty tables, and further columns of any name, which stay with their rows up to packing. What each of these
gives is said by the operator that the stage names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, minhash, mixing, packing, toxicity
from tessera.llm.common import discard, remainder, settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that toxicity.without_toxic keeps: those that score under 0.7.

    Learns from the labels of documents that are still there and whose crc32 of the id, modulo 3, isn't 1.
    """
    held_out = remainder(F.col("doc_id"), 3) == 1
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), held_out=held_out)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text by exact_dedup.exact_dedup: that with the largest id; null and empty texts are one."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near group by minhash.near_dedup, over shingles of five words at 0.8: that with the smallest id."""
    return minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as mixing.mixed takes them for their source's target; texts without words are taken not at all or whole."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packing.pack in sequences of 2048 tokens; a row that is there twice is packed twice."""
    return packing.pack(docs, **packing.INSTRUCTIONS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the toxicity model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written and read again as the next one's documents.

    What a stage wrote on its way is deleted when its result is there, and that when the next stage's is.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        discard(before)
    packed = settled(spark, lambda: STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
    discard(docs)
    return packed
