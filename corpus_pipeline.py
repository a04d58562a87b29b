"""Corpus pipeline: documents that are scored toxic go, one document of each group of near-copies
stays, documents that hold benchmark passages go, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns
a DataFrame; all but the last return the columns of ``docs``. All decisions are made for rows: rows
with a null doc_id or one that others have are judged by their own texts, and of repeated rows that
are copies of each other one stays. Rows without words are linked with nothing and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainproof.llm import decontaminate, neardup, packing, toxicity
from chainproof.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-copies, and those in no group."""
    return neardup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.kept(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
