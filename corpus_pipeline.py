"""A cleaning pipeline over documents: STAGES in order, each over all that the one before kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows, no rows and columns of any name. All but
the last return the columns of its documents. A null text is an empty one. Rows without an id are kept by toxicity and
decontamination if their text is, by exact_dedup as the least id, by near_dedup always.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flatsql.llm import bpe, decontam, exact, jaccard, toxicity
from flatsql.llm.common import Scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model is fitted on docs and the labels of sf_dir. Repeated rows share their fate."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id; of rows that repeat both, one."""
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more), the document with the smallest doc_id.

    Candidates for a similarity of 0.8 lie some 10 bits of 64 apart, which the blocks of a SimHash do not reach; see jaccard.py.
    """
    return jaccard.drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages of sf_dir make up less than a twentieth. Repeated rows share their fate."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token count, with digests of its ids and of the bytes decoded from them."""
    return bpe.digests(docs)


STAGES = [("toxicity", toxic), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("bpe", encode)]

ORACLE_SQL = None  # SQL cannot express the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
