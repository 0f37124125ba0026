"""Training corpus: toxic, low-quality and near-duplicate documents go, repeated passages go, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.  Nulls, empty texts and repeated rows are treated as the
operators define it; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import harmonic_packing, quality_rules, simhash_balls, suffix_dedup, toxicity_crf
from tidewater.llm.common import saved, table
from tidewater.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go (operator 2)."""
    return toxicity_crf.keep_clean(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go (operator 5)."""
    return quality_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (operator 8)."""
    return simhash_balls.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 200-byte passages leave the texts (operator 4)."""
    return suffix_dedup.remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens (operator 3)."""
    return harmonic_packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality_rules", quality), ("simhash_near_dedup", near_duplicates),
          ("suffix_array_dedup", repeated_passages), ("packing", packing)]

#: Fitted models, token ids and suffix arrays are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
