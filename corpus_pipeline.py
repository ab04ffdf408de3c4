"""The corpus pipeline: STAGES over documents, each written as Parquet and read again.

Each stage takes all rows its predecessor kept.  All but the last return the columns of
documents; the last returns the token ids of every row of the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, line_dedup, mixing, quality, simhash
from tessera.llm.frame import read
from tessera.plans.scratch import staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail a rule of the production policy go."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay where they occur first; texts without a line left go."""
    return line_dedup.deduplicated(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near duplicates stays."""
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; texts are repeated or cut where the mix asks for it."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and what they decode to."""
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("BPE encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs


#: Near-duplicate groups, shuffled queues and BPE have no SQL; the stages are tested one by one.
ORACLE_SQL = None
