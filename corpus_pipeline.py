"""The corpus pipeline over ``documents``: filter, identify, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents. Models are fitted on the stage's own
input (labels come from ``sf_dir``), so a stage can run alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import langid, mixing, neardup, packing, quality
from maskwright.llm.common import crc_fold, materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score is at least 0.5; the others go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_fold(F.col("doc_id"), 3) != 1)
    return quality.keep_good(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, told with a probability of at least 0.5; the others go."""
    model = langid.fit(docs, crc_fold(F.col("doc_id"), 3) != 1, public_tokenizers.path("piece_bpe_32k.model"))
    return langid.keep_known(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates (five words, 0.8)."""
    return neardup.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a repeated document is a repeated row."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality classifier", quality_stage), ("language ID", language_stage), ("MinHash near-dedup", dedup_stage), ("mixing to target weights", mixing_stage), ("packing", packing_stage)]

#: Models and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each but the last is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
    return docs
