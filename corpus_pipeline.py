"""Raw documents to token counts of a training corpus, in five stages.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
and read again as the next one's ``docs``. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wattframe.llm.bpe import bpe_digests
from wattframe.llm.common import stored
from wattframe.llm.exact_dedup import drop_exact_duplicates
from wattframe.llm.jaccard_join import drop_similar
from wattframe.llm.mixing import mix
from wattframe.llm.queries import BYTE_BPE, TARGETS, table
from wattframe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the largest id stays."""
    return drop_exact_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more the one with the least
    id stays."""
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages reach their share of the tokens. The floor of 1 means that rare
    languages are repeated, and no document is dropped for the mixture."""
    return mix(docs, table(spark, sf_dir, "labels"), TARGETS, floor=1.0)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as counts and digests."""
    return bpe_digests(docs, BYTE_BPE, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: A trained classifier and byte-level merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
