"""A training-data pipeline over `documents`, made of five of the numbered operators.

Each stage is (name, function of (spark, docs, sf_dir)); it works on all that the one before it kept, and all
but the last return the columns of `documents`. There is no SQL for it: language ID and the memberships of
the mixing are learned, and differencing is iterative.

Nulls and ties, stage by stage: a null or letterless text is in no language and goes first; a null doc_id is a
document like any other, is never dropped as a near copy and sorts first in its shard; of rows that repeat doc_id and
text one stays; of near copies the one with the least doc_id stays, and rows of one doc_id with different texts are judged
each for itself; null lang, source or other columns are passed on. Empty tables give no rows, and an empty `labels` or
`benchmark` leaves the mixture as it is or nothing contaminated. Columns that are named like those that an operator adds keep
their own values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capquill.llm import decontamination, jaccard_join, language_id, mixing, sharding
from capquill.llm.common import cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with the calibrated confidence; rejected ones go."""
    model = language_id.learn(language_id.training_rows(docs))
    return language_id.accepted(docs, model)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says, once at least, by the target weights; as many words in all as that takes."""
    return mixing.resample(docs, mixing.domains_of(table(spark, sf_dir, "labels")), mixing.TARGETS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    return sharding.assign(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", decontaminate),
    ("source_mixing", mix_to_targets),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
