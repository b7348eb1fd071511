"""A training corpus from ``documents``: quality, near-duplicates, secrets,
mixture and packing, each stage on all that the one before it kept.

Every stage but the last returns the columns of its input; each is written as
Parquet to the shared folder and read again for the next. The stages are
models and searches that SQL cannot express, so ORACLE_SQL is None and the
tests hold the pipeline against brute force.

Cases, stage by stage: a null or empty text scores as the classifier's bias,
so it stays or goes like any other (with no labels at all every score is 0.5
and all documents go); texts without words are no duplicates; a null text
stays null in the secret scan and packs as its end id alone. A text of any
length is taken whole in every stage. Rows are documents of their own: of rows
with equal or nearly equal texts one stays, and different texts under one
doc_id, or under none, all stay. Mixing repeats rows and drops none. An empty
table yields an empty table in every stage, and further columns of whatever
name pass through to mixing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm import ftrl_quality, minhash_bayes, pow2_pack, secret_forest, soft_mix
from keystrata.llm._common import materialize, table
from keystrata.llm.tokens import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ftrl_quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_bayes.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_forest.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return soft_mix.mixed(docs, table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pow2_pack.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
