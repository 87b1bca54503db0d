"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Toxic documents go; one document of each near-duplicate class stays; documents that hold a benchmark
item go; the rest is mixed to the target weights, rows repeated or left out as the mix says; the last
stage writes token ids to seekable files and returns what it reads back from them. A stage begins by letting
go of what the driver still holds of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dapple.llm.common import let_go, stash, table
from dapple.llm.decontam import drop_leaks
from dapple.llm.mixing import mix_rows
from dapple.llm.neardup import drop_near_duplicates
from dapple.llm.tokenbin import token_output
from dapple.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    return mix_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    return token_output(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token-ids", token_ids),
]

#: A trained classifier, edit distances and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
