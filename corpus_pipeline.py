"""A training corpus from raw documents: five stages, each applying one operator to what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared scratch
folder and reads it again as the next stage's docs. All but the last return the columns of documents. Decisions
are made on the stage's own input: the language dictionaries are learned from the documents that the
stage is given, near-duplicates are those among its rows, and so on.

Every stage takes any rows: null ids, texts, languages and sources, repeated rows, texts of any length, further columns of
whatever name (they stay), and an empty table, which stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortal.llm import decontaminate, language, minhash, mixing, tokens
from cohortal.llm.scratch import Scratch


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; a null text, one without a letter, or one between two languages goes.

    Repeated rows are judged alike; a null lang teaches nothing. Where no row has a lang, all go.
    """
    return language.keep_known(docs, language.learn(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (a Jaccard similarity of 0.8 or more): the one of smallest id.

    Rows with a null id or without words stay; rows that repeat an id are one document, whose rows stay or go together.
    """
    return minhash.keep_one(docs, 80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, as often as it takes them; rows without words give nothing, a null source is one too."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row, written in the binary format and read back; a null text is the end id alone."""
    return tokens.tokens_of(docs)


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token-ID output", token_stage),
]

#: Compression, sketches, edit distances and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")  # the stage after it has been written, or has written its files
    return docs
