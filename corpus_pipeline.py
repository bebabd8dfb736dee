"""From raw documents to packed training sequences.

Each stage takes the documents that the stage before kept and calls one
operator of ``prosewright.llm``: documents judged low in quality go, repeated
lines are taken out of the texts, one document of each group of near
duplicates stays, documents that hold a benchmark item go, and what is left is
packed. All but the last return the columns of ``documents``. A stage has the
defined results of its operator for nulls, empty and long texts, ties, repeated
rows and extra columns; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm import decontamination, line_dedup, packing, quality, simhash
from prosewright.llm._common import Scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.score(model, F.col("text")) >= quality.THRESHOLD)


def single_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def single_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def unleaked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.vocabulary_path())


STAGES = [
    ("quality", good_documents),
    ("lines", single_lines),
    ("near_duplicates", single_documents),
    ("decontamination", unleaked_documents),
    ("packing", packed_pieces),
]

#: SQL cannot express the trained classifier; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each stage's result written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs)
            scratch.only(docs)
    return docs
