"""A training-corpus pipeline of five stages; each takes the documents that the stage before kept.

Every stage takes whole texts, keeps the columns of its input under any names, and gives an empty result for an
empty input.  What it does with nulls, empty texts and repeated rows stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headway.llm import decontaminate, jaccard_join, language_id, line_runs, mixing
from headway.llm.shared import scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no text, no letter, or a score nearer to chance than to the labelled rows' least.

    Rows without id or language are judged like all others; repeated rows all stay or all go.
    """
    return language_id.accepted(spark, docs, language_id.fit(spark, docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines of 50 words or more go, and documents of which nothing is left.

    Null and empty texts stay as they are; rows of equal id and text are one document and stay alike; null ids come first.
    """
    return line_runs.dedup(spark, docs, 50)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8.

    Null and empty texts are in no group and stay; of rows of equal id and text one stays; null ids come last.
    """
    return jaccard_join.keep_one(spark, docs, 5, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go; null and empty texts stay; repeated rows stay or go alike."""
    return decontaminate.remove(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents in the mix's shards, repeats included; null and empty texts are never drawn; a null source is one of its own."""
    return mixing.mix(spark, docs)


STAGES = [("language ID", language), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing to target weights", mixture)]

#: Language ID has no SQL form; the whole is compared with a brute-force pipeline on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
