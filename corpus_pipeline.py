"""The corpus pipeline: quality, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns rows that are written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.

Defined results: rows are judged one by one, whatever their id, which may be null or repeat; a null or empty text has no words,
and the first stage rejects it; a table without rows, or of which a stage keeps none, gives an empty result; extra columns go
through all stages but the last, whatever their names. What each stage makes of ties, copies and very long texts is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, mixing, ngram_join, quality, toxicity
from brindle.llm.common import removed, stage_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that fail them. Null and empty texts go; repeated rows are
    judged alike, and all stay or all go; a very long line is one line."""
    return quality.keep(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of those that are left, does not call toxic. Without labels of both
    kinds it calls none so; a score of just a half is toxic; whole texts are scored, however long."""
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the smallest doc_id, nulls last; of rows that tie, the least by hashes of
    all columns; of rows equal in every column, one. Texts without words link with nothing."""
    return ngram_join.keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. A null source is one of its own; rows that share
    an id and a source are taken alike."""
    return mixing.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row: their number, and digests of the ids and of the bytes that they decode to. A row for each row."""
    return bpe.round_trip(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("ngram_jaccard_join", near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: No stage past the first is SQL: a classifier, a similarity join, a tokenizer. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = stage_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:  # what the stage has read is written anew
            removed(spark, before)
        before = folder
    return docs
