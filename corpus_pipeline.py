"""A corpus pipeline: toxicity, exact dedup, near dedup, decontamination, packing, each stage on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm.decontaminate import decontaminate
from kgspark.llm.exact_dedup import exact_dedup
from kgspark.llm.near_dedup import near_dedup
from kgspark.llm.packing import pack
from kgspark.llm.queries import CAPACITY, vocabulary
from kgspark.llm.toxicity import drop_toxic
from kgspark.shared import cut, table

#: Toxicity, near-duplicate groups and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score 0.5 and more. Null and empty texts are scored as empty; repeated rows share their fate;
    an empty table stays empty; other columns pass."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the row of the largest id of each group of equal texts. Null is the empty text; repeated rows leave one; an
    empty table stays empty; other columns pass."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the row of the least id of each group of near copies: five-word shingles, similarity of 0.8. Texts without words
    are one group; repeated rows leave one; an empty table stays empty; other columns pass."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of ten words of a benchmark item. Null and empty texts stay; repeated rows share
    their fate; an empty table stays empty; other columns pass."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of docs with its sequence and place. A null or empty text is one piece of length 1; repeated rows
    are packed each; an empty table gives an empty result; other columns are ignored."""
    return pack(docs, vocabulary("word_bpe_49k.json"), CAPACITY).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmark), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep; each stage is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
