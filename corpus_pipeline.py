"""A training-corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
An empty table gives an empty result in every stage, other columns are carried along, and very
long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clearbrook.llm import decontaminate, jaccard, mixing, quality, sharding
from clearbrook.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line rule keep, without their lines above the limit.

    Null, empty and blank texts go. Repeated rows stay repeated; rows without source are one host.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of smallest doc_id.

    Rows without doc_id come last; of repeated rows one stays. Texts without words are no group:
    one stays for each doc_id, and all without doc_id.
    """
    return jaccard.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with the benchmark.

    Null and empty texts are clean, and so are all with an empty benchmark. Repeated rows are judged alike.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its draw say.

    Texts without words are never taken. Rows without source are a source; rows without doc_id draw by their text.
    """
    return mixing.emit(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with shard, slot and the other columns of the assignment.

    Copies share a shard and have slots of their own; so do rows without doc_id. Columns of the
    input with the names of new ones are called input_ and their name.
    """
    return sharding.assign(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("sharding", shard)]

#: The verified overlaps of decontamination and the CRC-32 of sharding have no SQL here; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
