"""A corpus through five operators: quality rules, toxicity, exact and near
deduplication, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the
one before kept; its result is written as Parquet to the shared folder and
read again.  All stages but the last return the columns of ``documents``.
Models are fitted on the labels of ``sf_dir`` and the stage's own documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import near_dedup, packing, quality, stream_dedup, toxicity
from skyledger.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stream_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("exact dedup", exact_dedup),
    ("near dedup", near_duplicates),
    ("packing", pack),
]
#: No SQL: models, sampling and packing have none; tests hold run() against the operators' brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
