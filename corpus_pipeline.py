"""The corpus pipeline: classify, dedupe, decontaminate, mix and shard the table ``documents``.

Each stage is a function of (spark, docs, folder) that works on all rows its predecessor kept. All but the last return
the columns of ``documents``; the last adds ``shard`` and ``slot``. Rows with null ids or texts, repeated rows, empty tables
and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesframe.llm.decontaminate import decontaminated
from seriesframe.llm.mixing import mixed_documents
from seriesframe.llm.near_dup import one_of_each
from seriesframe.llm.quality import good_documents
from seriesframe.llm.sharding import sharded_documents
from seriesframe.sources.files import settle


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    return good_documents(docs, _table(spark, folder, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group: the smallest id, documents without one last. Rows that share an id are told apart by their texts."""
    return one_of_each(docs, size=5, share=80)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, _table(spark, folder, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The sources in their target shares; a document comes once for each pass that takes words of it."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All rows of the mix, shuffled into shards."""
    return sharded_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained classifier and a seeded shuffle are no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
