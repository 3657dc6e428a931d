"""The training-data pipeline over ``documents``, one operator a stage.

Every stage takes all rows its predecessor kept and is written as Parquet in
the shared folder. Defined cases, in each stage: a null text is the empty one;
a null or repeated doc_id is a row like any other, told from others by its
text or a row number; of rows that are the same in all of doc_id, text and code
points one stays in exact dedup; extra columns go through untouched (names that
begin with ``_loomery_`` or ``_mix_`` are the package's own); an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomery.llm.exact_dedup import drop_exact_copies
from loomery.llm.mixing import taken_documents
from loomery.llm.near_dup import drop_near_copies
from loomery.llm.packing import pack
from loomery.llm.shared import scratch_path
from loomery.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return taken_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each taken row's bucket and batch."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mixing), ("packing", packing)]

#: Learned scores, MinHash classes and dynamic programming have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        path = scratch_path(spark, name)
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
