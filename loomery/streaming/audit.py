"""Streams of records: audited as they arrive, counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomery.operators.issues import detect_issues


def issue_counts(records: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, code, records) of a stream of records; windows close ``late`` after the latest record seen."""
    audited = detect_issues(records).withWatermark(time, late)
    return audited.select(time, F.explode("issues").alias("code")).groupBy(F.window(time, window).alias("window"), "code").agg(F.count("*").alias("records"))


def audit_stream(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append record_id, issues of every record to Parquet under ``out``, exactly once."""
    audited = detect_issues(records).select("record_id", "issues")
    return audited.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()


def score_stream(records: DataFrame, out: str, checkpoint: str, apply) -> StreamingQuery:
    """Each micro-batch through a batch transform (scoring, clustering), written as a table of its own.

    A batch that is replayed after a failure overwrites its own folder, so rows
    are written once. Clusters are decided within a batch.
    """
    def write(batch: DataFrame, number: int) -> None:
        apply(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
