"""Tables written once in the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` as Parquet under the cluster's ``spark.checkpoint.dir``: lineage ends there,
    so a lost executor costs only the tasks that ran on it. In local mode, where the
    setting may be missing, a folder of our own is set."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="loomery-shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/loomery/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
