"""Scratch tables in the folder that driver and executors share, and keyed joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deleted by exact dedup, and what separates words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode, where it may be unset, a
    folder of our own. On a cluster a folder of this machine wouldn't be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomery-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomery/{name}-{uuid.uuid4().hex}"


#: Bytes of a row group of the tables we write: a task holds one in memory, with whole texts in it.
ROW_GROUP_BYTES = 16 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends
    there, so a lost executor costs only the tasks that ran on it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


#: A side of at most so many rows of a few short columns, or of so many bytes, is broadcast after it has been measured.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def checked_broadcast(small: DataFrame, most: int = BROADCAST_ROWS, of: Column | None = None) -> DataFrame:
    """``small``, a staged table, with a broadcast hint if its row count allows that
    and, where a column ``of`` gives a row's bytes, their sum does too."""
    rows, size = small.agg(F.count("*"), F.coalesce(F.sum(of if of is not None else F.lit(0)), F.lit(0))).first()
    return F.broadcast(small) if rows <= most and size <= BROADCAST_BYTES else small


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key isn't in ``dropped``, in a plan that shuffles
    the texts only when there are too many dropped keys to broadcast."""
    gone = checked_broadcast(stage(dropped.select(F.col(key).alias("_gone")).distinct(), "dropped"), of=F.lit(48))
    return docs.join(gone, docs[key].eqNullSafe(gone["_gone"]), "left_anti")
