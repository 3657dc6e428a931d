"""Merges of results into a target table, as joins.

Parquet views have no MERGE INTO; a merge is the new state of the target,
which the caller writes as a table of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_updates(target: DataFrame, source: DataFrame, key: str, keep_if_blank: list[str] = (), overwrite: list[str] = (), trim_overwrite: list[str] = ()) -> DataFrame:
    """Target rows, updated where ``source`` has their key; nothing is inserted.

    keep_if_blank: a blank source cell leaves the target's; overwrite: the
    source's cell whatever it is; trim_overwrite: the same, trimmed.
    """
    s = source.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in [*keep_if_blank, *overwrite, *trim_overwrite]))
    j = target.join(s, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    new = {c: F.coalesce(F.nullif(F.trim(f"_{c}"), F.lit("")), F.col(c)) for c in keep_if_blank}
    new |= {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in overwrite}
    new |= {c: F.when(hit, F.trim(f"_{c}")).otherwise(F.col(c)) for c in trim_overwrite}
    return j.select(*(new.get(c, F.col(c)).alias(c) for c in target.columns))
