"""Two runs of one batch compared by position.

Dense row numbers take two passes and no window over all rows: rows are
range-partitioned and sorted, each gets its place in its partition, and the
partitions' counts (one row each) become offsets.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.sources.scratch import staged

_IN_PARTITION = (1 << 33) - 1


def with_positions(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``position``, from 0, in the order of columns that tell its rows apart."""
    placed = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "placed")
    counts = placed.groupBy(F.shiftright("_place", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row a partition
    offsets = dict(zip((r["p"] for r in counts), accumulate((r["n"] for r in counts), initial=0)))
    table = df.sparkSession.createDataFrame([*offsets.items()], "_p long, _offset long")
    return placed.join(F.broadcast(table), F.shiftright("_place", 33) == F.col("_p")).withColumn("position", F.col("_offset") + F.col("_place").bitwiseAND(_IN_PARTITION)).drop("_place", "_p", "_offset")


def plain(c: Column) -> Column:
    """Null, blank and untidy values as the comparison sees them."""
    return F.coalesce(tx.clean_whitespace(c.cast("string")), F.lit(""))


def differences(before: DataFrame, after: DataFrame, aligned: str, columns: list[str]) -> DataFrame:
    """(position, column, before, after) of two runs with ``position``: a row for each column that
    differs, first of all ``aligned``, without which the rows aren't the same record; a row that only one run
    has differs in the column 'missing'."""
    values = lambda df, name: df.select("position", F.struct(*(F.col(c).cast("string").alias(c) for c in dict.fromkeys([aligned, *columns]))).alias(name))
    both = values(before, "x").join(values(after, "y"), "position", "full")
    one_side = F.col("x").isNull() | F.col("y").isNull()
    cell = lambda c, when: F.when(when, F.struct(F.lit(c).alias("column"), F.col(f"x.{c}").alias("before"), F.col(f"y.{c}").alias("after")))
    apart = plain(F.col(f"x.{aligned}")) != plain(F.col(f"y.{aligned}"))
    cells = [F.when(one_side, F.struct(F.lit("missing").alias("column"), F.col(f"x.{aligned}").alias("before"), F.col(f"y.{aligned}").alias("after"))), cell(aligned, ~one_side & apart)]
    cells += [cell(c, ~one_side & ~apart & (plain(F.col(f"x.{c}")) != plain(F.col(f"y.{c}")))) for c in columns if c != aligned]
    return both.select("position", F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))


def value_mapping(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(column, before, after, n): how often a value of a column became another, or stayed."""
    pairs = before.select("position", F.struct(*columns).alias("x")).join(after.select("position", F.struct(*columns).alias("y")), "position")
    cells = pairs.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"x.{c}").cast("string").alias("before"), F.col(f"y.{c}").cast("string").alias("after")) for c in columns))))
    return cells.groupBy("column", "before", "after").agg(F.count("*").alias("n"))


def compare_runs(before: DataFrame, after: DataFrame, order: list[str], aligned: str, values: list[str], mapped: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Differences, mapping and a one-row verdict (rows, differing_rows, differences, passed) of two runs."""
    a, b = staged(with_positions(before, order), "before"), staged(with_positions(after, order), "after")
    found = staged(differences(a, b, aligned, values), "differences")
    n = a.agg(F.count("*").alias("rows"))
    verdict = n.join(found.agg(F.count_distinct("position").alias("differing_rows"), F.count("*").alias("differences"))).withColumn("passed", F.col("differences") == 0)
    return found, value_mapping(a, b, mapped), verdict
