"""Mixing sources to target weights.

Word counts are summed per source, each source gets a target (its weight's
share of the whole, at most ``cap`` times its size, the excess reshared by
weight), and a document is taken ``floor(rate)`` times plus one more with
probability ``rate - floor(rate)``, decided by a hash of seed and doc_id, so
reruns agree on any cluster. Only one row per source meets in one place.

Defined cases: a null text has size 0; null is a source of its own, after all
others; a source or table without words has target 0 and is taken 0 times;
rows that repeat a doc_id are decided alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.shared import checked_broadcast, stage, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target of (source, source_size) rows.

    The end of resharing is ``min(cap * size, level * weight)`` with one level
    for all. In order of ``cap * size / weight`` the capped sources come first:
    a source is capped while its own level is at most what is left to share
    over the weights that are left.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    rows = rows.withColumn("whole", F.sum("source_size").over(everything) * F.lit(share)).withColumn("own_level", F.col("most") / F.col("weight"))
    before = Window.orderBy("own_level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("own_level", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("whole") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    rows = rows.withColumn("capped", F.col("own_level") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.struct((-F.col("own_level")).alias("k"), "level"))).over(everything)["level"]
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def decided(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """``rows`` (doc_id, source) with _mix_size (of the source), _mix_target, _mix_rate and _mix_copies."""
    t = checked_broadcast(targets.select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_size"), F.col("target").alias("_mix_target")))
    out = rows.join(t, rows["source"].eqNullSafe(F.col("_mix_source"))).drop("_mix_source")
    out = out.withColumn("_mix_rate", F.when(F.col("_mix_size") > 0, F.col("_mix_target") / F.col("_mix_size")).otherwise(0.0))
    chance = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(16**13)
    whole = F.floor("_mix_rate")
    return out.withColumn("_mix_copies", (whole + (chance < F.col("_mix_rate") - whole).cast("long")).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies of each row of ``docs`` (doc_id, text, source)."""
    sized = stage(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    targets = stage(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    out = decided(sized, targets, seed)
    return out.select("doc_id", "source", "size", F.col("_mix_size").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_rate").alias("rate"), F.col("_mix_copies").alias("copies"))


def taken_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken; texts aren't shuffled."""
    sizes = docs.groupBy("source").agg(F.sum(word_count()).alias("source_size"))
    taken = decided(docs, stage(source_targets(sizes, weights, share, cap), "targets"), seed).filter("_mix_copies > 0")
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*(docs[c] for c in docs.columns))
