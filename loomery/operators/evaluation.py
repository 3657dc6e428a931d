"""Accuracy of clusters, business risk, elections, run comparison and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_counts(rows: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Unordered pairs of rows with the same key, counted and not formed: n(n-1)/2 per group."""
    g = rows.filter(F.col(key).isNotNull()).groupBy(*(by or [key])).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))


def pairwise_metrics(rows: DataFrame, truth: str = "expected_cluster", predicted: str = "cluster_id", truth_routing: str | None = "expected_routing") -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall, F1 (0 where undefined).

    Pairs that agree in both keys are counted from the groups of the two keys
    together, so a cluster of any size costs one row.
    """
    t = F.col(truth) if truth_routing is None else F.when(F.col(truth_routing).isin("cluster", "manual_review"), F.col(truth))
    r = rows.select(t.alias("t"), F.col(predicted).alias("p"))
    both = pair_counts(r.filter("t is not null and p is not null").withColumn("k", F.lit(1)), "k", ["t", "p"]).withColumnRenamed("pairs", "tp")
    out = both.join(pair_counts(r, "t").withColumnRenamed("pairs", "ground_truth_pairs")).join(pair_counts(r, "p").withColumnRenamed("pairs", "predicted_pairs"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, q = rate(F.col("tp"), F.col("predicted_pairs")), rate(F.col("tp"), F.col("ground_truth_pairs"))
    return out.select(
        F.col("tp").alias("true_positives"), (F.col("predicted_pairs") - F.col("tp")).alias("false_positives"), (F.col("ground_truth_pairs") - F.col("tp")).alias("false_negatives"),
        F.bround(p, 4).alias("precision"), F.bround(q, 4).alias("recall"), F.bround(rate(2 * p * q, p + q), 4).alias("f1"), "ground_truth_pairs", "predicted_pairs")


def business_risk(rows: DataFrame) -> DataFrame:
    """(risk, row_id) of rows that would hurt: blocked wrongly, a second golden record, uncertainty made certain."""
    kinds = F.array(
        F.struct((F.col("expected_routing").eqNullSafe("unique") & F.col("is_golden_record").eqNullSafe(False)).alias("on"), F.lit("wrongful_block_candidates").alias("risk")),
        F.struct((F.col("expected_routing").eqNullSafe("cluster") & F.col("routing").eqNullSafe("unique")).alias("on"), F.lit("competing_goldens").alias("risk")),
        F.struct((F.col("expected_routing").eqNullSafe("manual_review") & F.col("election_status").eqNullSafe("proposed")).alias("on"), F.lit("uncertainty_upgrades").alias("risk")),
    )
    return rows.select("row_id", F.explode(F.filter(kinds, lambda k: k["on"])).alias("k")).select("k.risk", "row_id")


def election_metrics(rows: DataFrame) -> DataFrame:
    """One row: clusters, elections, rows under review, clusters that a tie-break decided."""
    c = rows.filter("cluster_id is not null")
    top = c.groupBy("cluster_id").agg(F.max("score").alias("top"))
    ties = c.join(top, "cluster_id").groupBy("cluster_id").agg(F.count_if(F.col("score") == F.col("top")).alias("n")).agg(F.count("*").alias("clusters"), F.count_if(F.col("n") >= 2).alias("tiebreak_decided"))
    counts = rows.agg(F.count_if(F.col("is_golden_record") & F.col("cluster_id").isNotNull()).alias("elections"), F.count_if(F.col("election_status") == "manual_review").alias("manual_review_rows"))
    return ties.join(counts).select("clusters", "elections", "manual_review_rows", "tiebreak_decided")


def same_value(a: Column, b: Column) -> Column:
    """Null and '' are one value; nothing else folds."""
    return F.coalesce(a.cast("string"), F.lit("")) == F.coalesce(b.cast("string"), F.lit(""))


def run_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, column, left_value, right_value) of cells that differ; column is ``*`` for rows on one side only."""
    columns = [c for c in left.columns if c != key and c in right.columns]
    j = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    one = F.col(f"l.{key}").isNull() | F.col(f"r.{key}").isNull()
    text = lambda c: F.col(c).cast("string")
    cells = [F.struct((~one & ~same_value(F.col(f"l.{c}"), F.col(f"r.{c}"))).alias("on"), F.lit(c).alias("column"), text(f"l.{c}").alias("left_value"), text(f"r.{c}").alias("right_value")) for c in columns]
    cells.append(F.struct(one.alias("on"), F.lit("*").alias("column"), text(f"l.{key}").alias("left_value"), text(f"r.{key}").alias("right_value")))
    found = j.select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), F.explode(F.filter(F.array(*cells), lambda c: c["on"])).alias("c"))
    return found.select(key, "c.column", "c.left_value", "c.right_value")


def compare_issues(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two audits (record_id, issues array) of one set of records.

    (per record: resolved, introduced, remaining; per segment: before, after,
    reduction in percent). Records on one side only are in neither.
    """
    j = before.select("record_id", F.col("issues").alias("b")).join(after.select("record_id", F.col("issues").alias("a")), "record_id")
    per = j.select("record_id", F.array_except("b", "a").alias("resolved"), F.array_except("a", "b").alias("introduced"), F.array_intersect("a", "b").alias("remaining"))
    side = lambda c: j.select(F.explode(c).alias("code"), F.lit(c).alias("side"))
    codes = side("b").unionByName(side("a")).withColumn("segment", segment_of(F.col("code")))
    totals = codes.groupBy("segment").agg(F.count_if(F.col("side") == "b").alias("before"), F.count_if(F.col("side") == "a").alias("after"))
    return per, totals.withColumn("reduction", F.when((F.col("segment") == "reduced") & (F.col("before") > 0), 100.0 * (F.col("before") - F.col("after")) / F.col("before")).otherwise(0.0))


def segment_of(code: Column) -> Column:
    """reduced (groups 1 to 5), persistent (group 6) or verification (group 7) of an issue code."""
    return F.when(code.isin("G2-VAL-001", "G2-VAL-003", "G2-VAL-006", "G2-NAME-012"), "persistent").when(code.startswith("G7"), "verification").otherwise("reduced")


def field_population(df: DataFrame) -> DataFrame:
    """(column, filled) for every column: cells that aren't blank, in one pass."""
    counted = df.agg(*[F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").alias(c) for c in df.columns])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in df.columns])).alias("x")).select("x.column", "x.filled")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """(size, groups): how many groups of equal keys have how many rows, two at least."""
    return df.groupBy(*keys).agg(F.count("*").alias("size")).filter("size > 1").groupBy("size").agg(F.count("*").alias("groups"))
