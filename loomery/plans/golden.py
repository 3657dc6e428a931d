"""Golden-record queries on customer, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import scoring

#: The tables' years instead of the default ones.
WEIGHTS = scoring.WEIGHTS | {k: {"2001": 20, "2000": 15, "1999": 10, "1998": 5} for k in ("sales_order_last_used", "sales_order_partner_last_used")}
GROUPS = {"AUTOMOBILE": "DRIT", "BUILDING": "0002", "FURNITURE": "0003", "HOUSEHOLD": "mlief", "MACHINERY": "ZZZZ"}


def score_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records to score: years and counts from their orders, equipment
    from their line items, clusters of same nation, segment and key mod 9."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    orders = read("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").withColumn("y", F.year("o_orderdate"))
    by_year = orders.groupBy("o_custkey", "y").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    years = by_year.groupBy("o_custkey").agg(
        F.max(F.struct("y", "n")).alias("own"), F.max(F.when(F.col("u") > 0, F.struct("y", "u"))).alias("partner"))
    items = read("lineitem", "l_orderkey", "l_returnflag").filter("l_returnflag = 'R'")
    equipment = items.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("equipment"))
    c = read("customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment").join(years.withColumnRenamed("o_custkey", "_y"), F.col("c_custkey") == F.col("_y"), "left").join(equipment.withColumnRenamed("o_custkey", "_e"), F.col("c_custkey") == F.col("_e"), "left")
    key, bal = F.col("c_custkey"), F.col("c_acctbal")
    group = F.lit(None).cast("string")
    for k, v in GROUPS.items():
        group = F.when(F.col("c_mktsegment") == k, v).otherwise(group)
    return c.select(
        key.cast("string").alias("row_id"),
        F.when(key % 7 != 0, F.concat_ws("-", F.lit("k"), F.col("c_nationkey").cast("string"), F.substring("c_mktsegment", 1, 2), (key % 9).cast("string"))).alias("cluster_id"),
        F.when(key % 31 == 0, "manual_review").otherwise("cluster").alias("routing"),
        F.when(key % 13 == 0, F.lit(0.9)).otherwise(F.lit(0.97)).alias("confidence"),
        F.when(key % 17 == 0, "Split: should not be merged").alias("reasoning"),
        F.when(key % 53 == 0, "n/a").otherwise(F.col("own.y").cast("string")).alias("last_order_year"),
        F.col("own.n").cast("string").alias("orders_in_last_used_year"),
        F.col("partner.y").cast("string").alias("partner_last_order_year"),
        F.col("partner.u").cast("string").alias("partner_orders_in_last_used_year"),
        F.concat(F.col("equipment").cast("string"), F.lit(".0")).alias("equipment_count"),
        F.when(bal > 5000, "no").when(bal > 1000, "3-4").when(bal > 0, ">5").when(bal > -500, "?").alias("sleeping_band"),
        F.when(bal < 0, " Blocked").otherwise("active").alias("customer_status"),
        group.alias("account_group"),
        F.when(key % 4 > 0, F.array_join(F.transform(F.sequence(F.lit(1), (key % 4).cast("int")), lambda k: F.concat(F.lit("10"), k.cast("string"))), "; ")).alias("company_code_consolidated"),
        F.when(key % 3 == 0, "S1;S2;").alias("sales_org_consolidated"),
        F.when(key % 5 == 0, "0015").alias("sf1"), F.when(key % 10 == 0, "0016").alias("sf2"), F.when(key % 11 == 0, " ").alias("sf3"),
    )


def score_rows(spark, sf_dir):
    s = scoring.score_rows(score_inputs(spark, sf_dir), WEIGHTS)
    return s.select("row_id", "cluster_id", "score", "sales_order_count", "sales_order_partner_count", "equipment_count_points", "sleeping_customer", "customer_status_points", "account_group_points", "company_code_count", "combined_presence_bonus", "salesforce_instance_count", F.size("warnings").alias("n_warnings"))


def elect_golden(spark, sf_dir):
    e = scoring.elect_golden(score_inputs(spark, sf_dir), WEIGHTS)
    return e.select("row_id", "cluster_id", "score", "election_status", "is_golden_record", "golden_record_id", "proposed_golden_id", "approval_status")


def election_summary(spark, sf_dir):
    return scoring.election_summary(scoring.elect_golden(score_inputs(spark, sf_dir), WEIGHTS))


def scoring_issues(spark, sf_dir):
    return scoring.scoring_issues(scoring.elect_golden(score_inputs(spark, sf_dir), WEIGHTS)).select("row_id", "cluster_id", "issue_type")


def approve_clusters(spark, sf_dir):
    e = scoring.elect_golden(score_inputs(spark, sf_dir), WEIGHTS)
    decisions = e.filter("cluster_id is not null").select("cluster_id").distinct().withColumn("decision", F.when(F.col("cluster_id").endswith("-2"), "rejected").otherwise("approved")).filter("cluster_id like 'k-1%'")
    return scoring.apply_approval(e, decisions).select("row_id", "cluster_id", "approval_status", "is_golden_record", "golden_record_id")


_INPUT_SQL = """
WITH by_year AS (SELECT o_custkey, year(o_orderdate) y, count(*) n, count(*) FILTER (o_orderpriority = '1-URGENT') u FROM orders GROUP BY ALL),
years AS (SELECT o_custkey, max({'y': y, 'n': n}) own, max({'y': y, 'u': u}) FILTER (u > 0) partner FROM by_year GROUP BY 1),
equip AS (SELECT o_custkey, count(*) e FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1),
base AS (
  SELECT c_custkey k, c_custkey::VARCHAR row_id, c_acctbal bal,
    CASE WHEN c_custkey % 7 <> 0 THEN 'k-' || c_nationkey || '-' || substr(c_mktsegment, 1, 2) || '-' || (c_custkey % 9) END cluster_id,
    c_custkey % 31 = 0 AS routed, CASE WHEN c_custkey % 13 = 0 THEN 0.9 ELSE 0.97 END conf, c_custkey % 17 = 0 AS disowns,
    CASE WHEN c_custkey % 53 <> 0 THEN own.y END ly, c_custkey % 53 = 0 AS bad_year, own.n oc, partner.y py, partner.u pc, e,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 20 WHEN 'BUILDING' THEN 15 WHEN 'FURNITURE' THEN 10 WHEN 'HOUSEHOLD' THEN 5 ELSE 0 END ag,
    c_custkey % 4 cc, c_custkey % 3 = 0 AS so, (c_custkey % 5 = 0)::INT + (c_custkey % 10 = 0)::INT sf
  FROM customer LEFT JOIN years y ON c_custkey = y.o_custkey LEFT JOIN equip q ON c_custkey = q.o_custkey),
ctx AS (
  SELECT *, coalesce('c:' || cluster_id, 'r:' || row_id) g, count(*) OVER w members,
    CASE WHEN count(*) OVER w >= 2 THEN max(ly) OVER w END my, CASE WHEN count(*) OVER w >= 2 THEN max(py) OVER w END mpy
  FROM base WINDOW w AS (PARTITION BY coalesce('c:' || cluster_id, 'r:' || row_id))),
pts AS (
  SELECT *,
    CASE ly WHEN 2001 THEN 20 WHEN 2000 THEN 15 WHEN 1999 THEN 10 WHEN 1998 THEN 5 ELSE 0 END p1,
    CASE WHEN oc BETWEEN 0 AND 5 THEN 5 WHEN oc BETWEEN 6 AND 10 THEN 15 WHEN oc > 10 THEN 25 ELSE 0 END b2,
    ly IS NOT NULL AND (my IS NULL OR ly = my) t2,
    CASE py WHEN 2001 THEN 20 WHEN 2000 THEN 15 WHEN 1999 THEN 10 WHEN 1998 THEN 5 ELSE 0 END p3,
    CASE WHEN pc BETWEEN 0 AND 5 THEN 5 WHEN pc BETWEEN 6 AND 10 THEN 15 WHEN pc > 10 THEN 25 ELSE 0 END b4,
    py IS NOT NULL AND (mpy IS NULL OR py = mpy) t4,
    CASE WHEN e BETWEEN 0 AND 3 THEN 5 WHEN e BETWEEN 4 AND 8 THEN 12 WHEN e BETWEEN 9 AND 15 THEN 20 WHEN e > 15 THEN 30 ELSE 0 END p5,
    CASE WHEN bal > 5000 THEN 15 WHEN bal > 1000 THEN 5 ELSE 0 END p6, CASE WHEN bal >= 0 THEN 10 ELSE 0 END p7,
    CASE WHEN cc = 1 THEN 5 WHEN cc BETWEEN 2 AND 4 THEN 15 ELSE 0 END p9, CASE WHEN cc > 0 AND so THEN 10 ELSE 0 END p10, sf * 10 p11
  FROM ctx),
scored AS (
  SELECT *, CASE WHEN t2 THEN b2 ELSE 0 END p2, CASE WHEN t4 THEN b4 ELSE 0 END p4,
    p1 + CASE WHEN t2 THEN b2 ELSE 0 END + p3 + CASE WHEN t4 THEN b4 ELSE 0 END + p5 + p6 + p7 + ag + p9 + p10 + p11 score,
    bad_year::INT + (NOT t2 AND b2 > 0 AND my IS NOT NULL)::INT + (NOT t4 AND b4 > 0 AND mpy IS NOT NULL)::INT + (bal <= 0 AND bal > -500)::INT n_warnings
  FROM pts)
"""
_ELECT_SQL = _INPUT_SQL + """,
won AS (
  SELECT *, first_value(row_id) OVER (PARTITION BY g ORDER BY score DESC, coalesce(ly, -1) DESC, coalesce(e, -1) DESC, cc DESC, k) winner,
    bool_or(routed) OVER w OR bool_and(bal < 0) OVER w OR min(conf) OVER w < 0.95 OR max(score) OVER w = 0 review
  FROM scored WINDOW w AS (PARTITION BY g)),
elected AS (
  SELECT *, CASE WHEN members >= 2 THEN CASE WHEN review THEN 'manual_review' ELSE 'proposed' END WHEN routed THEN 'manual_review' ELSE 'unique' END election_status,
    members < 2 OR row_id = winner AS is_golden_record, CASE WHEN members >= 2 THEN winner ELSE row_id END golden_record_id
  FROM won),
results AS (
  SELECT *, CASE WHEN election_status <> 'unique' THEN golden_record_id END proposed_golden_id, CASE WHEN election_status <> 'unique' THEN 'proposed' END approval_status FROM elected)
"""
_ISSUES_SQL = _ELECT_SQL + """,
clusters AS (
  SELECT cluster_id, max(golden_record_id) row_id, min(conf) low, bool_and(bal < 0) blocked, max(score) top, count(*) FILTER (score = mx) shared, count(*) n
  FROM (SELECT *, max(score) OVER (PARTITION BY cluster_id) mx FROM results WHERE cluster_id IS NOT NULL) GROUP BY 1)
SELECT row_id, cluster_id, 'verdict_contradiction' issue_type FROM results WHERE disowns
UNION ALL SELECT row_id, cluster_id, 'count_suppressed_by_recency' FROM results WHERE NOT t2 AND b2 > 0 AND my IS NOT NULL
UNION ALL SELECT row_id, cluster_id, 'count_suppressed_by_recency' FROM results WHERE NOT t4 AND b4 > 0 AND mpy IS NOT NULL
UNION ALL SELECT row_id, cluster_id, 'low_confidence_merge' FROM clusters WHERE low < 0.95
UNION ALL SELECT row_id, cluster_id, 'all_blocked_cluster' FROM clusters WHERE blocked
UNION ALL SELECT row_id, cluster_id, 'tiebreak_decided' FROM clusters WHERE n >= 2 AND shared >= 2
UNION ALL SELECT row_id, cluster_id, 'empty_scoring_payload' FROM clusters WHERE top = 0
"""

QUERIES = {f.__name__: f for f in (score_rows, elect_golden, election_summary, scoring_issues, approve_clusters)}
ORACLE_SQL = {
    "score_rows": _INPUT_SQL + "SELECT row_id, cluster_id, score, p2 sales_order_count, p4 sales_order_partner_count, p5 equipment_count_points, p6 sleeping_customer, p7 customer_status_points, ag account_group_points, p9 company_code_count, p10 combined_presence_bonus, p11 salesforce_instance_count, n_warnings FROM scored",
    "elect_golden": _ELECT_SQL + "SELECT row_id, cluster_id, score, election_status, is_golden_record, golden_record_id, proposed_golden_id, approval_status FROM results",
    "election_summary": _ELECT_SQL + """SELECT count(*) rows_in, count(*) FILTER (n_warnings > 0) rows_with_warnings, count(*) FILTER (election_status = 'unique') rows_unique,
        count(*) FILTER (election_status = 'manual_review') rows_manual_review, count(*) FILTER (election_status <> 'unique' AND is_golden_record) rows_elected,
        count(*) FILTER (election_status <> 'unique' AND NOT is_golden_record) rows_duplicates, count(DISTINCT cluster_id) FILTER (election_status <> 'unique') clusters,
        count(DISTINCT cluster_id) FILTER (election_status = 'manual_review') review_clusters FROM results""",
    "scoring_issues": _ISSUES_SQL,
    "approve_clusters": _ELECT_SQL + """SELECT row_id, cluster_id, CASE WHEN cluster_id LIKE 'k-1%' THEN CASE WHEN cluster_id LIKE '%-2' THEN 'rejected' ELSE 'approved' END ELSE approval_status END approval_status,
        is_golden_record, golden_record_id FROM results""",
}
