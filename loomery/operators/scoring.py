"""Golden-record scoring, election, approval and issues, as columns and windows.

Every criterion is a column generated from a weights table (a dict of ordered
bands), so a retune is data. Cluster context (most recent year, group size,
least confidence, winner) comes from windows over the cluster: one shuffle on
the cluster id serves them all. Clusters are address blocks with a handful of
records; rows without a cluster never meet in a window, as they get a key of
their own.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.dedup import NONMERGE_MARKERS, cluster_hashes

#: Default points by criterion and band.
WEIGHTS = {
    "sales_order_last_used": {"2026": 20, "2025": 15, "2024": 10, "2023": 5},
    "sales_order_count": {"0-5": 5, "6-10": 15, ">10": 25},
    "sales_order_partner_last_used": {"2026": 20, "2025": 15, "2024": 10, "2023": 5},
    "sales_order_partner_count": {"0-5": 5, "6-10": 15, ">10": 25},
    "equipment_count": {"0-3": 5, "4-8": 12, "9-15": 20, ">15": 30},
    "sleeping_customer": {"No": 15, "3-4": 5, ">5": 0},
    "customer_status": {"active": 10, "blocked": 0},
    "account_group": {"DRIT": 20, "0002/SHIP2": 15, "0003": 10, "0004": 10, "0005/MLIEF": 5},
    "company_code_count": {"1": 5, "2-4": 15, "5+": 25},
    "combined_presence_bonus": {"company code AND sales org": 10},
    "salesforce_instance_count": {"per instance": 10},
}
CRITERIA = list(WEIGHTS)
CONFIDENCE = 0.95
CONTRADICTIONS = list(NONMERGE_MARKERS)
SF_IDS = [f"sf{k}" for k in range(1, 9)]


def weights_version(weights: dict) -> str:
    """First 12 hex digits of the SHA-256 of the weights as canonical JSON."""
    return hashlib.sha256(json.dumps(weights, sort_keys=True).encode()).hexdigest()[:12]


def coverage_gap(candidate: dict, expected: dict = WEIGHTS) -> list[tuple[str, str]]:
    """(criterion, band) pairs that a weights table lacks or has in excess: none, or it is refused as a whole."""
    pairs = lambda w: {(c, b) for c, bands in w.items() if not c.startswith("_") for b in bands}
    return sorted(pairs(expected) ^ pairs(candidate))


def load_weights(path: str) -> dict:
    """A weights file; keys that begin with ``_`` are comments."""
    with open(path) as f:
        return {k: v for k, v in json.load(f).items() if not k.startswith("_")}


def weights_of_sheet(rows: DataFrame) -> dict:
    """Weights of a (criterion, band, points) table, a few dozen rows; refused as a whole if bands are missing or new."""
    table: dict = {}
    for r in rows.select("criterion", "band", F.col("points").cast("int").alias("points")).orderBy("_seq").collect():
        table.setdefault(r["criterion"], {})[r["band"]] = r["points"]
    if gap := coverage_gap(table):
        raise ValueError(f"weights don't cover the expected bands: {gap}")
    return table


def cluster_columns(columns: list[str]) -> tuple[str, str] | None:
    """(routing, cluster) columns of a sheet: the produced pair before the expected one."""
    for pair in (("routing", "cluster_id"), ("expected_routing", "expected_cluster")):
        if all(c in columns for c in pair):
            return pair
    return None


def clean(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(t != "", t)


def coerce_int(c: Column) -> Column:
    """A dirty cell as a whole number, truncated; null if blank, not a number or not finite."""
    number = clean(c).try_cast("double")
    return F.when(F.abs(number) < 9e18, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("long"))


def not_numeric(c: Column, name: str) -> Column:
    """A warning where a cell has something that isn't a number."""
    return F.when(clean(c).isNotNull() & coerce_int(c).isNull(), F.concat(F.lit(f"{name} '"), clean(c), F.lit("' not numeric -> 0")))


def numeric_band(value: Column, bands: dict[str, int]) -> Column:
    """Points of the first band that holds the value: a-b, >n, n+ or n; else 0."""
    out = F.lit(0)
    for label, points in reversed(list(bands.items())):
        label = label.strip()
        try:
            if label.startswith(">"):
                fits = value > int(label[1:])
            elif label.endswith("+"):
                fits = value >= int(label[:-1])
            elif "-" in label.lstrip("-"):
                low, high = label.rsplit("-", 1)
                fits = value.between(int(low), int(high))
            else:
                fits = value == int(label)
        except ValueError:  # a label that can't be read holds nothing
            continue
        out = F.when(fits, int(points)).otherwise(out)
    return out


def label_band(value: Column, bands: dict[str, int]) -> Column:
    """Points of a label, whatever its case; ``X/Y`` is either."""
    needle, out = F.lower(clean(value)), F.lit(0)
    for label, points in reversed(list(bands.items())):
        out = F.when(needle.isin([x.strip().lower() for x in label.split("/")]), int(points)).otherwise(out)
    return out


def unknown_label(value: Column, bands: dict[str, int], name: str) -> Column:
    known = [x.strip().lower() for label in bands for x in label.split("/")]
    return F.when(clean(value).isNotNull() & ~F.lower(clean(value)).isin(known), F.concat(F.lit(f"{name} '"), clean(value), F.lit("' unrecognized -> 0")))


def parts_of(value: Column) -> Column:
    """Non-blank parts of a ``;`` list."""
    return F.filter(F.transform(F.split(F.coalesce(value.cast("string"), F.lit("")), ";"), lambda x: F.trim(x)), lambda p: p != "")


def derived_counts(columns: list[str]) -> dict[str, Column]:
    ids = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1).otherwise(0) for c in SF_IDS if c in columns]
    return {"company_codes": F.size(parts_of(F.col("company_code_consolidated"))), "sales_orgs": F.size(parts_of(F.col("sales_org_consolidated"))), "sf_instances": sum(ids, F.lit(0))}


def cluster_window():
    return Window.partitionBy("_group")


def with_cluster_context(rows: DataFrame) -> DataFrame:
    """Adds coerced numbers, group size and the group's most recent years (null for single rows)."""
    rows = rows.withColumn("cluster_id", clean(F.col("cluster_id")))
    rows = rows.withColumn("_group", F.coalesce(F.concat(F.lit("c:"), "cluster_id"), F.concat(F.lit("r:"), "row_id")))
    rows = rows.withColumns({"last_year": coerce_int(F.col("last_order_year")), "orders": coerce_int(F.col("orders_in_last_used_year")), "partner_year": coerce_int(F.col("partner_last_order_year")), "partner_orders": coerce_int(F.col("partner_orders_in_last_used_year")), "equipment": coerce_int(F.col("equipment_count"))} | derived_counts(rows.columns))
    w = cluster_window()
    rows = rows.withColumn("members", F.count("*").over(w))
    several = F.col("members") >= 2
    return rows.withColumns({"max_year": F.when(several, F.max("last_year").over(w)), "max_partner_year": F.when(several, F.max("partner_year").over(w))})


def awards_count(year: Column, most_recent: Column) -> Column:
    """Counts only tell apart records of their cluster's most recent year."""
    return year.isNotNull() & (most_recent.isNull() | (year == most_recent))


def score_rows(rows: DataFrame, weights: dict = WEIGHTS) -> DataFrame:
    """Points per criterion, their total and the warnings of every row, in its cluster's context."""
    c = with_cluster_context(rows)
    own, partner = numeric_band(F.col("orders"), weights["sales_order_count"]), numeric_band(F.col("partner_orders"), weights["sales_order_partner_count"])
    takes_own, takes_partner = awards_count(F.col("last_year"), F.col("max_year")), awards_count(F.col("partner_year"), F.col("max_partner_year"))
    single = lambda k: int(next(iter(weights[k].values()), 0))
    points = {
        "sales_order_last_used": numeric_band(F.col("last_year"), weights["sales_order_last_used"]),
        "sales_order_count": F.when(takes_own, own).otherwise(0),
        "sales_order_partner_last_used": numeric_band(F.col("partner_year"), weights["sales_order_partner_last_used"]),
        "sales_order_partner_count": F.when(takes_partner, partner).otherwise(0),
        "equipment_count_points": numeric_band(F.col("equipment"), weights["equipment_count"]),
        "sleeping_customer": label_band(F.col("sleeping_band"), weights["sleeping_customer"]),
        "customer_status_points": label_band(F.col("customer_status"), weights["customer_status"]),
        "account_group_points": label_band(F.col("account_group"), weights["account_group"]),
        "company_code_count": numeric_band(F.col("company_codes"), weights["company_code_count"]),
        "combined_presence_bonus": F.when((F.col("company_codes") > 0) & (F.col("sales_orgs") > 0), single("combined_presence_bonus")).otherwise(0),
        "salesforce_instance_count": F.col("sf_instances") * single("salesforce_instance_count"),
    }
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    lost = lambda what, year, most, pts, takes: F.when(~takes & (pts > 0) & most.isNotNull(), F.concat(F.lit(f"{what} count suppressed (G1): year "), text(year), F.lit(" is not the cluster's most recent ("), text(most), F.lit(")")))
    warnings = F.array_compact(F.array(
        not_numeric(F.col("last_order_year"), "last_order_year"), not_numeric(F.col("orders_in_last_used_year"), "orders_in_last_used_year"),
        not_numeric(F.col("partner_last_order_year"), "partner_last_order_year"), not_numeric(F.col("partner_orders_in_last_used_year"), "partner_orders_in_last_used_year"),
        not_numeric(F.col("equipment_count"), "equipment_count"),
        lost("order", F.col("last_year"), F.col("max_year"), own, takes_own), lost("partner order", F.col("partner_year"), F.col("max_partner_year"), partner, takes_partner),
        unknown_label(F.col("sleeping_band"), weights["sleeping_customer"], "sleeping_band"), unknown_label(F.col("customer_status"), weights["customer_status"], "customer_status"),
    ))
    scored = c.withColumns(points).withColumn("warnings", warnings)
    return scored.withColumn("score", sum((F.col(p) for p in points), F.lit(0)))


def is_integer(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), F.lit(False))


def elect_golden(rows: DataFrame, weights: dict = WEIGHTS, threshold: float = CONFIDENCE) -> DataFrame:
    """Scored rows with winner, election status and golden fields.

    row_id must be unique (see ``duplicate_row_ids``). The best row has the
    greatest score, year, equipment and company codes, then the smallest
    row_id, as numbers if all of the cluster's are.
    """
    s = score_rows(rows, weights)
    w = cluster_window()
    s = s.withColumn("_numeric", F.min(is_integer(F.col("row_id")).cast("int")).over(w) == 1)
    number = F.when(F.col("_numeric"), F.trim("row_id").try_cast("long"))
    order = [F.desc("score"), F.desc(F.coalesce("last_year", F.lit(-1))), F.desc(F.coalesce("equipment", F.lit(-1))), F.desc("company_codes"), number.asc_nulls_last(), F.col("row_id").asc()]
    s = s.withColumn("_winner", F.first("row_id").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    routed = F.lower(F.trim(F.coalesce("routing", F.lit("")))) == "manual_review"
    blocked = F.coalesce(F.lower(F.trim("customer_status")) == "blocked", F.lit(False))
    any_ = lambda c: F.max(c.cast("int")).over(w) == 1
    review = any_(routed) | ~any_(~blocked) | F.coalesce(F.min("confidence").over(w) < threshold, F.lit(False)) | (F.max("score").over(w) == 0)
    several = F.col("members") >= 2
    status = F.when(several, F.when(review, "manual_review").otherwise("proposed")).otherwise(F.when(routed, "manual_review").otherwise("unique"))
    out = s.withColumn("election_status", status)
    settled = F.col("election_status") == "unique"
    hashes = cluster_hashes(out.filter(F.col("cluster_id").startswith("c_")).select(F.col("cluster_id").alias("cluster"), "row_id"))
    out = out.join(hashes.select(F.col("cluster").alias("_cluster"), F.col("hash").alias("_present")), F.col("cluster_id") == F.col("_cluster"), "left")
    partial = F.coalesce(F.col("_present") != F.col("cluster_id"), F.lit(False))
    out = out.withColumn("warnings", F.when(partial, F.concat("warnings", F.array(F.concat(F.lit("partial_cluster: submitted rows are a subset of "), "cluster_id")))).otherwise(F.col("warnings")))
    return out.drop("_cluster", "_present").withColumns({
        "is_golden_record": F.when(several, F.col("row_id") == F.col("_winner")).otherwise(F.lit(True)),
        "golden_record_id": F.when(several, F.col("_winner")).otherwise(F.col("row_id")),
        "proposed_golden_id": F.when(~settled, F.when(several, F.col("_winner")).otherwise(F.col("row_id"))),
        "approval_status": F.when(~settled, "proposed"),
        "scored_with_weights_version": F.lit(weights_version(weights)),
    })


def duplicate_row_ids(rows: DataFrame) -> DataFrame:
    """Row ids that occur more than once; an election needs this to be empty."""
    return rows.groupBy("row_id").agg(F.count("*").alias("times")).filter("times > 1")


def election_summary(results: DataFrame) -> DataFrame:
    """One row of counters."""
    open_ = F.col("election_status") != "unique"
    review = F.col("election_status") == "manual_review"
    n = lambda c: F.count_if(c)
    return results.agg(
        F.count("*").alias("rows_in"), n(F.size("warnings") > 0).alias("rows_with_warnings"), n(~open_).alias("rows_unique"), n(review).alias("rows_manual_review"),
        n(open_ & F.col("is_golden_record")).alias("rows_elected"), n(open_ & ~F.col("is_golden_record")).alias("rows_duplicates"),
        F.count_distinct(F.when(open_, F.col("cluster_id"))).alias("clusters"), F.count_distinct(F.when(review, F.col("cluster_id"))).alias("review_clusters"),
    )


def disowns_merge(reasoning: Column) -> Column:
    low = F.lower(reasoning)
    return F.coalesce(low.startswith("split:") | low.rlike("|".join(CONTRADICTIONS)), F.lit(False))


def scoring_issues(results: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    """row_id, cluster_id, issue_type, detail: what a reviewer should look at."""
    row = lambda kind, keep, detail: results.filter(keep).select("row_id", "cluster_id", F.lit(kind).alias("issue_type"), detail.alias("detail"))
    found = row("verdict_contradiction", disowns_merge(F.col("reasoning")), F.substring(F.trim("reasoning"), 1, 200))
    capped = results.filter(F.coalesce(F.col("reasoning").contains("candidate_cap_exceeded"), F.lit(False)))
    capped = capped.withColumn("_key", F.coalesce("cluster_id", "row_id")).groupBy("_key").agg(F.min(F.struct("row_id", "cluster_id", F.substring(F.trim("reasoning"), 1, 200).alias("detail"))).alias("x"))
    found = found.unionByName(capped.select("x.row_id", "x.cluster_id", F.lit("candidate_cap_exceeded").alias("issue_type"), "x.detail"))
    lost = results.select("row_id", "cluster_id", F.explode("warnings").alias("detail")).filter(F.col("detail").contains("count suppressed (G1)"))
    found = found.unionByName(lost.select("row_id", "cluster_id", F.lit("count_suppressed_by_recency").alias("issue_type"), "detail"))
    blocked = F.coalesce(F.lower(F.trim("customer_status")) == "blocked", F.lit(False))
    top = Window.partitionBy("cluster_id")
    c = results.filter("cluster_id is not null").withColumn("_top", F.max("score").over(top)).groupBy("cluster_id").agg(
        F.max(F.coalesce("proposed_golden_id", "golden_record_id")).alias("row_id"), F.min("confidence").alias("low"), F.min(blocked.cast("int")).alias("blocked"),
        F.max("_top").alias("top"), F.count_if(F.col("score") == F.col("_top")).alias("shared"), F.count("*").alias("n"),
    )
    fixed = lambda x: F.format_string("%.2f", x)
    kinds = F.array(
        F.struct((F.coalesce(F.col("low") < threshold, F.lit(False))).alias("on"), F.lit("low_confidence_merge").alias("issue_type"), F.concat(F.lit("min merge confidence "), fixed(F.col("low")), F.lit(f" < {threshold:.2f}")).alias("detail")),
        F.struct((F.col("blocked") == 1).alias("on"), F.lit("all_blocked_cluster").alias("issue_type"), F.lit("every member is blocked").alias("detail")),
        F.struct(((F.col("n") >= 2) & (F.col("shared") >= 2)).alias("on"), F.lit("tiebreak_decided").alias("issue_type"), F.concat(F.lit("top score "), F.col("top").cast("string"), F.lit(" shared by "), F.col("shared").cast("string"), F.lit(" members")).alias("detail")),
        F.struct((F.col("top") == 0).alias("on"), F.lit("empty_scoring_payload").alias("issue_type"), F.lit("all members scored 0").alias("detail")),
    )
    clusters = c.select("row_id", "cluster_id", F.explode(F.filter(kinds, lambda k: k["on"])).alias("k")).select("row_id", "cluster_id", "k.issue_type", "k.detail")
    return found.unionByName(clusters)


def apply_approval(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (cluster_id, decision) on elected rows; approval promotes the proposed winner.

    Decisions on clusters that aren't there are in ``unknown_clusters``.
    """
    d = decisions.select(F.col("cluster_id").alias("_cluster"), "decision")
    out = results.join(d, F.col("cluster_id") == F.col("_cluster"), "left").drop("_cluster")
    yes = (F.col("decision") == "approved") & F.col("proposed_golden_id").isNotNull()
    return out.withColumns({
        "approval_status": F.coalesce("decision", "approval_status"),
        "is_golden_record": F.when(yes, F.col("row_id") == F.col("proposed_golden_id")).otherwise(F.col("is_golden_record")),
        "golden_record_id": F.when(yes, F.col("proposed_golden_id")).otherwise(F.col("golden_record_id")),
    }).drop("decision")


def unknown_clusters(results: DataFrame, decisions: DataFrame) -> DataFrame:
    return decisions.join(results.select("cluster_id").distinct(), "cluster_id", "left_anti")


def writeback(results: DataFrame) -> DataFrame:
    """The file's view: golden cells of clusters under review are blank."""
    review = F.col("election_status") == "manual_review"
    return results.withColumns({"is_golden_record": F.when(~review, F.col("is_golden_record")), "golden_record_id": F.when(~review, F.col("golden_record_id"))})


def cluster_id_of_cells(routing: Column, cluster: Column) -> Column:
    """Cluster id from a sheet's routing and cluster cells; ids that a sheet made floats lose ``.0``."""
    id_ = F.regexp_replace(clean(cluster), r"\.0$", "")
    return F.when(F.lower(F.trim(routing)).isin("cluster", "manual_review"), id_)
