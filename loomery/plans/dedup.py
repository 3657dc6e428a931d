"""Dedup, evaluation, comparison and merge queries on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.operators import dedup, evaluation, merge, scoring
from loomery.plans.golden import _ELECT_SQL, WEIGHTS, score_inputs


def _read(spark, sf_dir, table, *columns):
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def records(spark, sf_dir):
    """Customers and suppliers as records: one block per nation and key mod 5, names from part names."""
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    p = _read(spark, sf_dir, "part", "p_partkey", "p_name")
    k = F.col("c_custkey")
    return c.join(p, F.pmod(k, F.lit(200)) == F.col("p_partkey")).select(
        k.alias("_seq"), F.concat(F.lit("r"), k.cast("string")).alias("row_id"),
        F.concat(F.initcap("p_name"), F.when(k % 3 == 0, " GmbH").when(k % 3 == 1, " Inc.").otherwise("")).alias("name1"),
        F.when(k % 4 == 0, F.concat(F.initcap("c_mktsegment"), F.lit(" Dept"))).alias("name2"), F.when(k % 8 == 0, " Lab 7 ").alias("name3"),
        F.concat(F.lit("Street "), F.col("c_nationkey").cast("string")).alias("street"), (k % 5).cast("string").alias("house_no"), F.lit("12345").alias("postal_code"), F.lit("DE").alias("country"),
        F.when(k % 6 == 0, F.concat(F.lit("ror"), (k % 12).cast("string"))).alias("ror_id"), F.lit(None).cast("string").alias("lei_id"), F.lit(None).cast("string").alias("given"),
    ).withColumn("block_id", dedup.block_id(F.col("country"), F.col("postal_code"), F.col("street"), F.col("house_no"), F.col("given"), tx.fold_key))


def block_ids(spark, sf_dir):
    return records(spark, sf_dir).select("row_id", "block_id", tx.fold_key(F.col("name1")).alias("key"), tx.strip_legal_suffix(F.col("name1")).alias("core"))


def signatures(spark, sf_dir):
    return dedup.signatures(records(spark, sf_dir), tx.fold_key).select("block_id", "signature_id", "norm_name1", "norm_name2", "ror_id", "n_rows", F.array_join("row_ids", ";").alias("row_ids"))


def _units(spark, sf_dir):
    s = dedup.signatures(records(spark, sf_dir), tx.fold_key)
    return s.select("block_id", F.substring("signature_id", 2, 9).cast("int").alias("idx"), F.col("name1").alias("name"), "ror_id", "lei_id", "has_name2", F.lit(False).alias("adjudicated"))


def candidate_pairs(spark, sf_dir):
    return dedup.candidate_pairs(_units(spark, sf_dir)).select("block_id", "a", "b", "rule", F.round("score", 6).alias("score"))


def candidate_cap(spark, sf_dir):
    return dedup.capped_blocks(dedup.candidate_pairs(_units(spark, sf_dir)), 20)


def cluster_components(spark, sf_dir):
    """Rows clustered with verdicts: pairs by name match if both keys' sum is even."""
    pairs = dedup.candidate_pairs(_units(spark, sf_dir))
    sig = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    verdicts = pairs.filter("rule = 'name'").select("block_id", sig("a").alias("a"), sig("b").alias("b"), F.when((F.col("a") + F.col("b")) % 2 == 0, "match").otherwise("distinct").alias("decision"))
    out = dedup.cluster_rows(records(spark, sf_dir), None, verdicts, cap=10**9, key=tx.fold_key)
    return out.select("row_id", "block_id", "cluster_id", "routing")


def exact_clusters(spark, sf_dir):
    out = dedup.cluster_rows(records(spark, sf_dir), key=tx.fold_key)
    return out.select("row_id", "block_id", "cluster_id", "routing", "signature_id")


def identity_guard(spark, sf_dir):
    """All signatures of a block and department kind as one entity; conflicting ids split it."""
    s = dedup.signatures(records(spark, sf_dir), tx.fold_key).withColumns({"entity_id": F.lit("e1"), "uncertain": F.lit(False), "reasoning": F.lit(None).cast("string")})
    out = dedup.split_conflicting_ids(dedup.split_mixed_departments(s))
    return out.groupBy("block_id").agg(F.count_distinct("entity_id").alias("entities"), F.count_if("uncertain").alias("uncertain"))


def _scored(spark, sf_dir):
    e = scoring.elect_golden(score_inputs(spark, sf_dir), WEIGHTS)
    k = F.col("row_id").cast("long")
    return e.withColumns({"expected_cluster": F.when(k % 5 != 0, F.concat(F.lit("t"), F.substring("cluster_id", 1, 7))), "expected_routing": F.when(k % 10 == 0, "unique").when(k % 11 == 0, "manual_review").otherwise("cluster")})


def pairwise_metrics(spark, sf_dir):
    return evaluation.pairwise_metrics(_scored(spark, sf_dir))


def business_risk(spark, sf_dir):
    return evaluation.business_risk(_scored(spark, sf_dir))


def election_metrics(spark, sf_dir):
    return evaluation.election_metrics(_scored(spark, sf_dir))


def run_diff(spark, sf_dir):
    o = _read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    left = o.filter(k % 19 != 0)
    right = o.filter(k % 23 != 0).withColumns({"o_orderstatus": F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority": F.when(k % 29 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))})
    return evaluation.run_diff(left, right, "o_orderkey")


def merge_nondestructive(spark, sf_dir):
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", F.lit("old").alias("flag"))
    k = F.col("c_custkey")
    src = c.filter(k % 3 == 0).select("c_custkey", F.when(k % 2 == 0, " ").otherwise(F.concat(F.lit(" new "), "c_name")).alias("c_name"), F.lit("  SEG ").alias("c_mktsegment"), F.when(k % 9 == 0, "set").alias("flag"))
    return merge.merge_updates(c, src, "c_custkey", ["c_name"], ["flag"], ["c_mktsegment"])


def field_population(spark, sf_dir):
    return evaluation.field_population(score_inputs(spark, sf_dir).select("row_id", "cluster_id", "reasoning", "sleeping_band", "sf3"))


def duplicate_groups(spark, sf_dir):
    return evaluation.duplicate_groups(_read(spark, sf_dir, "documents"), ["text"])


_REC = """
WITH rec AS (
  SELECT c_custkey k, 'r' || c_custkey row_id, (SELECT string_agg(upper(w[1]) || substr(w, 2), ' ') FROM (SELECT unnest(string_split(p_name, ' ')) w)) || CASE c_custkey % 3 WHEN 0 THEN ' GmbH' WHEN 1 THEN ' Inc.' ELSE '' END name1,
    lower(p_name) pn, c_custkey % 3 suf,
    coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment[1] || lower(substr(c_mktsegment, 2)) || ' Dept' || CASE WHEN c_custkey % 8 = 0 THEN ' / Lab 7' ELSE '' END END, '') dept,
    CASE WHEN c_custkey % 6 = 0 THEN 'ror' || (c_custkey % 12) END ror_id,
    'blk-' || substr(sha1('de|12345|street ' || c_nationkey || '|' || (c_custkey % 5)), 1, 12) block_id
  FROM customer JOIN part ON c_custkey % 200 = p_partkey),
keyed AS (SELECT *, pn || CASE suf WHEN 0 THEN ' gmbh' WHEN 1 THEN ' inc' ELSE '' END n1, trim(regexp_replace(regexp_replace(lower(dept), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) n2 FROM rec),
sig AS (
  SELECT block_id, n1, n2, min(k) f, count(*) n_rows, string_agg(row_id, ';' ORDER BY k) row_ids, list(row_id ORDER BY row_id) ids, arg_min(ror_id, k) FILTER (ror_id IS NOT NULL) ror_id, min(pn) pn FROM keyed GROUP BY 1, 2, 3),
sigs AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY f) idx FROM sig)
"""
_PAIRS = _REC + """,
nom AS (
  SELECT x.block_id, x.idx a, y.idx b, coalesce(x.ror_id = y.ror_id, false) ids, jaro_winkler_similarity(x.pn, y.pn) jw,
    len(list_intersect(string_split(x.pn, ' '), string_split(y.pn, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(x.pn, ' '), string_split(y.pn, ' ')))) jac
  FROM sigs x JOIN sigs y ON x.block_id = y.block_id AND x.idx < y.idx),
pairs AS (
  SELECT block_id, a, b, CASE WHEN ids THEN 'id' WHEN jw >= 0.85 THEN 'name' ELSE 'token' END rule, CASE WHEN ids THEN 1.0 WHEN jw >= 0.85 THEN jw ELSE jac END score
  FROM nom WHERE ids OR jw >= 0.85 OR jac >= 0.6)
"""
_SCORED = _ELECT_SQL + """,
ev AS (SELECT *, CASE WHEN k % 5 <> 0 THEN 't' || substr(cluster_id, 1, 7) END et, CASE WHEN k % 10 = 0 THEN 'unique' WHEN k % 11 = 0 THEN 'manual_review' ELSE 'cluster' END er, CASE WHEN routed THEN 'manual_review' ELSE 'cluster' END routing FROM results)
"""

QUERIES = {f.__name__: f for f in (block_ids, signatures, candidate_pairs, candidate_cap, cluster_components, exact_clusters, identity_guard, pairwise_metrics, business_risk, election_metrics, run_diff, merge_nondestructive, field_population, duplicate_groups)}
ORACLE_SQL = {
    "block_ids": _REC + "SELECT row_id, block_id, n1 AS key, pn AS core FROM keyed",
    "signatures": _REC + "SELECT block_id, 's' || idx signature_id, n1 norm_name1, n2 norm_name2, ror_id, n_rows, row_ids FROM sigs",
    "candidate_pairs": _PAIRS + "SELECT block_id, a::INT a, b::INT b, rule, round(score, 6) score FROM pairs",
    "candidate_cap": _PAIRS + "SELECT block_id, count(*) candidates FROM pairs GROUP BY 1 HAVING count(*) > 20",
    "cluster_components": _PAIRS.replace("WITH rec", "WITH RECURSIVE rec") + """,
edge AS (SELECT block_id, a, b FROM pairs WHERE rule = 'name' AND (a + b) % 2 = 0 UNION SELECT block_id, b, a FROM pairs WHERE rule = 'name' AND (a + b) % 2 = 0),
reach(block_id, a, b) AS (SELECT block_id, idx, idx FROM sigs UNION SELECT r.block_id, r.a, e.b FROM reach r JOIN edge e ON r.block_id = e.block_id AND r.b = e.a),
root AS (SELECT block_id, a idx, min(b) root FROM reach GROUP BY 1, 2),
ent0 AS (SELECT s.*, root FROM sigs s JOIN root r ON s.block_id = r.block_id AND s.idx = r.idx),
ent AS (SELECT *, coalesce(min(ror_id) OVER w <> max(ror_id) OVER w, false) bad FROM ent0 WINDOW w AS (PARTITION BY block_id, root)),
grp AS (SELECT *, CASE WHEN bad THEN root || '/' || idx ELSE root::VARCHAR END g FROM ent),
fin AS (SELECT block_id, g, list_sort(flatten(list(ids))) allids, sum(n_rows) n FROM grp GROUP BY 1, 2)
SELECT unnest(grp.ids) row_id, grp.block_id, CASE WHEN n >= 2 THEN 'c_' || substr(sha256(array_to_string(allids, ';')), 1, 12) END cluster_id,
  CASE WHEN bad THEN 'manual_review' WHEN n >= 2 THEN 'cluster' ELSE 'unique' END routing FROM grp JOIN fin ON grp.block_id = fin.block_id AND grp.g = fin.g""",
    "exact_clusters": _REC + "SELECT unnest(ids) row_id, block_id, CASE WHEN n_rows >= 2 THEN 'c_' || substr(sha256(array_to_string(ids, ';')), 1, 12) END cluster_id, CASE WHEN n_rows >= 2 THEN 'cluster' ELSE 'unique' END routing, 's' || idx signature_id FROM sigs",
    "identity_guard": _REC + """, g AS (SELECT block_id, n2 <> '' h, count(*) n, count(DISTINCT ror_id) > 1 bad FROM sigs GROUP BY 1, 2)
SELECT block_id, sum(CASE WHEN bad THEN n ELSE 1 END)::BIGINT entities, sum(CASE WHEN bad THEN n ELSE 0 END)::BIGINT uncertain FROM g GROUP BY 1""",
    "pairwise_metrics": _SCORED + """, t AS (SELECT CASE WHEN er IN ('cluster', 'manual_review') THEN et END t, cluster_id p, row_id FROM ev),
gt AS (SELECT x.row_id a, y.row_id b FROM t x JOIN t y ON x.t = y.t AND x.row_id < y.row_id), pr AS (SELECT x.row_id a, y.row_id b FROM t x JOIN t y ON x.p = y.p AND x.row_id < y.row_id),
n AS (SELECT (SELECT count(*) FROM (SELECT * FROM gt INTERSECT SELECT * FROM pr)) tp, (SELECT count(*) FROM gt) g, (SELECT count(*) FROM pr) p)
SELECT tp true_positives, p - tp false_positives, g - tp false_negatives, round(tp / p, 4) "precision", round(tp / g, 4) recall, round(2.0 * tp / (p + g), 4) f1, g ground_truth_pairs, p predicted_pairs FROM n""",
    "business_risk": _SCORED + "SELECT 'wrongful_block_candidates' risk, row_id FROM ev WHERE er = 'unique' AND NOT is_golden_record UNION ALL SELECT 'competing_goldens', row_id FROM ev WHERE er = 'cluster' AND routing = 'unique' UNION ALL SELECT 'uncertainty_upgrades', row_id FROM ev WHERE er = 'manual_review' AND election_status = 'proposed'",
    "election_metrics": _SCORED + """, m AS (SELECT cluster_id, count(*) FILTER (score = mx) n FROM (SELECT *, max(score) OVER (PARTITION BY cluster_id) mx FROM ev WHERE cluster_id IS NOT NULL) GROUP BY 1)
SELECT (SELECT count(*) FROM m) clusters, count(*) FILTER (is_golden_record AND cluster_id IS NOT NULL) elections, count(*) FILTER (election_status = 'manual_review') manual_review_rows, (SELECT count(*) FROM m WHERE n >= 2) tiebreak_decided FROM ev""",
    "run_diff": """WITH l AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 19 <> 0),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END o_orderstatus, CASE WHEN o_orderkey % 29 <> 0 THEN o_orderpriority END o_orderpriority FROM orders WHERE o_orderkey % 23 <> 0),
j AS (SELECT l.o_orderkey lk, r.o_orderkey rk, l.o_orderstatus ls, r.o_orderstatus rs, l.o_orderpriority lp, r.o_orderpriority rp FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey)
SELECT lk o_orderkey, 'o_orderstatus' "column", ls left_value, rs right_value FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL AND coalesce(ls, '') <> coalesce(rs, '')
UNION ALL SELECT lk, 'o_orderpriority', lp, rp FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL AND coalesce(lp, '') <> coalesce(rp, '')
UNION ALL SELECT coalesce(lk, rk), '*', lk::VARCHAR, rk::VARCHAR FROM j WHERE lk IS NULL OR rk IS NULL""",
    "merge_nondestructive": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 <> 0 THEN 'new ' || c_name ELSE c_name END c_name, CASE WHEN c_custkey % 3 = 0 THEN 'SEG' ELSE c_mktsegment END c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 9 = 0 THEN 'set' END ELSE 'old' END flag FROM customer",
    "field_population": _ELECT_SQL + """SELECT 'row_id' "column", count(*) filled FROM base UNION ALL SELECT 'cluster_id', count(cluster_id) FROM base UNION ALL SELECT 'reasoning', count(*) FILTER (disowns) FROM base UNION ALL SELECT 'sleeping_band', count(*) FILTER (bal > -500) FROM base UNION ALL SELECT 'sf3', 0""",
    "duplicate_groups": "SELECT size, count(*) groups FROM (SELECT text, count(*) size FROM documents GROUP BY 1 HAVING count(*) > 1) GROUP BY 1",
}
