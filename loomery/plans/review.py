"""Review flags and provenance scalars over customers as records, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import provenance_log, review

FIELDS = list(provenance_log.SCOPED_FIELDS)
PRODUCERS = ["ror", "gleif", "classifier", "llm_tier3", "record_email", "website_resolver", "input", "input", "input", "preprocess", "page_read"]
SCALES = ["registry_exact", "registry_exact", "rule", "llm_self_reported", "rule", "rule", "inherited", "input_corroborated", "input_self_consistent", "rule", "rule"]


def _pick(n, values):
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (n % len(values) + 1).cast("int"))


def flag_evidence(spark, sf_dir):
    k = F.col("c_custkey")
    every = lambda n: k % n == 0
    fields = lambda *names: F.array(*map(F.lit, names))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.cast("string").alias("record_id"), F.when(every(41), fields("name2", "name1", "x")).when(every(43), fields("x")).alias("overflow_fields"), F.when(every(37), "12345678").otherwise("Acme").alias("name1_enriched"), every(47).alias("person_unresolved"),
        F.when(every(53), "merged into X").alias("superseded"), F.when(every(59), "A vs B").alias("source_conflict"), F.when(every(118), fields("domain", "name2")).alias("source_conflict_fields"),
        F.when(every(5), fields("name2", "name1")).alias("inferred_fields"), F.when(every(10), fields("name1")).alias("registry_fields"), F.when(every(3), fields("name2", "name1")).alias("changed_fields"), F.when(every(7), fields("name2")).alias("low_unchanged_fields"),
        F.when(every(2), fields("name1", "name2")).otherwise(fields("name1")).alias("enriched_fields"), F.when(every(11), fields("name1")).alias("low_fields"), F.when(every(61), "Bonn").alias("location_mismatch"), every(67).alias("dept_via_lab"), F.when(every(134), "name4").alias("demoted_to"),
        every(71).alias("name3_not_demoted"), every(13).alias("multi_contact"), every(26).alias("contact_used"), every(17).alias("email_conflict"), F.when(every(19), "x.org").alias("domain_unverified"), F.when(every(38), "seen").alias("domain_page_note"),
        _pick(k, ["Accounts Payable", "Chemistry", "Office of Purchasing", None]).alias("name2_enriched"), F.when(every(9), "enriched").alias("enrichment_status"), F.when(every(23), "r").alias("ror_id"), F.when(every(19), "x.org").alias("domain"))


def review_flags(spark, sf_dir):
    out = review.with_flags(flag_evidence(spark, sf_dir))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("record_id", joined("flag_codes"), joined("flagged_fields"), joined("flag_low_confidence"), "flag_for_review", "flag_reason")


def logs(spark, sf_dir):
    """Customers' event logs as JSON: eight events, out of order, and rejections."""
    k = F.col("c_custkey")

    def event(i):
        n, p = k + i, k + 2 * i
        ref = {"decided_by": _pick(k, ["ror", "gleif", "unresolved", "name"]), "verified_by": _pick(n, ["email", "registry", "title", None]), "corroborated_by": _pick(n, ["page:x", "wikidata", "registry:1", "odd"]), "source_url": F.concat(F.lit("https://u@www.Site"), k, F.lit(".example.com:80/a?b")), "email_domain": F.when(p % 11 == 4, F.concat(F.lit("Mail"), k, F.lit(".example.org")))}
        return F.struct(
            F.lit((i * 5) % 8 + 1).alias("seq"), _pick(n, FIELDS).alias("field"), F.when((k * 3 + i) % 4 == 0, "transform").when((k * 3 + i) % 4 == 1, "revert").when((k * 3 + i) % 4 == 2, "write").alias("kind"), F.concat(F.lit("V"), k, F.lit(".x")).alias("new_value"),
            F.array(F.lit("serp"), _pick(p, PRODUCERS)).alias("producer_chain"), _pick(p, SCALES).alias("confidence_scale"), F.when(n % 5 == 0, "wikidata:crosswalk:ror").when(n % 7 == 0, "domain-ownership:unverified").alias("rule_id"), F.struct(*(v.alias(c) for c, v in ref.items())).alias("evidence_ref"))

    rejections = F.transform(F.sequence(F.lit(1), (k % 7 + 1).cast("int")), lambda i: F.struct(i.alias("seq"), F.when(i % 2 == 0, "domain").otherwise("ror_id").alias("field"), F.concat(F.lit("c"), i).alias("candidate"), F.lit("g").alias("guard")))
    log = F.to_json(F.struct(F.array(*map(event, range(8))).alias("events"), rejections.alias("rejections")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("k"), k.cast("string").alias("record_id"), F.when(k % 29 == 0, "no log").otherwise(log).alias("log"))


def provenance_scalars(spark, sf_dir):
    out = provenance_log.with_provenance(logs(spark, sf_dir), "log", F.col("k") % 3 == 0)
    told = F.array_join(F.transform("rejections", lambda r: F.concat(r["field"], F.lit("="), F.array_join(r["candidates"], "+"), F.lit("/"), r["omitted"].cast("string"))), ";")
    return out.select("record_id", *(f"{n}_provenance" for n in provenance_log.SCOPED_FIELDS.values()), F.array_join("weak_fields", ",").alias("weak_fields"), F.array_join("registry_fields", ",").alias("registry_fields"), told.alias("rejections"))


QUERIES = {"review_flags": review_flags, "provenance_scalars": provenance_scalars}

_Q = lambda s: s.replace("'", "''")
_R = {c: f"'{_Q(t)}'" for c, t in review.REASONS.items()}
_D = {c: "'" + _Q(t).replace("{detail}", "' || {} || '") + "'" for c, t in review.DETAILED.items()}
_NAMES = "['name1', 'name2', 'name3', 'name4', 'name5']"
_ORDERED = "list_filter(['name1', 'name2', 'name3', 'name4', 'name5', 'domain', 'contact', 'email', 'address'], lambda f: list_contains({}, f))"
ORACLE_SQL = {
    "review_flags": f"""
WITH r AS (SELECT c_custkey k, c_custkey % 4 IN (0, 2) desk, CASE WHEN c_custkey % 15 = 0 THEN list_filter(['name1', 'name2'], lambda f: NOT (f = 'name1' AND c_custkey % 10 = 0) AND NOT (f = 'name2' AND c_custkey % 4 IN (0, 2))) ELSE []::VARCHAR[] END inferred FROM customer),
l AS (SELECT *, list_concat(CASE WHEN k % 11 = 0 THEN ['name1'] ELSE []::VARCHAR[] END, CASE WHEN k % 14 = 0 AND NOT desk AND NOT list_contains(inferred, 'name2') THEN ['name2'] ELSE []::VARCHAR[] END) low FROM r),
e AS (SELECT *, [
  CASE WHEN k % 41 = 0 THEN {{'c': 'overflow', 'f': ['name1', 'name2'], 't': {_R['overflow']}}} WHEN k % 43 = 0 THEN {{'c': 'overflow', 'f': {_NAMES}, 't': {_R['overflow']}}} END,
  CASE WHEN k % 37 = 0 THEN {{'c': 'opaque-code', 'f': ['name1'], 't': {_R['opaque-code']}}} END, CASE WHEN k % 47 = 0 THEN {{'c': 'person-unresolved', 'f': ['name1'], 't': {_R['person-unresolved']}}} END,
  CASE WHEN k % 53 = 0 THEN {{'c': 'entity-superseded', 'f': ['name1'], 't': {_D['entity-superseded'].format("'merged into X'")}}} END,
  CASE WHEN k % 59 = 0 THEN {{'c': 'source-conflict', 'f': CASE WHEN k % 118 = 0 THEN ['name2', 'domain'] ELSE ['name1'] END, 't': {_D['source-conflict'].format("'A vs B'")}}} END,
  NULL,
  CASE WHEN len(inferred) > 0 THEN {{'c': 'unverified-inference', 'f': inferred, 't': {_R['unverified-inference']}}} END,
  CASE WHEN len(low) > 0 THEN {{'c': 'low', 'f': low, 't': {_R[review.LOW]}}} END,
  CASE WHEN k % 61 = 0 THEN {{'c': 'registry-location-mismatch', 'f': ['address'], 't': {_D['registry-location-mismatch'].format("'Bonn'")}}} END,
  CASE WHEN k % 67 = 0 THEN {{'c': 'dept-via-lab', 'f': ['name2', CASE WHEN k % 134 = 0 THEN 'name4' ELSE 'name3' END], 't': {_R['dept-via-lab']}}} END,
  CASE WHEN k % 71 = 0 THEN {{'c': 'name3-not-demoted', 'f': ['name2', 'name3', 'name4', 'name5'], 't': {_R['name3-not-demoted']}}} END,
  CASE WHEN k % 13 = 0 AND k % 26 > 0 THEN {{'c': 'multiple-contacts', 'f': ['name2', 'contact'], 't': {_R['multiple-contacts']}}} END,
  CASE WHEN k % 17 = 0 THEN {{'c': 'email-conflict', 'f': ['email'], 't': {_R['email-conflict']}}} END,
  CASE WHEN k % 19 = 0 THEN {{'c': 'domain-unverified', 'f': ['domain'], 't': {_D['domain-unverified'].format("'x.org'")} || CASE WHEN k % 38 = 0 THEN ' — seen' ELSE '' END}} END] x FROM l),
q AS (SELECT *, list_filter(x, lambda s: s IS NOT NULL) y FROM e),
z AS (SELECT k, low, CASE WHEN len(y) = 0 AND NOT (k % 9 = 0 OR k % 23 = 0 OR k % 19 = 0 OR k % 3 = 0) THEN [{{'c': 'no-match', 'f': ['name1'], 't': {_R['no-match']}}}] ELSE y END y FROM q),
c AS (SELECT *, list_filter(list_transform(y, lambda s: s.c), lambda c: c <> 'low') codes, flatten(list_transform(y, lambda s: s.f)) fields FROM z),
n AS (SELECT *, MAP {{'name1': 'Name 1', 'name2': 'Name 2', 'name3': 'Name 3', 'name4': 'Name 4', 'name5': 'Name 5', 'domain': 'Domain', 'contact': 'Contact', 'email': 'Email', 'address': 'Address'}} m FROM c)
SELECT k::VARCHAR record_id, array_to_string(codes, ',') flag_codes, array_to_string({_ORDERED.format("fields")}, ',') flagged_fields, array_to_string(low, ',') flag_low_confidence,
  len(low) > 0 OR len(list_filter(codes, lambda c: c NOT IN ('registry-location-mismatch', 'domain-unverified'))) > 0 flag_for_review,
  nullif(array_to_string(list_transform(y, lambda s: (CASE WHEN len(s.f) < 2 THEN m[s.f[1]] ELSE array_to_string(list_transform(s.f[:len(s.f) - 1], lambda f: m[f]), ', ') || ' and ' || m[s.f[len(s.f)]] END) || ': ' || s.t), '; '), '') flag_reason
FROM n""",
    "provenance_scalars": f"""
WITH e AS (
  SELECT k, i, (i * 5) % 8 + 1 seq, ({FIELDS})[((k + i) % 6 + 1)::INT] field, (k * 3 + i) % 4 kind, ({PRODUCERS})[((k + 2 * i) % 11 + 1)::INT] p, ({SCALES})[((k + 2 * i) % 11 + 1)::INT] s,
    CASE WHEN (k + i) % 5 = 0 THEN 'wikidata' WHEN (k + i) % 7 = 0 THEN 'unverified' ELSE '' END rule, (k + 2 * i) % 11 = 4 mail
  FROM (SELECT c_custkey k, unnest(range(8)) i FROM customer WHERE c_custkey % 29 > 0)),
w AS (SELECT k, field, arg_max({{'i': i, 'p': p, 's': s, 'rule': rule, 'mail': mail}}, seq) e FROM e WHERE kind > 0 GROUP BY 1, 2),
v AS (
  SELECT k, field, e.p p, e.p IN ('ror', 'gleif') registry,
    CASE WHEN e.p IN ('ror', 'gleif') THEN e.p || ':verified' || CASE WHEN e.rule = 'wikidata' THEN '+wikidata' ELSE '' END
      WHEN e.p = 'classifier' THEN CASE k % 4 WHEN 0 THEN 'ror:verified' WHEN 1 THEN 'gleif:verified' WHEN 2 THEN 'input:low' ELSE 'input:provisional' END
      WHEN e.p = 'llm_tier3' THEN 'llm:provisional'
      WHEN e.p IN ('record_email', 'website_resolver', 'page_read') THEN 'web:' || CASE WHEN field = 'domain' THEN 'v' || k || '.x' WHEN e.mail THEN 'mail' || k || '.example.org' ELSE 'www.site' || k || '.example.com' END ||
        CASE WHEN e.p = 'record_email' THEN ':verified+domain' WHEN e.rule = 'unverified' THEN ':low' WHEN (k + e.i) % 4 = 0 THEN ':verified+domain' WHEN (k + e.i) % 4 = 1 THEN ':verified+registry' WHEN field = 'domain' AND k % 3 = 0 THEN ':verified+wikidata' ELSE ':provisional' END
      WHEN e.s = 'inherited' THEN CASE field WHEN 'ror_id' THEN 'ror' WHEN 'lei_id' THEN 'gleif' ELSE 'input' END || ':provisional'
      WHEN e.s = 'input_corroborated' THEN 'input:verified+' || (['web', 'wikidata', 'registry', 'web'])[((k + e.i) % 4 + 1)::INT]
      WHEN e.s = 'input_self_consistent' THEN 'input:provisional+llm' ELSE 'input:low' END scalar FROM w),
p AS (SELECT k, {", ".join(f"max(scalar) FILTER (field = '{f}') {n}_provenance, max(p = 'llm_tier3') FILTER (field = '{f}') weak_{n}, max(registry) FILTER (field = '{f}') reg_{n}" for f, n in provenance_log.SCOPED_FIELDS.items())} FROM v GROUP BY k),
j AS (SELECT c_custkey k, c_custkey % 7 + 1 n FROM customer),
t AS (SELECT k, n // 2 d, (n + 1) // 2 r FROM j WHERE k % 29 > 0)
SELECT c_custkey::VARCHAR record_id, {", ".join(f"{n}_provenance" for n in provenance_log.SCOPED_FIELDS.values())},
  array_to_string(list_filter([{", ".join(f"CASE WHEN weak_{n} THEN '{n}' END" for n in provenance_log.SCOPED_FIELDS.values())}], lambda x: x IS NOT NULL), ',') weak_fields,
  array_to_string(list_filter([{", ".join(f"CASE WHEN reg_{n} THEN '{n}' END" for n in provenance_log.SCOPED_FIELDS.values())}], lambda x: x IS NOT NULL), ',') registry_fields,
  CASE WHEN r IS NULL THEN '' ELSE CASE WHEN d > 0 THEN 'domain=' || array_to_string((['c2', 'c4', 'c6'])[:least(d, 3)::INT], '+') || '/' || greatest(d - 3, 0) || ';' ELSE '' END || 'ror_id=' || array_to_string((['c1', 'c3', 'c5'])[:least(r, 3)::INT], '+') || '/' || greatest(r - 3, 0) END rejections
FROM customer LEFT JOIN p ON p.k = c_custkey LEFT JOIN t ON t.k = c_custkey""",
}
