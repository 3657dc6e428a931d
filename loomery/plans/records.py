"""Record-quality, consensus, matching, provenance and enrichment queries on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import extract as ex
from loomery.functions import similarity as sim
from loomery.functions import text as tx
from loomery.functions import urls
from loomery.operators import consensus as cons
from loomery.operators import enrich, evaluation, issues, matching, provenance
from loomery.sources import pages as page_source


def _read(spark, sf_dir, table, *columns):
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def dirty_records(spark, sf_dir):
    """Customers as dirty records: which defects a row has follows from its key."""
    k = F.col("c_custkey")
    s = k.cast("string")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n % len(values) + 1).cast("int"))
    return _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select(
        k.alias("_seq"), s.alias("record_id"),
        pick(11, "Acme Corp", "Univ of Ohio", "Beta Gesellschaft", "Ohio University", "Gamma d/b/a Delta", None, "3M (Detroit)", "Zeta Systems", "Acme Corp").alias("name_1"),
        pick(7, None, "Chemistry Department", "of Ohio", "NMR Lab", "12345678", "Acme Corp", " ").alias("name_2"),
        F.when(k % 5 == 0, "Division of Biology").when(k % 5 == 1, "Accounts Payable").alias("name_3"), F.when(k % 13 == 0, "c/o Jane Roe").alias("name_4"), F.lit(None).cast("string").alias("name_5"),
        pick(9, "500 Main Street", "PO Box 17", "12 Lake Ave Suite 400", "Innovation Blvd", "Loading Dock 3", "100 Tech Dr Room 12B Floor 2", "University Hospital", None, "jane@acme.com").alias("street_1"),
        F.when(k % 4 == 0, "500 Main Street").when(k % 4 == 1, "POB 99").alias("street_2"), F.when(k % 17 == 0, "Suite").alias("street_3"), F.lit(None).cast("string").alias("street_4"), F.lit(None).cast("string").alias("street_5"),
        F.when(k % 6 == 0, "12").alias("house_number"), F.when(k % 10 == 0, "PO Box 5").alias("po_box"), F.when(k % 8 == 0, "Jane Roe / John Doe").when(k % 8 == 1, "Jane Roe").alias("contact"),
        pick(5, "70174", "7017", "12345-6789", "", "K1A 0B1").alias("postal_code"), pick(6, "DE", "Germany", "US", "CA", "", "XX").alias("country"),
        F.when(k % 3 == 0, "TX").alias("region"), F.when(k % 9 == 0, " ").otherwise("T").alias("search_term_1"), F.when(k % 7 == 0, "yes").alias("flag_for_review"),
    )


def issue_audit(spark, sf_dir):
    return issues.detect_issues(dirty_records(spark, sf_dir)).select("record_id", F.array_join("issues", ";").alias("issues"))


_PLAIN = ["G1-NAME-004", "G1-NAME-013", "G1-ADDR-004", "G2-VAL-001", "G2-VAL-002", "G2-VAL-004", "G2-VAL-007", "G2-VAL-008", "G3-ADDR-005", "G3-CONTACT-007", "G3-NAME-005", "G4-ADDR-008", "G4-ADDR-026", "G4-ADDR-027", "G7-VERIFY-001"]


def issue_census(spark, sf_dir):
    return issues.issue_census(issues.detect_issues(dirty_records(spark, sf_dir), _PLAIN))


def compare_report(spark, sf_dir):
    """Audits before and after: country and postal code repaired on two of three records."""
    k = F.col("_seq")
    before = dirty_records(spark, sf_dir)
    after = before.withColumns({"country": F.when(k % 3 > 0, "DE").otherwise(F.col("country")), "postal_code": F.when(k % 3 > 0, "70174").otherwise(F.col("postal_code"))})
    _, totals = evaluation.compare_issues(issues.detect_issues(before, _PLAIN), issues.detect_issues(after, _PLAIN))
    return totals.select("segment", "before", "after", F.round("reduction", 4).alias("reduction"))


def enrich_records(spark, sf_dir):
    records = enrich.spread(dirty_records(spark, sf_dir), "record_id")
    out = enrich.search_terms(enrich.finalise(enrich.process_address(enrich.preprocess(records))))
    return out.select("record_id", *enrich.NAMES, *enrich.STREETS, "contact", "email", "care_of", "po_box", "unloading_point", "suite", "room", "floor", "search_term_1", "search_term_2", "name_1_changed")


def tier_routing(spark, sf_dir):
    """Records against registry evidence made of nations (key mod 25), then counters."""
    d = dirty_records(spark, sf_dir)
    k = F.col("_seq")
    n = _read(spark, sf_dir, "nation", F.col("n_nationkey").alias("key"), F.concat(F.lit("Reg "), "n_name").alias("name"))
    d = enrich.join_evidence(d, n.filter("key < 5"), (k % 25).cast("int"), "ror")
    d = enrich.join_evidence(d, n.filter("key between 5 and 9"), (k % 25).cast("int"), "lei")
    d = enrich.join_evidence(d, n.filter("key between 10 and 11"), (k % 25).cast("int"), "wikidata")
    d = enrich.join_evidence(d, n.filter("key between 12 and 15"), (k % 25).cast("int"), "proposal")
    return enrich.summarise(enrich.route_tiers(d))


def consensus_records(spark, sf_dir):
    k = F.col("c_custkey")
    p = _read(spark, sf_dir, "part", "p_partkey", "p_name")
    return _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(p, F.pmod(k, F.lit(30)) == F.col("p_partkey")).select(
        k.alias("_seq"), k.cast("string").alias("record_id"), F.lit("DE").alias("country"), F.when(k % 50 > 0, "12345").alias("postal_code"), F.when(k % 50 > 0, F.concat(F.lit("Street "), F.col("c_nationkey").cast("string"))).alias("street_cleaned"), F.lit("1").alias("house_number"),
        F.concat("p_name", F.when(k % 4 == 0, " Inc").when(k % 4 == 1, " incorporated").when(k % 4 == 2, "").otherwise(F.when(k % 3 == 0, " LLC").otherwise(" Inc"))).alias("name1_enriched"),
        F.when(k % 9 == 0, F.concat(F.lit("ror"), (k % 2).cast("string"))).alias("ror_id"), F.lit(None).cast("string").alias("lei_id"), F.when(k % 6 == 0, F.concat(F.lit("d"), (k % 30).cast("string"))).alias("domain"), F.when(k % 6 == 0, F.concat(F.lit("http://d"), (k % 30).cast("string"))).alias("website_url"),
        F.when(k % 5 == 0, "company").otherwise("unknown").alias("record_type"), (k % 3 + 1).cast("int").alias("tier_used"))


def consensus_groups(spark, sf_dir):
    g = cons.consensus_groups(consensus_records(spark, sf_dir), tx.fold_key)
    return g.select("record_id", "group_id")


def consensus_values(spark, sf_dir):
    return cons.apply_consensus(consensus_records(spark, sf_dir), tx.fold_key).select("record_id", *cons.PROPAGATED, "consensus")


def url_domains(spark, sf_dir):
    p = _read(spark, sf_dir, "pages", "page_id", "url")
    u = F.col("url")
    return p.select("page_id", urls.host_without_www(u).alias("host"), urls.domain(u).alias("domain"), urls.domain_label(urls.domain(u)).alias("label"), urls.tld(urls.domain(u)).alias("tld"), urls.host_depth(u).alias("depth"), urls.path_penalty(u).alias("penalty"), urls.country_conflict(F.concat(F.lit("a."), F.element_at(F.array(F.lit("de"), F.lit("fr"), F.lit("com")), (F.col("page_id") % 3 + 1).cast("int"))), F.lit("DE")).alias("conflict"))


def domain_ownership(spark, sf_dir):
    k = F.col("page_id")
    p = _read(spark, sf_dir, "pages", "page_id", "url")
    sites = F.array(F.struct(F.lit("ror").alias("witness"), F.when(k % 4 == 0, F.col("url")).alias("website")))
    email = F.when(k % 4 == 1, F.concat(F.lit("x@"), urls.domain(F.col("url")))).when(k % 4 == 2, "x@gmail.com")
    d = urls.resolve_domain(F.col("url"), sites, email, F.lit("US"), F.when(k % 3 == 0, "Welcome to Acme Systems").otherwise("Home"), F.lit("Acme Systems Inc"))
    return p.select("page_id", d.alias("d")).select("page_id", "d.domain", "d.verified_by", "d.rejected_by")


def page_parse(spark, sf_dir):
    return page_source.parse_pages(_read(spark, sf_dir, "pages"))


def website_rank(spark, sf_dir):
    """Pages as search results of 20 queries; name taken from the host's own first word."""
    k = F.col("page_id")
    r = _read(spark, sf_dir, "pages", "page_id", "url").select((k % 20).cast("int").alias("q"), "url", F.floor(k / 20).cast("int").alias("rank"), F.lit("Example Hall").alias("name"), F.lit("US").alias("country"), F.lit("Berlin").alias("city"), F.when(k % 3 == 0, "in Berlin").alias("snippet"))
    return matching.rank_websites(r, "q", "name", "country", "city").filter("place <= 3").select("q", "place", "url")


def registry_rank(spark, sf_dir):
    k = F.col("s_suppkey")
    c = _read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(F.col("s_nationkey").alias("q"), F.concat(F.lit("L"), F.lpad(k.cast("string"), 9, "0")).alias("candidate_id"), F.round(F.lit(80.0) + F.pmod(F.col("s_acctbal"), F.lit(20.0)), 2).alias("score"), (k % 4 > 0).alias("active"), (k % 3 == 0).alias("region_agrees"), (k % 7 > 0).alias("country_ok"))
    return matching.rank_registry(c, "q")


def locality(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (k % n + 1).cast("int"))
    a = {"city": pick(3, "Austin", "austin ", None), "region": pick(4, "US-TX", "Texas", "CA", None), "country": pick(5, "US", "us", "DE", None, "US"), "postal_code": pick(7, "73301-1234", None, "1", "2", "3", "4", "5")}
    b = {"city": pick(2, "Austin", "Dallas"), "region": F.lit("TX"), "country": F.lit("US"), "postal_code": F.lit("73301")}
    v = matching.compare_locality(a, b, {"tx": "texas", "ca": "california"})
    return _read(spark, sf_dir, "customer", "c_custkey").select("c_custkey", v.alias("v")).select("c_custkey", "v.verdict", "v.scope")


def token_sort(spark, sf_dir):
    """Fuzzy score of every part name against the next one by key."""
    p = _read(spark, sf_dir, "part", "p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select("p_partkey", F.round(sim.token_sort_ratio("p_name", "other"), 6).alias("score"), F.round(sim.jaro_winkler("p_name", "other"), 6).alias("jw"), F.round(sim.ratio("p_name", "other"), 6).alias("ratio"))


def extract_contacts(spark, sf_dir):
    d = _read(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", ex.email(F.col("text")).alias("email"), urls.email_domain(F.col("text")).alias("email_domain"), ex.phone(F.col("text")).alias("phone"), F.size(F.regexp_extract_all("text", F.lit(f"({ex.EMAIL})"), F.lit(1))).alias("n_emails"))


def name_forms(spark, sf_dir):
    p = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    n = F.concat(F.initcap("p_name"), F.lit(" of "), F.initcap("p_type"))
    return p.select("p_partkey", tx.name_initials(n).alias("initials"), tx.derive_acronym(n).alias("acronym"), tx.first_significant_words(n).alias("handle"), tx.truncate_text(n, 10).alias("short"), tx.canonicalise_unit(F.concat(F.initcap("p_type"), F.lit(" Dept."))).alias("unit"), tx.strip_parentheticals(F.concat(n, F.lit(" (US)"))).alias("plain"))


def wrapped_names(spark, sf_dir):
    d = _read(spark, sf_dir, "documents", "doc_id", "text")
    r = tx.repack_names([F.col("text"), F.lit(None).cast("string"), F.lit("x"), F.lit(None).cast("string"), F.lit(None).cast("string")])
    return d.select("doc_id", r.alias("r"), sim.smart_title_case(F.upper("text")).alias("titled")).select("doc_id", F.array_join("r.names", "|").alias("names"), F.size("r.overflow").alias("overflow"), "titled")


def provenance_writes(spark, sf_dir):
    e = _read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    last = provenance.last_write(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")
    first = provenance.first_write(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", F.col("event_id").alias("first_id"))
    return last.join(first, ["user_id", "event_type"])


def rejections(spark, sf_dir):
    e = _read(spark, sf_dir, "events", "event_id", "user_id", "event_type").filter("event_type in ('error', 'view')")
    return provenance.keep_rejections(e, ["user_id", "event_type"], "event_id")


def confidence_flags(spark, sf_dir):
    k = F.col("event_id")
    is_ = lambda n: k % n == 0
    witness = F.when(is_(5), "wikidata").when(is_(7), "llm")
    c = provenance.confidence(is_(11), is_(13), is_(3), is_(6), witness, is_(2), is_(4))
    f = provenance.flags({"overflow": is_(10), "opaque-code": is_(15), "no-match": is_(2), "email-conflict": is_(9), "domain-unverified": is_(21)})
    e = _read(spark, sf_dir, "events", "event_id").select("event_id", provenance.scalar(F.lit("ror"), c).alias("provenance"), F.array_join(f, ";").alias("flags"))
    return e.withColumn("valid", provenance.is_valid(F.col("provenance")))


def json_claims(spark, sf_dir):
    e = _read(spark, sf_dir, "events", "event_id", "props")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def cache_lookup(spark, sf_dir):
    """Names looked up in a store keyed by folded name; a miss is null."""
    p = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    store = p.filter("p_partkey % 3 = 0").groupBy(tx.fold_key(F.col("p_name")).alias("key")).agg(F.min("p_brand").alias("brand"), F.count("*").alias("hits"))
    return enrich.join_evidence(p.select("p_partkey", F.upper("p_name").alias("name")), store, tx.fold_key(F.col("name")), "store").select("p_partkey", "store_brand", "store_hits")


QUERIES = {f.__name__: f for f in (issue_audit, issue_census, compare_report, enrich_records, tier_routing, consensus_groups, consensus_values, url_domains, domain_ownership, page_parse, website_rank, registry_rank, locality, token_sort, extract_contacts, name_forms, wrapped_names, provenance_writes, rejections, confidence_flags, json_claims, cache_lookup)}

_DIRTY = """
WITH d AS (
  SELECT c_custkey k,
    (['Acme Corp', 'Univ of Ohio', 'Beta Gesellschaft', 'Ohio University', 'Gamma d/b/a Delta', NULL, '3M (Detroit)', 'Zeta Systems', 'Acme Corp'])[(c_custkey % 11 % 9 + 1)::INT] n1,
    nullif(trim((['', 'Chemistry Department', 'of Ohio', 'NMR Lab', '12345678', 'Acme Corp', ' '])[(c_custkey % 7 + 1)::INT]), '') n2,
    c_custkey % 5 < 2 h3, c_custkey % 13 = 0 h4,
    c_custkey % 9 s1, c_custkey % 4 s2, c_custkey % 17 = 0 s3, c_custkey % 10 = 0 pb, c_custkey % 8 = 0 multi,
    (['70174', '7017', '12345-6789', '', 'K1A 0B1'])[(c_custkey % 5 + 1)::INT] pc, (['DE', 'Germany', 'US', 'CA', '', 'XX'])[(c_custkey % 6 + 1)::INT] cc,
    c_custkey % 3 = 0 region, c_custkey % 9 = 0 nost, c_custkey % 7 = 0 flag
  FROM customer),
a AS (SELECT *, pc pc1, cc cc1 FROM d UNION ALL BY NAME SELECT * FROM (SELECT *, NULL pc1, NULL cc1 FROM d WHERE false))
"""
_CODES = """
  SELECT k, unnest(list_filter([
    CASE WHEN (n2 IS NULL AND n1 IS NOT NULL AND (h3 OR h4)) OR (NOT h3 AND (n1 IS NOT NULL OR n2 IS NOT NULL) AND h4) THEN 'G1-NAME-004' END,
    CASE WHEN n2 = '12345678' THEN 'G1-NAME-013' END, CASE WHEN s1 = 1 OR s2 = 1 THEN 'G1-ADDR-004' END,
    CASE WHEN n1 IS NULL THEN 'G2-VAL-001' END, CASE WHEN p = '' THEN 'G2-VAL-002' END, CASE WHEN NOT region THEN 'G2-VAL-004' END, CASE WHEN nost THEN 'G2-VAL-007' END, CASE WHEN c = '' THEN 'G2-VAL-008' END,
    CASE WHEN (s1 = 1)::INT + (s2 = 1)::INT + pb::INT >= 2 THEN 'G3-ADDR-005' END, CASE WHEN multi THEN 'G3-CONTACT-007' END, CASE WHEN n1 = n2 THEN 'G3-NAME-005' END, CASE WHEN s3 THEN 'G4-ADDR-008' END,
    CASE WHEN p <> '' AND ((c IN ('DE', 'Germany') AND NOT regexp_full_match(p, '\\d{5}')) OR (c = 'US' AND NOT regexp_full_match(p, '\\d{5}(-\\d{4})?')) OR (c = 'CA' AND NOT regexp_full_match(p, '[A-Za-z]\\d[A-Za-z] ?\\d[A-Za-z]\\d'))) THEN 'G4-ADDR-026' END,
    CASE WHEN c IN ('Germany', 'XX') THEN 'G4-ADDR-027' END, CASE WHEN flag THEN 'G7-VERIFY-001' END], lambda x: x IS NOT NULL)) code FROM x
"""
_BEFORE = _DIRTY + ", x AS (SELECT *, pc p, cc c FROM d), b AS (" + _CODES + ")"
_SEG = "CASE WHEN code IN ('G2-VAL-001', 'G2-VAL-003', 'G2-VAL-006', 'G2-NAME-012') THEN 'persistent' WHEN code LIKE 'G7%' THEN 'verification' ELSE 'reduced' END"
_CONS = """
WITH r AS (
  SELECT c_custkey k, c_custkey::VARCHAR record_id, c_custkey % 50 > 0 addressed, sha1('de|12345|street ' || c_nationkey || '|1') h,
    p_name || CASE c_custkey % 4 WHEN 0 THEN ' Inc' WHEN 1 THEN ' incorporated' WHEN 2 THEN '' ELSE CASE WHEN c_custkey % 3 = 0 THEN ' LLC' ELSE ' Inc' END END name1_enriched, lower(p_name) base,
    CASE WHEN c_custkey % 4 = 2 THEN '' WHEN c_custkey % 4 = 3 AND c_custkey % 3 = 0 THEN 'llc' ELSE 'inc' END form,
    CASE WHEN c_custkey % 9 = 0 THEN 'ror' || (c_custkey % 2) END ror_id, CASE WHEN c_custkey % 6 = 0 THEN 'd' || (c_custkey % 30) END "domain", CASE WHEN c_custkey % 6 = 0 THEN 'http://d' || (c_custkey % 30) END website_url,
    CASE WHEN c_custkey % 5 = 0 THEN 'company' ELSE 'unknown' END record_type, c_custkey % 3 + 1 tier
  FROM customer JOIN part ON c_custkey % 30 = p_partkey),
f AS (SELECT *, count(DISTINCT nullif(form, '')) OVER (PARTITION BY h, addressed, base) forms FROM r),
g AS (SELECT *, CASE WHEN addressed AND (forms <= 1 OR form <> '') THEN 'blk-' || substr(h, 1, 12) || '|' || base || '|' || CASE WHEN forms <= 1 THEN '' ELSE form END END group_id FROM f)
"""
_DUP = "regexp_extract(url, '://([^/?#:]*)', 1)"
ORACLE_SQL = {
    "issue_census": _BEFORE + "SELECT code, count(*) records FROM b GROUP BY 1",
    "compare_report": _BEFORE + ", y AS (SELECT *, CASE WHEN k % 3 > 0 THEN '70174' ELSE pc END p, CASE WHEN k % 3 > 0 THEN 'DE' ELSE cc END c FROM d), q AS (" + _CODES.replace("FROM x", "FROM y") + f"""),
u AS (SELECT code, 1 s FROM b UNION ALL SELECT code, 2 FROM q), t AS (SELECT {_SEG} segment, count(*) FILTER (s = 1) "before", count(*) FILTER (s = 2) "after" FROM u GROUP BY 1)
SELECT *, CASE WHEN segment = 'reduced' AND "before" > 0 THEN round(100.0 * ("before" - "after") / "before", 4) ELSE 0 END reduction FROM t""",
    "tier_routing": _DIRTY + """, t AS (SELECT k % 25 m, n1, coalesce(regexp_matches(n1, 'University|Institut'), false) res FROM d),
r AS (SELECT *, CASE WHEN m < 5 THEN 1 WHEN m BETWEEN 5 AND 9 AND NOT res THEN 1 WHEN m BETWEEN 10 AND 11 THEN 1 WHEN m BETWEEN 12 AND 15 AND NOT res THEN 2 END tier FROM t)
SELECT count(*) total, count(*) FILTER (tier IS NOT NULL) enriched, 0 verified, count(*) FILTER (tier IS NULL) unresolved, count(*) FILTER (tier = 1) tier1, count(*) FILTER (tier = 2) tier2 FROM r""",
    "consensus_groups": _CONS + "SELECT record_id, group_id FROM g",
    "consensus_values": _CONS + """, m AS (SELECT *, coalesce(group_id, 'row|' || k) gg, (ror_id IS NOT NULL)::INT ids, nullif(record_type, 'unknown') ty FROM g),
fc AS (SELECT gg, name1_enriched n, count(*) c, {'t': min(tier), 'k': min(k)} f FROM m GROUP BY 1, 2), mo AS (SELECT gg, arg_min(n, {'c': -c, 'f': f}) modal FROM fc GROUP BY 1),
ag AS (SELECT gg, count(*) mem, count(DISTINCT ror_id) > 1 conf, max(ids) > 0 reg, arg_min({'n': name1_enriched, 'd': "domain", 'w': website_url, 't': ty}, {'t': tier, 'k': k}) FILTER (ids > 0) dn,
  max(ror_id) ror, CASE WHEN count(DISTINCT "domain") = 1 THEN max("domain") END sd, CASE WHEN count(DISTINCT ty) = 1 THEN max(ty) END st, arg_min(website_url, k) FILTER ("domain" IS NOT NULL) sw FROM m GROUP BY 1),
j AS (SELECT m.*, ag.*, modal, mem >= 2 AND NOT conf wr FROM m JOIN ag ON m.gg = ag.gg JOIN mo ON m.gg = mo.gg)
SELECT record_id, CASE WHEN wr THEN CASE WHEN reg THEN dn.n ELSE modal END ELSE name1_enriched END name1_enriched, CASE WHEN wr THEN ror ELSE ror_id END ror_id, NULL::VARCHAR lei_id,
  CASE WHEN wr THEN coalesce(CASE WHEN reg THEN dn.d END, sd, "domain") ELSE "domain" END "domain",
  CASE WHEN wr THEN coalesce(CASE WHEN reg AND dn.d IS NOT NULL THEN dn.w WHEN sd IS NOT NULL THEN sw END, website_url) ELSE website_url END website_url,
  CASE WHEN wr THEN coalesce(CASE WHEN reg THEN dn.t END, st, record_type) ELSE record_type END record_type,
  CASE WHEN mem < 2 THEN NULL WHEN conf THEN 'conflict' WHEN reg THEN 'registry' ELSE 'name_form' END consensus FROM j""",
    "url_domains": rf"""WITH p AS (SELECT page_id, url, regexp_replace(lower({_DUP}), '^www\.', '') host, regexp_extract(url, '^[^/?#]*://[^/?#]*([^?#]*)', 1) path FROM pages)
SELECT page_id, host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) "domain", regexp_extract(host, '([^.]+)\.[^.]+$', 1) label, regexp_extract(host, '([^.]+)$', 1) tld, len(string_split(host, '.'))::INT depth,
  (len(list_filter(string_split(path, '/'), lambda s: s <> '')) + regexp_matches(path, '/(19|20)\d\d(/|$)')::INT + regexp_matches(path, '\.(html?|php|aspx?|pdf)$')::INT)::INT penalty, page_id % 3 = 1 conflict FROM p""",
    "domain_ownership": rf"""WITH p AS (SELECT page_id k, regexp_extract(lower({_DUP}), '([^.]+\.[^.]+)$', 1) d FROM pages),
v AS (SELECT k, d, CASE WHEN k % 4 = 0 THEN 'registry' WHEN k % 4 = 1 THEN 'email' WHEN k % 3 = 0 THEN 'title' END verified_by FROM p)
SELECT k page_id, CASE WHEN verified_by IS NOT NULL THEN d END "domain", verified_by, CASE WHEN verified_by IS NULL THEN 'no_evidence' END rejected_by FROM v""",
    "website_rank": rf"""WITH p AS (SELECT (page_id % 20)::INT q, url, (page_id // 20)::INT rank, page_id % 3 = 0 near, regexp_replace(lower({_DUP}), '^www\.', '') host FROM pages),
r AS (SELECT q, url, row_number() OVER (PARTITION BY q ORDER BY rank, near DESC, len(string_split(host, '.')), url) place FROM p WHERE contains(host, 'example') OR contains(host, 'hall'))
SELECT q, place::INT place, url FROM r WHERE place <= 3""",
    "registry_rank": """WITH c AS (SELECT s_nationkey q, 'L' || lpad(s_suppkey::VARCHAR, 9, '0') candidate_id, round(80.0 + (((s_acctbal % 20) + 20) % 20), 2) score, s_suppkey % 4 > 0 a, s_suppkey % 3 = 0 r FROM supplier WHERE s_suppkey % 7 > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score >= 88 DESC, a DESC, r DESC, score DESC, candidate_id) n FROM c), w AS (SELECT * FROM p WHERE n = 1),
x AS (SELECT w.q, w.candidate_id, w.score, max(p.score) FILTER (p.n > 1 AND p.a = w.a AND (NOT w.r OR p.r)) runner_up FROM w JOIN p ON w.q = p.q GROUP BY 1, 2, 3)
SELECT q, candidate_id, score, runner_up, coalesce(abs(score - runner_up) < 2.0, false) ambiguous FROM x WHERE score >= 88""",
    "locality": """WITH l AS (SELECT c_custkey, c_custkey % 7 = 0 pm, (['us', 'us', 'de', '', 'us'])[(c_custkey % 5 + 1)::INT] sk, (['texas', 'texas', 'california', ''])[(c_custkey % 4 + 1)::INT] sr, (['austin', 'austin', ''])[(c_custkey % 3 + 1)::INT] sc, CASE WHEN c_custkey % 2 = 0 THEN 'austin' ELSE 'dallas' END rc FROM customer)
SELECT c_custkey, CASE WHEN pm THEN 'consistent' WHEN sk = 'de' OR sr = 'california' THEN 'contradicted' WHEN sc <> '' THEN CASE WHEN sc = rc THEN 'consistent' ELSE 'contradicted' END WHEN sr <> '' THEN 'consistent' ELSE 'neutral' END verdict,
  CASE WHEN pm THEN 'postal' WHEN sk = 'de' THEN 'country' WHEN sr = 'california' THEN 'region' WHEN sc <> '' THEN 'city' WHEN sr <> '' THEN 'region' END scope FROM l""",
    "extract_contacts": r"""WITH d AS (SELECT doc_id, text, nullif(regexp_extract(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'), '') email FROM documents)
SELECT doc_id, email, regexp_extract(lower(regexp_extract(email, '@(.*)$', 1)), '([^.]+\.[^.]+)$', 1) email_domain, nullif(regexp_extract(text, '(?:\+\d{1,3}[\s.\-]?)?(?:\(\d{2,4}\)|\b\d{3})[\s.\-]\d{3}[\s.\-]\d{4}\b'), '') phone, len(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'))::INT n_emails FROM d""",
    "name_forms": r"""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') a, upper(p_type[1]) || lower(substr(p_type, 2)) t FROM part), c AS (SELECT p_partkey, list_transform(a, lambda x: upper(x[1]) || lower(substr(x, 2))) a, t FROM w),
n AS (SELECT p_partkey, a, t, array_to_string(a, ' ') || ' of ' || t n FROM c)
SELECT p_partkey, array_to_string(list_transform(list_append(a, t), lambda x: x[1]), '') initials, array_to_string(list_transform(list_append(a, t), lambda x: x[1]), '') acronym, a[1] || ' ' || list_append(a, t)[2] handle, CASE WHEN length(n) > 10 THEN substr(n, 1, 9) || '…' ELSE n END short, 'Department of ' || t unit, n plain FROM n""",
    "provenance_writes": "SELECT user_id, event_type, max(event_id) event_id, arg_max(value, event_id) value, min(event_id) first_id FROM events GROUP BY 1, 2",
    "rejections": "SELECT user_id, event_type, event_id, place::INT place, greatest(n - 3, 0) omitted FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) place, count(*) OVER (PARTITION BY user_id, event_type) n FROM events WHERE event_type IN ('error', 'view')) WHERE place <= 3",
    "confidence_flags": """WITH e AS (SELECT event_id k, CASE WHEN event_id % 5 = 0 THEN 'wikidata' WHEN event_id % 7 = 0 THEN 'llm' END w FROM events),
c AS (SELECT k, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 'ror:low' WHEN k % 3 = 0 THEN 'ror:verified' || CASE WHEN k % 6 = 0 THEN '+wikidata' ELSE '' END WHEN w = 'wikidata' THEN 'ror:verified+wikidata' WHEN k % 2 = 0 THEN 'ror:provisional' || CASE WHEN k % 4 = 0 THEN '+llm' ELSE '' END ELSE 'ror:low' END p FROM e),
f AS (SELECT k, p, list_filter([CASE WHEN k % 10 = 0 THEN 'overflow' END, CASE WHEN k % 15 = 0 THEN 'opaque-code' END, CASE WHEN k % 2 = 0 AND NOT (k % 10 = 0 OR k % 15 = 0 OR k % 9 = 0 OR k % 21 = 0) THEN 'no-match' END, CASE WHEN k % 9 = 0 THEN 'email-conflict' END, CASE WHEN k % 21 = 0 THEN 'domain-unverified' END], lambda x: x IS NOT NULL) l FROM c)
SELECT k event_id, p provenance, coalesce(array_to_string(l, ';'), '') flags, true "valid" FROM f""",
    "json_claims": "SELECT (props->>'k')::INT k, count(*) n FROM events GROUP BY 1",
    "cache_lookup": "SELECT p.p_partkey, s.brand store_brand, s.hits store_hits FROM part p LEFT JOIN (SELECT lower(p_name) k, min(p_brand) brand, count(*) hits FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) s ON lower(p.p_name) = s.k",
}
