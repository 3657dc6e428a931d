"""Verification and verdict queries on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.operators import provenance, registry_names, verdicts, verification
from loomery.plans.records import dirty_records
from loomery.sources import evidence


def _read(spark, sf_dir, table, *columns):
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def source_gate(spark, sf_dir):
    """Part names as two registries' answers; the worse one loses where they differ."""
    k = F.col("p_partkey")
    p = _read(spark, sf_dir, "part", "p_partkey", "p_name").select(k.alias("record_id"), F.col("p_name").alias("name_1"), F.when(k % 3 > 0, F.col("p_name")).otherwise("unrelated company zzz").alias("ror_name"), F.when(k % 5 > 0, F.col("p_name")).otherwise("qqqq vvvv").alias("lei_name"), k.cast("string").alias("ror_id"), k.cast("string").alias("lei_id"))
    return verification.gate_sources(p).select("record_id", "ror_name", "lei_name", "ror_id", "lei_id", "dropped_source")


def name_agreement(spark, sf_dir):
    p = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    a, b = F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.initcap("p_name"), F.lit(" Inc"))).otherwise(F.concat("p_type", F.lit(" "), "p_name"))
    return p.select("p_partkey", verification.match_verbatim(a, b).alias("verbatim"), verification.phrase_in_title(a, b).alias("phrase"), verdicts.keeps_subject(a, b).alias("keeps"))


def overflow_merge(spark, sf_dir):
    """Verdicts: every pair whose record's key is even is one name."""
    d = dirty_records(spark, sf_dir)
    v = verdicts.overflow_pairs(d).select("record_id", "upper_slot", (F.col("record_id").cast("long") % 2 == 0).alias("is_overflow"))
    return verdicts.merge_overflow(d, v).select("record_id", "name_1", "name_2", "name_3", "name_4")


def grammar_census(spark, sf_dir):
    e = _read(spark, sf_dir, "events", "event_id").select(F.when(F.col("event_id") % 2 == 0, "ror:verified").when(F.col("event_id") % 3 == 0, "tier1").alias("p"))
    return verification.grammar_census(e, "p")


def page_outcomes(spark, sf_dir):
    """Do pages name the label of their own host?"""
    p = _read(spark, sf_dir, "pages", "page_id", "url", "html")
    label = F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^./]+)", 1)
    place = F.struct(F.when(F.col("page_id") % 4 == 0, "contradicted").otherwise("neutral").alias("verdict"))
    return p.select("page_id", verification.page_outcome(F.lit(""), F.lit(""), F.col("html"), label, place).alias("outcome"))


def store_keys(spark, sf_dir):
    p = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    return p.select("p_partkey", evidence.registry_key(F.col("p_name"), F.lit("de")).alias("registry"), evidence.search_key(F.concat(F.lit('"'), "p_name", F.lit('"')), F.lit("us")).alias("search"), evidence.http_key(F.lit("http://x"), F.create_map(F.lit("q"), F.col("p_brand"), F.lit("a"), F.lit("1"))).alias("http"), evidence.request_key(F.col("p_name"), F.col("p_brand")).alias("request"))


def folded_names(spark, sf_dir):
    """Words of texts folded and compared as sets with the next document's."""
    d = _read(spark, sf_dir, "documents", "doc_id", "text")
    words = lambda c: F.filter(F.split(tx.fold_key(F.col(c)), " "), lambda w: w.rlike("^[a-z]+$"))
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(n, "doc_id").select("doc_id", F.round(tx.jaccard(words("text"), words("other")), 6).alias("jaccard"))


def registry_entries(spark, sf_dir):
    """Parts as records, four registry entries each: one with more words, one with a word that isn't theirs, one known by an alias, one by an acronym alone."""
    name = F.concat(F.initcap("p_name"), F.lit(" Polymer Institute of Technology"))
    named = lambda value, kind: F.struct(value.alias("value"), F.array(F.lit(kind)).alias("types"))
    entry = lambda k, status, *names: F.struct(F.lit(k).alias("entry"), F.lit(status).alias("status"), F.array(*names).alias("names"))
    more, other = F.concat(name, F.lit(" Foundation")), F.concat(F.initcap("p_name"), F.lit(" Zzyxw Institute of Technology"))
    entries = F.array(
        entry("a", "inactive", named(more, "ror_display")), entry("b", "active", named(other, "label")), entry("c", "active", named(F.lit("Qqv Wwx"), "ror_display"), named(F.upper(name), "alias")), entry("d", "active", named(F.lit("SRPI"), "acronym")),
    )
    p = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", name.alias("name"), F.col("p_brand").alias("city"), F.explode(entries).alias("e"))
    return p.select("p_partkey", "name", "city", "e.*")


def registry_score(spark, sf_dir):
    scored = registry_names.score_entries(registry_entries(spark, sf_dir), "name", "names", ["city"])
    return scored.select("p_partkey", "entry", "score", F.array_join("guards", ";").alias("guards"))


def registry_best(spark, sf_dir):
    """The better of two open entries, or with the closed one among them."""
    e = registry_entries(spark, sf_dir).filter((F.col("p_partkey") % 3 > 0) | (F.col("entry") != "a")).filter((F.col("p_partkey") % 5 > 0) | ~F.col("entry").isin("a", "c"))
    return registry_names.best_entry(registry_names.score_entries(e, "name", "names", ["city"]), "p_partkey", "entry", "status")


def registry_queries(spark, sf_dir):
    """Customers' names in the forms that a registry is asked for."""
    k = F.col("c_custkey")
    tail = F.concat(F.lit(" "), F.lower("c_mktsegment"))
    name = F.when(k % 4 == 0, F.concat(F.lit("Fla. State Univ"), tail)).when(k % 4 == 1, F.concat(F.lit("GA Tech"), tail)).when(k % 4 == 2, F.concat(F.lit("tx State University"), tail, F.lit(" (Germany)"))).otherwise(F.concat(F.lit("HI Tech"), tail, F.lit(", Rahway, NJ, USA")))
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select("c_custkey", name.alias("n"))
    return c.select("c_custkey", registry_names.expand_states(F.col("n")).alias("states"), registry_names.expand_institutions(F.col("n")).alias("institutions"), registry_names.strip_country(F.col("n")).alias("bare"), F.array_join(registry_names.required_acronyms(F.col("n")), " ").alias("acronyms"))


def confidence_bands(spark, sf_dir):
    """Orders as scored fields on changing scales, with the status that follows."""
    k = F.col("o_orderkey")
    scale = F.element_at(F.array(*[F.lit(s) for s in ("ror_local", "fuzzy_ratio", "llm_self_reported", "registry_exact", "deterministic", "other")]), (k % 6 + 1).cast("int"))
    value = F.when(k % 11 > 0, (k % 101) / F.when(k % 6 == 1, 1).otherwise(100))
    state = F.when(k % 2 == 0, "unresolved").otherwise("unchanged-verified")
    current = F.when(k % 7 == 0, "enriched").when(k % 7 == 1, "failed")
    return _read(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", provenance.confidence_band(scale, value).alias("band"), provenance.status_after(state, current).alias("status"))


QUERIES = {f.__name__: f for f in (source_gate, name_agreement, overflow_merge, grammar_census, page_outcomes, store_keys, folded_names, registry_score, registry_best, registry_queries, confidence_bands)}
ORACLE_SQL = {
    "source_gate": """SELECT p_partkey record_id, CASE WHEN p_partkey % 3 > 0 THEN p_name WHEN p_partkey % 5 > 0 THEN NULL ELSE ror END ror_name, CASE WHEN p_partkey % 5 > 0 THEN p_name WHEN p_partkey % 3 > 0 THEN NULL ELSE lei END lei_name,
        CASE WHEN p_partkey % 3 > 0 OR (p_partkey % 5 = 0 AND ror IS NOT NULL) THEN p_partkey::VARCHAR END ror_id, CASE WHEN p_partkey % 5 > 0 OR (p_partkey % 3 = 0 AND lei IS NOT NULL) THEN p_partkey::VARCHAR END lei_id,
        CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 > 0 THEN NULL WHEN p_partkey % 3 > 0 THEN 'lei' WHEN p_partkey % 5 > 0 THEN 'ror' WHEN ror IS NULL THEN 'ror' ELSE 'lei' END dropped_source
        FROM (SELECT *, 'unrelated company zzz' ror, NULL lei FROM part)""",
    "overflow_merge": """WITH d AS (SELECT c_custkey k, (['Acme Corp', 'Univ of Ohio', 'Beta Gesellschaft', 'Ohio University', 'Gamma d/b/a Delta', NULL, '3M (Detroit)', 'Zeta Systems', 'Acme Corp'])[(c_custkey % 11 % 9 + 1)::INT] n1,
        (['', 'Chemistry Department', 'of Ohio', 'NMR Lab', '12345678', 'Acme Corp', ' '])[(c_custkey % 7 + 1)::INT] n2, CASE c_custkey % 5 WHEN 0 THEN 'Division of Biology' WHEN 1 THEN 'Accounts Payable' END n3, CASE WHEN c_custkey % 13 = 0 THEN 'c/o Jane Roe' END n4 FROM customer),
      f AS (SELECT *, coalesce(k % 2 = 0 AND n1 IS NOT NULL AND NOT regexp_matches(n1, ' Corp$') AND n2 = 'of Ohio', false) m12, coalesce(k % 2 = 0 AND trim(n2) <> '' AND NOT regexp_matches(n2, ' Corp$') AND regexp_matches(n3, '^[a-z]'), false) m23, coalesce(k % 2 = 0 AND n3 IS NOT NULL AND n4 IS NOT NULL, false) m34 FROM d),
      l AS (SELECT k, n1, CASE WHEN n2 = '' THEN NULL ELSE n2 END n2, n3, n4, m12, m34, list_filter([CASE WHEN m12 THEN n1 || ' of Ohio' ELSE n1 END, CASE WHEN m12 THEN NULL ELSE nullif(trim(n2), '') END, CASE WHEN m34 THEN n3 || ' ' || n4 ELSE n3 END, CASE WHEN m34 THEN NULL ELSE n4 END], lambda x: x IS NOT NULL) p FROM f)
      SELECT k::VARCHAR record_id, CASE WHEN m12 OR m34 THEN p[1] ELSE n1 END name_1, CASE WHEN m12 OR m34 THEN p[2] ELSE n2 END name_2, CASE WHEN m12 OR m34 THEN p[3] ELSE n3 END name_3, CASE WHEN m12 OR m34 THEN p[4] ELSE n4 END name_4 FROM l""",
    "name_agreement": "SELECT p_partkey, p_partkey % 2 = 0 verbatim, true phrase, true keeps FROM part",
    "registry_score": """SELECT p_partkey, e.entry, e.score, e.guards FROM part, (VALUES ('a', 1.0::DOUBLE, ''), ('b', 0.7, 'distinctive_token'), ('c', 1.0, ''), ('d', 0.0, '')) e(entry, score, guards)""",
    "registry_best": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'c' ELSE 'a' END entry, CASE WHEN p_partkey % 5 = 0 THEN 0.7 ELSE 1.0 END::DOUBLE score, p_partkey % 5 > 0 AND p_partkey % 3 > 0 dead FROM part""",
    "registry_queries": """WITH c AS (SELECT c_custkey, c_custkey % 4 k, ' ' || lower(c_mktsegment) t FROM customer)
      SELECT c_custkey, CASE k WHEN 0 THEN 'Florida State Univ' || t WHEN 1 THEN 'GA Tech' || t WHEN 2 THEN 'Texas State University' || t || ' (Germany)' ELSE 'HI Tech' || t || ', Rahway, NJ, USA' END states,
        CASE k WHEN 0 THEN 'Fla. State Univ' || t WHEN 1 THEN 'Georgia Institute of Technology' || t WHEN 2 THEN 'tx State University' || t || ' (Germany)' ELSE 'HI Tech' || t || ', Rahway, NJ, USA' END institutions,
        CASE k WHEN 0 THEN 'Fla. State Univ' || t WHEN 1 THEN 'GA Tech' || t WHEN 2 THEN 'tx State University' || t ELSE 'HI Tech' || t END bare, CASE k WHEN 1 THEN 'ga' WHEN 3 THEN 'hi nj usa' ELSE '' END acronyms FROM c""",
    "confidence_bands": """WITH o AS (SELECT o_orderkey, o_orderkey % 6 s, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 101) / CASE WHEN o_orderkey % 6 = 1 THEN 1.0 ELSE 100.0 END END v, o_orderkey % 7 c, o_orderkey % 2 u FROM orders)
      SELECT o_orderkey, CASE s WHEN 0 THEN CASE WHEN v IS NULL THEN 'unscored' WHEN v >= 0.999 THEN 'exact' WHEN v >= 0.9 THEN 'high' WHEN v >= 0.75 THEN 'medium' ELSE 'low' END
        WHEN 1 THEN CASE WHEN v IS NULL THEN 'unscored' WHEN v >= 99.5 THEN 'exact' WHEN v >= 90 THEN 'high' WHEN v >= 75 THEN 'medium' ELSE 'low' END
        WHEN 2 THEN CASE WHEN v IS NULL THEN 'self_unstated' WHEN v >= 0.85 THEN 'self_high' WHEN v >= 0.6 THEN 'self_medium' ELSE 'self_low' END WHEN 3 THEN 'exact' WHEN 4 THEN 'rule' ELSE 'none' END band,
        CASE WHEN u = 0 THEN CASE c WHEN 0 THEN 'enriched' WHEN 1 THEN 'failed' ELSE 'unresolved' END WHEN c = 0 THEN 'enriched' ELSE 'verified' END status FROM o""",
    "grammar_census": "SELECT 'mixed' kind",
    "store_keys": "SELECT p_partkey, lower(p_name) || '|DE' registry, lower(p_name) || '|q|US' search, 'http://x?a=1&q=' || p_brand http, sha256(p_name || chr(9247) || p_brand) request FROM part",
}
