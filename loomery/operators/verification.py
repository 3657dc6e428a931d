"""Checks of what evidence says about a record: names, addresses, pages, liveness, knowledge base, sources.

Column functions and joins; similarity is an Arrow UDF on the rows that need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.functions import urls
from loomery.functions.similarity import ratio, token_sort_ratio
from loomery.operators import matching

REGISTRY_FIELDS = {"ror": ["ror_id", "domain", "website_url"], "lei": ["lei_id", "legal_form"]}
ORG_TYPES = ["Q43229", "Q4830453", "Q3918", "Q31855", "Q16917", "Q6881511", "Q783794", "Q891723", "Q38723", "Q327333"]


def names_agree(a: Column, b: Column, threshold: float = matching.LEI_THRESHOLD) -> Column:
    """Token-sort ratio of the threshold or more, or one name contains the other."""
    return F.coalesce((token_sort_ratio(F.lower(a), F.lower(b)) >= threshold) | matching.agree_by_containment(a, b), F.lit(False))


def match_verbatim(a: Column, b: Column) -> Column:
    """Equal significant words, and legal forms that are equal or missing on one side."""
    core = lambda c: F.transform(matching.name_core(c), F.lower)
    forms = lambda c: F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9&]+)"), F.lit(1)), lambda t: t.isin(matching.LEGAL_TOKENS))))
    return (F.size(core(a)) > 0) & (core(a) == core(b)) & ((F.size(forms(a)) == 0) | (F.size(forms(b)) == 0) | (forms(a) == forms(b)))


def registry_addresses(addresses: Column, record: dict[str, Column], regions: dict[str, str] | None = None) -> Column:
    """struct(verdict, scope) over an array of addresses: one that agrees settles it,
    another city in the same region is neutral, else the finest contradiction."""
    def one(a: Column) -> Column:
        v = matching.compare_locality({k: a[k] for k in ("city", "region", "country", "postal_code")}, record, regions)
        note = (v["verdict"] == "contradicted") & (v["scope"] == "city") & (matching.normalise_region(a["region"], regions or {}) != "") & (matching.normalise_region(a["region"], regions or {}) == matching.normalise_region(record["region"], regions or {}))
        kind = F.when(v["verdict"] == "consistent", 0).when(note | (v["verdict"] == "neutral"), 1).otherwise(2)
        depth = F.when(v["scope"] == "city", 0).when(v["scope"] == "region", 1).otherwise(2)
        return F.struct(kind.alias("kind"), depth.alias("depth"), v["scope"].alias("scope"))

    best = F.array_min(F.transform(addresses, one))
    verdict = F.when(best["kind"] == 0, "consistent").when(best["kind"] == 2, "contradicted").otherwise("neutral")
    return F.struct(verdict.alias("verdict"), F.when(verdict != "neutral", best["scope"]).alias("scope"))


def gate_sources(df: DataFrame, threshold: float = matching.LEI_THRESHOLD) -> DataFrame:
    """Two registries that name different organisations: the one that fits the
    record's own name worse loses its fields. Adds dropped_source."""
    conflict = F.col("ror_name").isNotNull() & F.col("lei_name").isNotNull() & ~names_agree(F.col("ror_name"), F.col("lei_name"), threshold)
    df = df.withColumns({"_conflict": conflict, "_a": token_sort_ratio(F.lower("ror_name"), F.lower("name_1")), "_b": token_sort_ratio(F.lower("lei_name"), F.lower("name_1"))})
    loser = F.when(F.col("_conflict"), F.when(F.col("_a") >= F.col("_b"), "lei").otherwise("ror"))
    df = df.withColumn("dropped_source", loser)
    cut = {c: F.when(~F.coalesce(F.col("dropped_source") == s, F.lit(False)), F.col(c)) for s, cs in REGISTRY_FIELDS.items() for c in [f"{s}_name", *cs] if c in df.columns}
    return df.withColumns(cut).drop("_conflict", "_a", "_b")


def page_outcome(title: Column, heading: Column, body: Column, name: Column, location: Column) -> Column:
    """What a page says about the record: parked, name_mismatch, contradicted or corroborated."""
    hay = tx.fold_key(F.concat_ws(" ", title, heading, body))
    words = matching.distinctive_tokens(name)
    named = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(hay, w))
    parked = F.coalesce(F.concat_ws(" ", title, body).rlike(r"(?i)domain (?:is )?for sale|buy this domain|parked (?:free|domain)|this domain may be for sale"), F.lit(False))
    return F.when(parked, "parked").when(~named, "name_mismatch").when(location["verdict"] == "contradicted", "contradicted").otherwise("corroborated")


def redirect_verdict(name: Column, start: Column, final: Column, threshold: float = matching.REDIRECT_THRESHOLD) -> Column:
    """moved, if the site leads to another domain whose label isn't like the name."""
    away = urls.domain(start) != urls.domain(final)
    alike = token_sort_ratio(F.lower(name), F.lower(urls.domain_label(urls.domain(final)))) >= threshold
    return F.when(F.coalesce(away & ~alike, F.lit(False)), "moved")


def liveness_findings(gleif: Column, ror: Column, redirect: Column) -> Column:
    """Findings of the three sources in their order."""
    return F.array_compact(F.array(F.when(gleif.isNotNull(), F.concat(F.lit("gleif:"), gleif)), F.when(ror.isNotNull(), F.concat(F.lit("ror:"), ror)), F.when(redirect.isNotNull(), F.concat(F.lit("web:"), redirect))))


def pick_entity(items: DataFrame, key: str, threshold: float = matching.LEI_THRESHOLD) -> DataFrame:
    """The knowledge-base item per record: an organisation, in the country, in the city where stated, name alike.

    items: key, qid, types, countries, cities, names, name, country, city.
    """
    ok = items.filter(F.arrays_overlap("types", F.array(*map(F.lit, ORG_TYPES)))).filter(F.array_contains("countries", F.col("country")))
    ok = ok.filter((F.size("cities") == 0) | F.exists("cities", lambda c: F.lower(c) == F.lower("city")))
    scored = ok.withColumn("label", F.explode("names")).withColumn("score", token_sort_ratio(F.lower("label"), F.lower("name")))
    best = scored.groupBy(key, "qid").agg(F.max("score").alias("score")).filter(F.col("score") >= threshold)
    w = Window.partitionBy(key)
    ranked = best.withColumns({"place": F.row_number().over(w.orderBy(F.desc("score"), "qid")), "next": F.lead("score").over(w.orderBy(F.desc("score"), "qid"))})
    return ranked.filter("place = 1").filter(F.col("next").isNull() | (F.col("score") - F.col("next") >= matching.MARGIN)).select(key, "qid", "score")


def host_introduces_brand(name: Column, url: Column) -> Column:
    """A word of the host's label that the name doesn't have."""
    parts = F.filter(F.split(urls.domain_label(urls.domain(url)), r"[-_]"), lambda p: F.length(p) >= 4)
    flat = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]", "")
    return F.coalesce(F.exists(parts, lambda p: ~F.contains(flat, p)), F.lit(False))


def phrase_in_title(name: Column, title: Column) -> Column:
    return (tx.fold_key(name) != "") & F.contains(F.concat(F.lit(" "), tx.fold_key(title), F.lit(" ")), F.concat(F.lit(" "), tx.fold_key(name), F.lit(" ")))


def grammar_census(df: DataFrame, column: str) -> DataFrame:
    """(kind) of a run's provenance: old (source alone), new (source:confidence), mixed or empty."""
    filled = F.coalesce(F.col(column), F.lit("")) != ""
    new = F.col(column).rlike(":(?:verified|provisional|low)(?:\\+|$)")
    a = df.agg(F.coalesce(F.bool_or(filled & new), F.lit(False)).alias("n"), F.coalesce(F.bool_or(filled & ~new), F.lit(False)).alias("o"))
    return a.select(F.when(F.col("n") & F.col("o"), "mixed").when(F.col("n"), "new").when(F.col("o"), "old").otherwise("empty").alias("kind"))


def is_spelling_variant(original: Column, canonical: Column, threshold: float = 85.0) -> Column:
    """Names that differ in spelling alone, legal forms apart."""
    return ratio(tx.strip_legal_suffix(original), tx.strip_legal_suffix(canonical)) >= threshold
