"""Provenance scalars from a record's event log, as column expressions over event arrays.

A log is JSON: ``{"events": [...], "rejections": [...]}``, its events numbered by
``seq``. A field's value is owed to the last event that wrote it or took it
back; transforms (casing, packing) decide nothing. That event is read as a
situation (who, by which way, with which witness), the situation has one
confidence, and source and confidence make the scalar. Nothing is stored
besides the log, so scalar and log can't disagree.

Defined cases: a null or broken log has no events; events out of order are
ordered by ``seq``, of equal ones the later in the array counts; a field without a
writing event has no scalar; unknown producers are input without a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions.text import let
from loomery.operators.provenance import confidence, scalar

# Scoped fields and their columns, producers, rules and witnesses.
SCOPED_FIELDS = {"name1_enriched": "name1", "name2_enriched": "name2", "domain": "domain", "record_type": "record_type", "ror_id": "ror_id", "lei_id": "lei_id"}
REGISTRIES = ["ror", "gleif"]
WEB_PRODUCERS = ["website_resolver", "page_read", "domain_resolver"]
EMAIL_PRODUCER, CLASSIFIER = "record_email", "classifier"
EVIDENCE_FREE = ["llm_tier3", "llm_grounded"]
CROSSWALK_RULE, UNVERIFIED_RULE = "wikidata:crosswalk", "domain-ownership:unverified"
DOMAIN_WITNESSES = {"email": "domain", "registry": "registry", "witness_registry": "registry", "witness_wikidata": "wikidata"}
CORROBORATION_WITNESSES = {"page": "web", "domain": "web", "wikidata": "wikidata", "registry": "registry", "email": "domain"}

EVENT = "struct<seq:int,field:string,kind:string,old_value:string,new_value:string,producer_chain:array<string>,confidence_scale:string,rule_id:string,evidence_ref:map<string,string>>"
LOG = f"struct<events:array<{EVENT}>,rejections:array<struct<seq:int,field:string,candidate:string,guard:string>>>"


def read_log(json: Column) -> Column:
    return F.from_json(json, LOG)


def attributing_event(log: Column, field: Column) -> Column:
    """The event that the field's value is owed to."""
    written = F.filter(log["events"], lambda e: (e["field"] == field) & F.coalesce(e["kind"], F.lit("write")).isin("write", "revert"))
    later = lambda best, e: F.when(best["seq"].isNull() | (F.coalesce(e["seq"], F.lit(0)) >= best["seq"]), e).otherwise(best)
    last = F.aggregate(written, F.lit(None).cast(EVENT), later)
    return F.when(F.size(written) > 0, last)


def producer(event: Column) -> Column:
    return F.coalesce(F.try_element_at(event["producer_chain"], F.lit(-1)), F.lit("input"))


def _host(url: Column) -> Column:
    bare = F.regexp_extract(F.regexp_replace(F.trim(url), r"^.*?://", ""), r"^[^/?#]*", 0)
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^.*@", ""), r":.*$", ""), r"^\.+", "")), F.lit(""))


def web_source(event: Column) -> Column:
    """``web:`` and the domain: the value itself for the field domain, else the host that was read."""
    ref = lambda k: _host(event["evidence_ref"][F.lit(k)])
    own = F.when(event["field"] == "domain", F.nullif(F.lower(F.trim(event["new_value"])), F.lit("")))
    return F.concat(F.lit("web:"), F.coalesce(own, ref("email_domain"), ref("source_url"), ref("withdrawn"), F.lower(F.trim(F.coalesce(event["new_value"], F.lit(""))))))


def _of(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def situation(event: Column, wikidata_agrees: Column) -> Column:
    """struct(source, registry, crosswalked, has_source, witness, contradicted, equals_input) of an event;
    ``wikidata_agrees``: the knowledge base has the record's domain too."""
    by, scale, rule = producer(event), event["confidence_scale"], F.coalesce(event["rule_id"], F.lit(""))
    ref = lambda k: event["evidence_ref"][F.lit(k)]
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("string")

    def made(source, registry=no, crosswalked=no, has_source=yes, witness=none, contradicted=no, equals_input=no) -> Column:
        return F.struct(source.alias("source"), registry.alias("registry"), crosswalked.alias("crosswalked"), has_source.alias("has_source"), witness.cast("string").alias("witness"), contradicted.alias("contradicted"), equals_input.alias("equals_input"))

    decided = F.coalesce(ref("decided_by"), F.lit("unresolved"))
    owned = F.coalesce(_of(DOMAIN_WITNESSES, ref("verified_by")), F.when((event["field"] == "domain") & wikidata_agrees, "wikidata"))
    corroborated = F.coalesce(_of(CORROBORATION_WITNESSES, F.regexp_extract(F.coalesce(ref("corroborated_by"), F.lit("")), r"^[^:]*", 0)), F.lit("web"))
    inherited = F.when(event["field"] == "ror_id", "ror").when(event["field"] == "lei_id", "gleif").otherwise("input")
    return (
        F.when(by.isin(REGISTRIES), made(by, registry=yes, crosswalked=rule.startswith(CROSSWALK_RULE)))
        .when((by == CLASSIFIER) & decided.isin(REGISTRIES), made(decided, registry=yes))
        .when(by == CLASSIFIER, made(F.lit("input"), has_source=decided != "unresolved"))
        .when(by.startswith("llm") | F.coalesce(scale == "llm_self_reported", no), made(F.lit("llm")))
        .when(by == EMAIL_PRODUCER, made(web_source(event), witness=F.lit("domain")))
        .when(by.isin(WEB_PRODUCERS) & (rule == UNVERIFIED_RULE), made(web_source(event), contradicted=yes))
        .when(by.isin(WEB_PRODUCERS), made(web_source(event), witness=owned))
        .when(scale == "inherited", made(inherited))
        .when(scale == "input_corroborated", made(F.lit("input"), witness=corroborated))
        .when(scale == "input_self_consistent", made(F.lit("input"), equals_input=yes))
        .otherwise(made(F.lit("input"), has_source=no))
    )


def derived_scalar(event: Column, wikidata_agrees: Column) -> Column:
    band = lambda s: confidence(s["contradicted"], F.lit(False), s["registry"], s["crosswalked"], s["witness"], s["has_source"], s["equals_input"])
    made = let(situation(event, wikidata_agrees), lambda s: let(band(s), lambda c: scalar(s["source"], c)))
    return F.when(event.isNotNull(), made)


def with_provenance(records: DataFrame, log: str, wikidata_agrees: Column | None = None) -> DataFrame:
    """``records`` with ``<field>_provenance`` for each scoped field, ``weak_fields`` (last written by a model from its
    training alone), ``registry_fields`` and ``rejections`` (the first three a field, and how many were left out)."""
    agrees = F.coalesce(wikidata_agrees, F.lit(False)) if wikidata_agrees is not None else F.lit(False)
    names = list(SCOPED_FIELDS.values())
    out = records.withColumn("_log", read_log(F.col(log)))
    out = out.withColumn("_e", F.transform(F.array(*map(F.lit, SCOPED_FIELDS)), lambda f: attributing_event(F.col("_log"), f)))
    out = out.withColumn("_s", F.transform("_e", lambda e: derived_scalar(e, agrees)))
    labels = F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), F.transform("_e", lambda e: F.when(e.isNotNull(), producer(e))).alias("by"))
    named = lambda producers: F.transform(F.filter(labels, lambda x: x["by"].isin(producers)), lambda x: x["name"])
    rejected = F.coalesce(F.col("_log.rejections"), F.from_json(F.lit("[]"), "array<struct<seq:int,field:string,candidate:string,guard:string>>"))
    ordered = F.array_sort(rejected)
    by_field = F.transform(F.array_sort(F.array_distinct(F.transform(ordered, lambda r: r["field"]))), lambda f: F.struct(f.alias("field"), F.filter(ordered, lambda r: r["field"] == f).alias("all")))
    kept = F.transform(by_field, lambda x: F.struct(x["field"].alias("field"), F.transform(F.slice(x["all"], 1, 3), lambda r: r["candidate"]).alias("candidates"), F.greatest(F.size(x["all"]) - 3, F.lit(0)).alias("omitted")))
    made = {f"{n}_provenance": F.get("_s", F.lit(k)) for k, n in enumerate(names)}
    return out.withColumns(made | {"weak_fields": named(EVIDENCE_FREE), "registry_fields": named(REGISTRIES), "rejections": kept}).drop("_log", "_e", "_s")
