"""Field provenance as event arrays, confidence, and review flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAMMAR = r"^[a-z][a-z0-9_.\-]*(?::[^:+]+)?:(?:verified|provisional|low)(?:\+[a-z_]+)?$"
FLAGS = ["overflow", "opaque-code", "person-unresolved", "entity-superseded", "source-conflict", "no-match", "unverified-inference", "registry-location-mismatch", "dept-via-lab", "name3-not-demoted", "multiple-contacts", "email-conflict", "domain-unverified"]


def last_write(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The event that a field's present value is owed to: the last one, aggregated map-side."""
    rest = [c for c in events.columns if c not in keys and c != order]
    return events.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("e")).select(*keys, "e.*")


def first_write(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in events.columns if c not in keys and c != order]
    return events.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("e")).select(*keys, "e.*")


def keep_rejections(rejected: DataFrame, keys: list[str], order: str, most: int = 3) -> DataFrame:
    """The first rejections of a field, three at most, and how many were left out."""
    w = Window.partitionBy(*keys)
    r = rejected.withColumns({"place": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    return r.filter(F.col("place") <= most).withColumn("omitted", F.greatest(F.col("_n") - most, F.lit(0))).drop("_n")


def append_event(events: Column, field: Column, old: Column, new: Column, source: Column) -> Column:
    """An event array with one more, numbered on."""
    e = F.struct((F.size(events) + 1).alias("seq"), field.alias("field"), old.alias("old_value"), new.alias("new_value"), source.alias("source"))
    return F.concat(events, F.array(e))


def confidence(contradicted: Column, ambiguous: Column, registry: Column, crosswalked: Column, witness: Column, has_source: Column, equals_input: Column) -> Column:
    """struct(confidence, witness): contradiction first, then registry, witness, single source. A model is no witness."""
    out = lambda c, w: F.struct(F.lit(c).alias("confidence"), w.cast("string").alias("witness"))
    none = F.lit(None)
    return (
        F.when(contradicted | ambiguous, out("low", none))
        .when(registry, out("verified", F.when(crosswalked, "wikidata")))
        .when(witness.isNotNull() & (witness != "llm"), out("verified", witness))
        .when(has_source, out("provisional", F.when(equals_input, "llm")))
        .otherwise(out("low", none))
    )


# Lowest value of each band, by scale.
BANDS = {"ror_local": [(0.999, "exact"), (0.9, "high"), (0.75, "medium")], "fuzzy_ratio": [(99.5, "exact"), (90, "high"), (75, "medium")], "llm_self_reported": [(0.85, "self_high"), (0.6, "self_medium")]}
LOWEST = {"ror_local": ("low", "unscored"), "fuzzy_ratio": ("low", "unscored"), "llm_self_reported": ("self_low", "self_unstated")}
SCALE_BANDS = {"registry_exact": "exact", "deterministic": "rule", "inherited": "inherited", "input_corroborated": "verified", "input_self_consistent": "confirmed"}


def confidence_band(scale: Column, value: Column) -> Column:
    """The band of a value on its own scale; some scales have one band, an unknown one has none."""
    out = F.lit("none")
    for name, steps in BANDS.items():
        low, missing = LOWEST[name]
        on_scale = F.when(value.isNull(), missing)
        for least, band in steps:
            on_scale = on_scale.when(value >= least, band)
        out = F.when(scale == name, on_scale.otherwise(low)).otherwise(out)
    for name, band in SCALE_BANDS.items():
        out = F.when(scale == name, band).otherwise(out)
    return out


def status_after(state: Column, current: Column) -> Column:
    """The enrichment status that a settled unchanged state implies; ``enriched`` is never taken back."""
    return F.when(state == "unresolved", F.coalesce(F.when(current != "", current), F.lit("unresolved"))).when(current == "enriched", current).otherwise("verified")


def scalar(source: Column, c: Column) -> Column:
    """``source:confidence[+witness]``"""
    return F.concat(source, F.lit(":"), c["confidence"], F.coalesce(F.concat(F.lit("+"), c["witness"]), F.lit("")))


def is_valid(provenance: Column) -> Column:
    """Grammar, and: a model neither verifies nor witnesses what is verified."""
    return F.coalesce(provenance.rlike(GRAMMAR) & ~provenance.rlike(r"^llm(?::.*)?:verified|:verified\+llm$"), F.lit(False))


def flags(conditions: dict[str, Column]) -> Column:
    """Array of the raised codes in catalogue order; no-match only if nothing else is raised."""
    others = [F.coalesce(conditions[c], F.lit(False)) for c in FLAGS if c in conditions and c != "no-match"]
    quiet = ~F.greatest(*others) if len(others) > 1 else ~others[0] if others else F.lit(True)
    on = {c: conditions[c] & quiet if c == "no-match" else conditions[c] for c in FLAGS if c in conditions}
    return F.array_compact(F.array(*[F.when(v, F.lit(c)) for c, v in on.items()]))


def retract(scopes: Column, code: str, field: str) -> Column:
    """A map of code to fields without one field of a code; a code without fields goes."""
    cut = F.transform_values(scopes, lambda k, v: F.when(k == code, F.array_remove(v, field)).otherwise(v))
    return F.map_filter(cut, lambda k, v: F.size(v) > 0)


def unchanged_state(name_original: Column, name_enriched: Column, verified: Column, looked_up: Column) -> Column:
    same = F.lower(F.trim(name_original)) == F.lower(F.trim(name_enriched))
    return F.when(~F.coalesce(same, F.lit(False)), F.lit(None)).when(verified, "unchanged-verified").when(looked_up, "unchanged-confirmed").otherwise("unresolved")


def admit(record: DataFrame, fields: list[str], written: Column) -> DataFrame:
    """Fields with a value but no event in ``written`` (array of names) go back to ``<field>_original``."""
    return record.withColumns({f: F.when(F.col(f).isNotNull() & ~F.array_contains(written, f), F.col(f"{f}_original")).otherwise(F.col(f)) for f in fields})
