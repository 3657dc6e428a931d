"""Stages that apply a reviewer's or model's recorded verdicts to records.

A verdict is a row of an evidence table; without one nothing changes. Guards
that need no outside answer are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import extract as ex
from loomery.functions import text as tx
from loomery.functions.similarity import token_sort_ratio
from loomery.operators.issues import CONTINUES, LEGAL, NAMES

RESIDUAL_THRESHOLD, CHILD_THRESHOLD, SAME, CLOSE = 0.85, 70.0, 95.0, 80.0


def overflow_pairs(records: DataFrame) -> DataFrame:
    """(record_id, upper, lower, pair) of adjacent name slots that may be one name cut in two."""
    pairs = [F.struct(F.lit(a).alias("upper_slot"), F.col(a).alias("upper"), F.col(b).alias("lower")) for a, b in zip(NAMES, NAMES[1:], strict=False)]
    p = records.select("record_id", F.explode(F.array(*pairs)).alias("p")).select("record_id", "p.*")
    return p.filter(~tx.blank(F.col("upper")) & ~tx.blank(F.col("lower")) & ~ex.has(F.col("upper"), LEGAL) & ex.has(F.col("lower"), CONTINUES))


def merge_overflow(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Joins slots that verdicts (record_id, upper_slot, is_overflow) call one name, runs of several too, and packs the rest."""
    v = verdicts.filter("is_overflow").groupBy("record_id").agg(F.collect_set("upper_slot").alias("_joined"))
    df = records.join(v, "record_id", "left")
    items = F.array(*[F.struct(F.col(c).alias("v"), F.coalesce(F.array_contains("_joined", F.lit(NAMES[k - 1])), F.lit(False)).alias("on") if k else F.lit(False).alias("on")) for k, c in enumerate(NAMES)])

    def put(acc: Column, x: Column) -> Column:
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.get(acc, F.size(acc) - 1), F.trim(x["v"]))))
        return F.when(F.coalesce(F.trim(x["v"]), F.lit("")) == "", acc).when(x["on"] & (F.size(acc) > 0), joined).otherwise(F.concat(acc, F.array(F.trim(x["v"]))))

    df = df.withColumn("_n", F.aggregate(items, F.array().cast("array<string>"), put))
    return df.withColumns({c: F.when(F.col("_joined").isNull(), F.col(c)).otherwise(F.get(F.col("_n"), F.lit(k))) for k, c in enumerate(NAMES)}).drop("_joined", "_n")


def apply_residuals(records: DataFrame, verdicts: DataFrame, targets: dict[str, str], slot: str) -> DataFrame:
    """A street slot's content to where its verdict (value, kind, confidence) says, if that is free and sure enough."""
    v = verdicts.filter(F.col("confidence") >= RESIDUAL_THRESHOLD).groupBy(F.col("value").alias("_v")).agg(F.max_by("kind", "confidence").alias("_kind"))
    df = records.join(v, F.trim(slot) == F.col("_v"), "left")
    moved = {c: F.when((F.col("_kind") == k) & tx.blank(F.col(c)), F.col(slot)).otherwise(F.col(c)) for k, c in targets.items()}
    taken = F.lit(False)
    for k, c in targets.items():
        taken = taken | ((F.col("_kind") == k) & tx.blank(F.col(c)))
    return df.withColumns(moved | {slot: F.when(~F.coalesce(taken, F.lit(False)), F.col(slot))}).drop("_v", "_kind")


def contact_queries(contact: Column, institution: Column, domain: Column) -> Column:
    """Search queries for a contact's department, most exact first, without repeats."""
    quoted = F.concat(F.lit('"'), ex.clean_contact(contact), F.lit('"'))
    return F.array_distinct(F.array_compact(F.array(F.concat_ws(" ", quoted, institution), F.when(domain.isNotNull(), F.concat(F.lit("site:"), domain, F.lit(" "), quoted)))))


def rank_people_pages(results: DataFrame, query: str, most: int = 3) -> DataFrame:
    """Pages that name the contact: people words, 100 if the URL has both names, 20 if the title begins with the name."""
    name = F.lower(ex.clean_contact(F.col("contact")))
    first, last = F.get(F.split(name, " "), F.lit(0)), F.element_at(F.split(name, " "), -1)
    hay = F.lower(F.concat_ws(" ", "title", "snippet", "url"))
    found = results.filter(F.contains(hay, first) & F.contains(hay, last))
    url = F.lower("url")
    score = tx.people_signals(F.col("url"), F.col("snippet")) + F.when(F.contains(url, first) & F.contains(url, last), 100).otherwise(0) + F.when(F.lower(F.coalesce("title", F.lit(""))).startswith(name), 20).otherwise(0)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "url"))
    return found.withColumn("score", score).withColumn("place", place).filter(F.col("place") <= most)


def department_verdict(existing: Column, found: Column, confidence: Column) -> Column:
    """struct(value, action): same (verified), close (normalised), else overwritten only at high confidence."""
    score = token_sort_ratio(F.lower(tx.canonicalise_unit(existing)), F.lower(tx.canonicalise_unit(found)))
    out = lambda v, a: F.struct(v.alias("value"), F.lit(a).alias("action"))
    return (
        F.when(found.isNull(), out(existing, "kept")).when(tx.blank(existing), out(tx.canonicalise_unit(found), "filled"))
        .when(score >= SAME, out(existing, "verified")).when(score >= CLOSE, out(tx.canonicalise_unit(found), "normalised"))
        .when(confidence == "high", out(tx.canonicalise_unit(found), "overwritten")).otherwise(out(existing, "kept"))
    )


def match_child(records: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """The registry's child unit (key, child) most like each record's name_2, at CHILD_THRESHOLD or more."""
    s = records.join(children, key).withColumn("score", token_sort_ratio(F.lower("name_2"), F.lower("child"))).filter(F.col("score") >= CHILD_THRESHOLD)
    return s.groupBy("record_id").agg(F.max_by("child", F.struct("score", F.col("child"))).alias("child"), F.max("score").alias("score"))


def keeps_subject(original: Column, proposal: Column) -> Column:
    """A proposal has every subject word of the original, by itself or by its first four letters."""
    units = [w.lower() for w, _ in tx.UNIT_FORMS] + ["dept", "div", "lab"]
    words = lambda c: F.filter(F.split(tx.fold_key(tx.expand_abbreviations(c)), " "), lambda w: (F.length(w) > 1) & ~w.isin([*units, *tx.STOPWORDS]) & ~w.rlike(r"^\d+$"))
    new = words(proposal)
    return F.forall(words(original), lambda a: F.exists(new, lambda b: tx.token_covers(a, b)))


def prefix_downgrade(original: Column, proposal: Column) -> Column:
    """The proposal only lost the unit's word: 'Department of X' became 'X'."""
    bare = F.regexp_replace(F.lower(tx.expand_abbreviations(original)), r"^(?:department|division|school|faculty|college|institute|center|centre|laboratory)\s+(?:of|for)\s+", "")
    return (bare != F.lower(original)) & (bare == F.lower(F.trim(proposal)))


def apply_canonical(records: DataFrame, proposals: DataFrame, slot: str) -> DataFrame:
    """Proposed names (value, proposal) for a slot, taken only if they keep the subject and lose nothing."""
    p = proposals.groupBy(F.col("value").alias("_v")).agg(F.min("proposal").alias("_p"))
    df = records.join(p, F.trim(slot) == F.col("_v"), "left")
    ok = F.col("_p").isNotNull() & keeps_subject(F.col(slot), F.col("_p")) & ~prefix_downgrade(F.col(slot), F.col("_p"))
    return df.withColumn(slot, F.when(F.coalesce(ok, F.lit(False)), F.col("_p")).otherwise(F.col(slot))).drop("_v", "_p")


def is_address_like(value: Column, street: Column) -> Column:
    return ex.looks_like_street(value) | (ex.street_key(value) == ex.street_key(street))
