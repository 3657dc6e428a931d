"""Typed segments of a mixed street: each goes to the field of its kind, in one fold.

A first street of several segments (commas or pipes) that has a pipe, a care-of
or a building is cut up, each segment gets a kind, and one ``aggregate`` over the
typed segments fills the fields in order: the first mail code, building and
department take their fields, care-of parts are joined, the rest make street
lines, addresses first, then campuses, then what found no field. Lines move into
the five street slots before the other streets; lines without a slot are joined
to the last one and flagged. Nothing is dropped but a city, region or postal
code that the record has in its own field; a postal code fills that field where
it is blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import extract as ex
from loomery.functions import text as tx
from loomery.operators.issues import NAMES, STREETS

# Patterns whose matches must be the same everywhere.
STREET_WORDS = r"St|Street|Ave|Avenue|Blvd|Boulevard|Rd|Road|Dr|Drive|Ln|Lane|Hwy|Highway|Pkwy|Parkway|Ct|Court|Way|Pl|Place|Ter|Terrace"
BUILDING_END = r"(?i)^\S.*\s(?:Building|Bldg|House|Hall|Pavilion|Tower)\.?\s*$"
NUMBERED_BUILDING = r"(?i)^\d+\s+(.+\b(?:Building|Bldg))\.?$"
CAMPUS_CODE = r"^\d{3,4}\s+[A-Z]{2,5}$"
UK_POSTCODE = r"\b[A-Z]{1,2}\d[A-Z\d]?\s+\d[A-Z]{2}\b"
US_POSTCODE = r"\b\d{5}(?:-\d{4})?\b"
CARE_OF_START = "(?i)^" + ex.CARE_OF[4:]

STATE = "struct<mail:string,building:string,postal:string,care:string,unit:string,addresses:array<string>,campuses:array<string>,others:array<string>>"


def named_building(c: Column) -> Column:
    return ex.has(c, BUILDING_END) & ~c.rlike(r"^\d+\s") & ~ex.looks_like_street(c) & ~ex.looks_like_department(c)


def title_capitals(c: Column) -> Column:
    """A text in capitals with a capital per word; others as they are."""
    titled = F.initcap(F.lower(c))
    for word in ("Of", "The", "And", "For", "In", "At"):
        titled = F.regexp_replace(titled, rf"(?<=\s){word}(?=\s)", word.lower())
    return F.when(c == F.upper(c), titled).otherwise(c)


def location_only(c: Column, city: Column, state: Column, postal_code: Column) -> tuple[Column, Column]:
    """Whether a segment is a city, region or postal code that the record has in its own
    field, or may fill it; and the postal code in it, '' if there is none."""
    own = [F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (city, state, postal_code)]
    low, postcode = F.lower(c), f"(?i)(?:{UK_POSTCODE}|{US_POSTCODE})"
    plain = F.regexp_replace(low, postcode, " ")
    for x in own[:2]:
        plain = F.when(x != "", F.replace(plain, x, F.lit(" "))).otherwise(plain)
    code = F.regexp_extract(c, postcode, 0)
    fits = (code != "") & ((own[2] == "") | (own[2] == F.lower(code)))
    is_own = F.greatest(*((x != "") & (low == x) for x in own))
    return ~ex.looks_like_street(c) & (is_own | (fits & (F.regexp_replace(plain, r"[,\s]+", "") == ""))), code


def segment_kind(c: Column, city: Column, state: Column, postal_code: Column) -> Column:
    """struct(kind, value) of a segment."""
    payload = F.trim(F.regexp_replace(F.regexp_extract(c, CARE_OF_START, 1), r"^[ ,;\-.]+|[ ,;\-.]+$", ""))
    word = ex.has(c, rf"(?i)\b(?:{STREET_WORDS})\b\.?")
    numbered = F.regexp_extract(c, NUMBERED_BUILDING, 1)
    located, code = location_only(c, city, state, postal_code)
    kinds = [
        (c.rlike(CAMPUS_CODE), "mail", c), ((numbered != "") & ~word, "building", title_capitals(numbered)), (ex.has(c, CARE_OF_START) & ex.looks_like_department(payload), "unit", payload), (ex.has(c, CARE_OF_START) & (payload != ""), "care", payload),
        (named_building(c), "building", title_capitals(c)), (located, "location", code), (ex.has(c, ex.CAMPUS) & ~ex.looks_like_street(c), "campus", c), (ex.looks_like_department(c), "unit", F.regexp_replace(c, r"^[ .]+|[ .]+$", "")), (ex.looks_like_street(c) | word, "address", c),
    ]
    made = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    out = F.when(F.lit(False), made("", c))
    for when, kind, value in kinds:
        out = out.when(when, made(kind, value))
    return out.otherwise(made("other", c))


def _put(state: Column, piece: Column) -> Column:
    """The state after a segment: a field takes the first of its kind, later ones become lines."""
    kind, value = piece["kind"], piece["value"]
    first = lambda field, name: F.when((kind == name) & state[field].isNull(), value).otherwise(state[field]).alias(field)
    left = (kind == "other") | F.greatest(*((kind == name) & state[field].isNotNull() for field, name in (("mail", "mail"), ("building", "building"), ("unit", "unit"))))
    more = lambda field, when: F.when(when, F.array_append(state[field], value)).otherwise(state[field]).alias(field)
    return F.struct(first("mail", "mail"), first("building", "building"), F.when((kind == "location") & (value != ""), value).otherwise(state["postal"]).alias("postal"), F.when(kind == "care", join_parts(state["care"], value)).otherwise(state["care"]).alias("care"), first("unit", "unit"), more("addresses", kind == "address"), more("campuses", kind == "campus"), more("others", left))


def join_parts(have: Column, new: Column) -> Column:
    """Care-of parts joined by ' | ', without repeating one."""
    same = F.array_contains(F.transform(F.split(have, r" \| "), lambda x: F.lower(F.trim(x))), F.lower(F.trim(new)))
    return F.when(tx.blank(have), new).when(same, have).otherwise(F.concat(have, F.lit(" | "), new))


def routed(street: Column, have: dict[str, Column]) -> Column:
    """The fold's last state for a street; null where it isn't a mixed one."""
    parts = F.filter(F.transform(F.split(F.coalesce(street, F.lit("")), "[|,]"), lambda x: F.regexp_replace(x, r"^[ ;\-]+|[ ;\-]+$", "")), lambda x: x != "")
    mixed = lambda p: (F.size(p) > 1) & (F.contains(street, F.lit("|")) | F.exists(p, lambda x: named_building(x) | ex.has(x, CARE_OF_START)))
    none = F.array().cast("array<string>")
    start = F.struct(tx.nullify(have["mail_code"]).alias("mail"), tx.nullify(have["building"]).alias("building"), tx.nullify(have["postal_code"]).alias("postal"), tx.nullify(have["care_of"]).alias("care"), F.lit(None).cast("string").alias("unit"), none.alias("addresses"), none.alias("campuses"), none.alias("others")).cast(STATE)
    fold = lambda p: F.aggregate(F.transform(p, lambda x: segment_kind(x, have["city"], have["state"], have["postal_code"])), start, lambda s, x: _put(s, x).cast(STATE))
    return tx.let(parts, lambda p: F.when(mixed(p), fold(p)))


def route_segments(df: DataFrame) -> DataFrame:
    """Mixed first streets of ``df`` (street_1..5, name_1..5, care_of, building, mail_code, city, state, postal_code,
    preprocess_flags) in their fields. A department goes to the first empty name; without one it stays a street line.
    Flags: 'second-street' for two addresses, 'street-slots-full' where lines were joined to the last slot."""
    out = df.withColumn("_r", routed(F.col("street_1"), {c: F.col(c) for c in ("mail_code", "building", "care_of", "city", "state", "postal_code")}))
    free = F.array_position(F.array(*[tx.blank(F.col(c)) for c in NAMES]), True)
    out = out.withColumns({"_on": F.col("_r").isNotNull(), "_free": F.when(F.col("_r.unit").isNotNull(), free).otherwise(0)})
    homeless = F.when(F.col("_r.unit").isNotNull() & (F.col("_free") == 0), F.array("_r.unit")).otherwise(F.array().cast("array<string>"))
    tail = F.filter(F.array(*[tx.nullify(F.col(c)) for c in STREETS[1:]]), lambda x: x.isNotNull())
    out = out.withColumn("_lines", F.concat("_r.addresses", "_r.campuses", "_r.others", homeless, tail))
    last = F.array_join(F.slice("_lines", len(STREETS), F.greatest(F.size("_lines"), F.lit(1))), ", ")
    lines = {c: F.when(F.col("_on"), F.get("_lines", F.lit(k)) if c != STREETS[-1] else F.nullif(last, F.lit(""))).otherwise(F.col(c)) for k, c in enumerate(STREETS)}
    names = {c: F.when(F.col("_free") == k + 1, F.col("_r.unit")).otherwise(F.col(c)) for k, c in enumerate(NAMES)}
    kept = {c: F.when(F.col("_on"), F.col(f"_r.{f}")).otherwise(F.col(c)) for c, f in (("mail_code", "mail"), ("building", "building"), ("care_of", "care"), ("postal_code", "postal"))}
    raised = F.filter(F.array(F.when(F.size("_r.addresses") > 1, "second-street"), F.when(F.size("_lines") > len(STREETS), "street-slots-full")), lambda x: x.isNotNull())
    return out.withColumns(lines | names | kept | {"preprocess_flags": F.array_union("preprocess_flags", raised)}).drop("_r", "_on", "_free", "_lines")


def route_care_of(df: DataFrame, sources: list[str]) -> DataFrame:
    """Care-of parts of the source slots: departments go to empty names, in order, the others to ``care_of``,
    joined. A department without a free name is joined to care_of as well, so nothing is lost."""
    out = df.withColumn("_x", F.transform(F.array(*[F.col(c) for c in sources]), lambda x: tx.let(ex.care_of(x), lambda v: F.struct(v["value"].alias("value"), v["rest"].alias("rest"), ex.looks_like_department(v["value"]).alias("unit")))))
    values = lambda unit: F.transform(F.filter("_x", lambda x: x["value"].isNotNull() & (x["unit"] == unit)), lambda x: x["value"])
    rest = {c: F.when(F.get("_x", F.lit(k))["value"].isNotNull(), tx.nullify(F.get("_x", F.lit(k))["rest"])).otherwise(F.col(c)) for k, c in enumerate(sources)}
    out = out.withColumns({"_units": values(True), "_care": values(False)} | rest)
    empty = [tx.blank(F.col(c)).cast("int") for c in NAMES]
    before = lambda k: sum(empty[:k], F.lit(0))
    room = sum(empty, F.lit(0))
    names = {c: F.when(empty[k] == 1, F.get("_units", before(k))).otherwise(F.col(c)) for k, c in enumerate(NAMES)}
    left = F.concat("_care", F.slice("_units", room + 1, F.greatest(F.size("_units"), F.lit(1))))
    return out.withColumns(names | {"care_of": F.aggregate(left, tx.nullify(F.col("care_of")), join_parts)}).drop("_x", "_units", "_care")
