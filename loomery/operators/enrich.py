"""Record enrichment: ordered clean-up of names and streets, evidence joins, final projection.

Stages are ``DataFrame -> DataFrame`` over name_1..name_5, street_1..street_5
and single columns; the order of stages is part of the meaning. All stages are
narrow; evidence comes by joins on the lookup key.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import coverage as cov
from loomery.functions import extract as ex
from loomery.functions import search_terms as st
from loomery.functions import text as tx
from loomery.operators.issues import NAMES, STREETS
from loomery.operators.registry_names import STATES
from loomery.operators.review import is_admin_desk
from loomery.operators.streets import route_care_of, route_segments

DEPARTMENTS = NAMES[1:]


def spread(df: DataFrame, key: str, rows_a_task: int = 4096) -> DataFrame:
    """``df`` dealt out by ``key``, ``rows_a_task`` to a partition on average: a record costs near a millisecond, and a table
    whose few columns fit one split would be one task's work, whatever the number of its rows."""
    return df.repartition(max(1, math.ceil(df.count() / rows_a_task)), key)


def _all(df: DataFrame, columns: list[str], f) -> DataFrame:
    """``f`` on every slot that isn't null; it is put into the plan once, for the array of them."""
    made = df.withColumn("_all", F.transform(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: F.when(x.isNotNull(), tx.let(f(x), tx.nullify))))
    return made.withColumns({c: F.get(F.col("_all"), F.lit(k)) for k, c in enumerate(columns)}).drop("_all")


def left_pack(df: DataFrame, columns: list[str]) -> DataFrame:
    """Populated slots first, in order."""
    kept = df.withColumn("_slots", F.filter(F.array(*[tx.nullify(F.col(c)) for c in columns]), lambda x: x.isNotNull()))
    return kept.withColumns({c: F.get(F.col("_slots"), F.lit(k)) for k, c in enumerate(columns)}).drop("_slots")


def insert_head(df: DataFrame, columns: list[str], value: Column, overflow: str) -> DataFrame:
    """``value`` at the head of the slots where it isn't null; the last slot's content goes to ``overflow``."""
    moved = {c: F.when(value.isNotNull(), F.col(columns[k - 1]) if k else value).otherwise(F.col(c)) for k, c in enumerate(columns)}
    return df.withColumns({overflow: F.when(value.isNotNull(), F.col(columns[-1]))} | moved)


def put_first_empty(df: DataFrame, columns: list[str], value: Column) -> DataFrame:
    """``value`` into the first empty slot; nothing where all are full (see ``has_room``)."""
    free = F.array_position(F.array(*[tx.blank(F.col(c)) for c in columns]), True)
    return df.withColumns({"_free": free, "_value": value}).withColumns({c: F.when((F.col("_free") == k + 1) & F.col("_value").isNotNull(), F.col("_value")).otherwise(F.col(c)) for k, c in enumerate(columns)}).drop("_free", "_value")


def has_room(columns: list[str]) -> Column:
    return F.greatest(*[tx.blank(F.col(c)) for c in columns])


SLOTS = "struct<names:array<string>,streets:array<string>,full:boolean>"


def fold_slots(df: DataFrame, when: Column, put) -> DataFrame:
    """Names and streets after ``put(slots, n)`` for n = 0..4 in turn, each on what the one before left; ``slots``
    is a struct(names, streets, full). Done in the rows with ``when``; the column ``_full`` says what ``full`` ended as."""
    start = F.struct(F.array(*NAMES).alias("names"), F.array(*STREETS).alias("streets"), F.lit(False).alias("full")).cast(SLOTS)
    steps = F.array(*[F.lit(n) for n in range(len(STREETS))])
    df = df.withColumn("_fold", F.when(when, F.aggregate(steps, start, lambda s, n: put(s, n).cast(SLOTS))))
    made = {c: F.when(F.col("_fold").isNotNull(), F.get(f"_fold.{kind}", F.lit(k))).otherwise(F.col(c)) for kind, slots in (("names", NAMES), ("streets", STREETS)) for k, c in enumerate(slots)}
    return df.withColumns(made | {"_full": F.coalesce("_fold.full", F.lit(False))}).drop("_fold")


def slots_of(names: Column, streets: Column, full: Column) -> Column:
    return F.struct(names.alias("names"), streets.alias("streets"), full.alias("full"))


def with_slot(slots: Column, n: Column, value) -> Column:
    """An array of slots whose n-th is ``value`` of it."""
    return F.transform(slots, lambda x, k: F.when(k == n, value(x)).otherwise(x))


def with_first_empty(slots: Column, value: Column) -> Column:
    """An array of slots with ``value`` in the first empty one."""
    return tx.let(F.array_position(F.transform(slots, tx.blank), True), lambda at: F.transform(slots, lambda x, k: F.when(k + 1 == at, value).otherwise(x)))


def with_values(slots: Column, values: Column) -> Column:
    """An array of slots with an array of values in the empty ones, in order."""
    before = lambda k: F.size(F.filter(F.slice(slots, F.lit(1), k), tx.blank))
    return F.transform(slots, lambda x, k: F.when(tx.blank(x), F.get(values, before(k))).otherwise(x))


def without_slot(slots: Column, values: Column) -> Column:
    """Those of the values that ``with_values`` has no slot for."""
    return F.slice(values, F.size(F.filter(slots, tx.blank)) + 1, F.greatest(F.size(values), F.lit(1)))


def raise_flag(df: DataFrame, flag: str, when: Column) -> DataFrame:
    """``flag`` into the array preprocess_flags."""
    have = F.col("preprocess_flags") if "preprocess_flags" in df.columns else F.array().cast("array<string>")
    return df.withColumn("preprocess_flags", F.when(when, F.array_union(have, F.array(F.lit(flag)))).otherwise(have))


def route_first(df: DataFrame, sources: list[str], f, target: str) -> DataFrame:
    """The first extraction ``f`` (struct(value, rest)) over the slots goes to ``target``
    if that is empty. A slot loses its piece only where ``target`` now says the same;
    another piece stays where it is, and the flag '<target>-conflict' is raised."""
    got = df.withColumn("_x", F.transform(F.array(*[F.col(c) for c in sources]), lambda x: f(x)))
    value = F.get(F.filter(F.transform("_x", lambda x: x["value"]), lambda v: v.isNotNull()), F.lit(0))
    got = got.withColumn(target, F.coalesce(tx.nullify(F.col(target)), value))
    same = lambda x: F.coalesce(tx.clean_whitespace(F.lower(x["value"])) == tx.clean_whitespace(F.lower(F.col(target))), F.lit(False))
    got = got.withColumn("_rest", F.transform("_x", lambda x: F.struct(same(x).alias("placed"), F.when(same(x), tx.nullify(x["rest"])).alias("text"))))
    got = raise_flag(got, f"{target.replace('_', '-')}-conflict", F.exists("_x", lambda x: x["value"].isNotNull() & ~same(x)))
    rest = lambda k: F.get(F.col("_rest"), F.lit(k))
    return got.withColumns({c: F.when(rest(k)["placed"], rest(k)["text"]).otherwise(F.col(c)) for k, c in enumerate(sources)}).drop("_x", "_rest")


def take(f):
    """A plain extraction as struct(value, rest)."""
    return lambda c: tx.let(f(c), lambda v: F.struct(v.alias("value"), ex.cut_first(c, v).alias("rest")))


#: Parent organisations that units are written behind.
PARENTS = ["USDA", "NIH", "CDC", "FDA", "EPA", "NASA", "NOAA", "USGS", "CNRS", "CSIRO", "CSIC", "INSERM"]


def split_parents(df: DataFrame) -> DataFrame:
    """'USDA - Unit' in Name 1: the parent stays, the unit goes to the head of the departments; adds name_overflow."""
    pattern = rf"(?i)^\s*({'|'.join(PARENTS)})\s*[-–—,/:]\s*(\S.*)$"
    unit, parent = ex.found(F.col("name_1"), pattern, 2), F.upper(ex.found(F.col("name_1"), pattern, 1))
    df = df.withColumns({"_unit": unit, "_parent": parent})
    return insert_head(df, DEPARTMENTS, F.col("_unit"), "name_overflow").withColumn("name_1", F.coalesce("_parent", "name_1")).drop("_unit", "_parent")


def split_brackets(df: DataFrame) -> DataFrame:
    """'(Org) rest' in Name 1: the organisation stays, the rest goes to the first empty
    slot of its kind; where there is none, Name 1 stays as it is."""
    pattern = r"^\s*\(([^()]{3,})\)\s*(\S.*)$"
    rest = ex.found(F.col("name_1"), pattern, 2)
    df = df.withColumns({"_rest": rest, "_street": ex.looks_like_street(rest)})
    room = F.when(F.col("_street"), has_room(STREETS)).otherwise(has_room(DEPARTMENTS))
    df = df.withColumns({"_rest": F.when(room, F.col("_rest")), "_org": F.when(room, ex.found(F.col("name_1"), pattern, 1))})
    df = put_first_empty(df, STREETS, F.when(F.col("_street"), F.col("_rest")))
    df = put_first_empty(df, DEPARTMENTS, F.when(~F.col("_street"), F.col("_rest")))
    return df.withColumn("name_1", F.coalesce("_org", "name_1")).drop("_org", "_rest", "_street")


def split_streets(df: DataFrame, separator: str = r"[|;]") -> DataFrame:
    """Streets of several segments: addresses stay, organisations and departments go to
    the empty names, what else there is to the empty streets. Segments without a slot
    stay in their street, behind the addresses, and raise the flag 'street-slots-full'."""
    kind = lambda x: F.when(ex.looks_like_street(x) | ex.has(x, ex.PO_BOX), 0).when(ex.looks_like_department(x) | tx.looks_like_research(x) | tx.is_unit_construction(x), 1).otherwise(2)
    parts_of = lambda x: F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), separator), lambda y: F.trim(y)), lambda y: y != "")
    df = df.withColumn("_cells", F.transform(F.array(*[F.col(c) for c in STREETS]), lambda x: tx.let(parts_of(x), lambda p: F.when(F.size(p) > 1, F.transform(p, lambda y: F.struct(kind(y).alias("k"), y.alias("v")))))))

    def put(s: Column, n: Column) -> Column:
        parts = F.get("_cells", n)
        of = lambda k: F.transform(F.filter(parts, lambda p: p["k"] == k), lambda p: p["v"])
        joined = lambda pieces, by: F.nullif(F.array_join(pieces, by), F.lit(""))
        kept = with_slot(s["streets"], n, lambda _: joined(of(0), ", "))
        left = F.concat(without_slot(s["names"], of(1)), without_slot(kept, of(2)))
        streets = with_slot(with_values(kept, of(2)), n, lambda x: joined(F.filter(F.concat(F.array(x), left), lambda y: y.isNotNull()), "; "))
        return F.when(parts.isNotNull(), slots_of(with_values(s["names"], of(1)), streets, s["full"] | (F.size(left) > 0))).otherwise(s)

    df = df.withColumns({c: F.when(~tx.blank(F.col(c)), F.col(c)) for c in NAMES + STREETS})
    df = fold_slots(df, F.exists("_cells", lambda x: x.isNotNull()), put)
    return raise_flag(df, "street-slots-full", F.col("_full")).drop("_cells", "_full")


def departments_to_names(df: DataFrame) -> DataFrame:
    """Departments and organisations that stand in streets go to the first empty name; without one they stay."""
    moves = lambda x: (ex.looks_like_department(x) & ~ex.looks_like_street(x)) | ex.organisation_in_street(x)
    df = df.withColumn("_moves", F.transform(F.array(*STREETS), moves))

    def put(s: Column, n: Column) -> Column:
        moved = slots_of(with_first_empty(s["names"], F.get(s["streets"], n)), with_slot(s["streets"], n, lambda _: F.lit(None).cast("string")), s["full"])
        return F.when(F.get("_moves", n) & F.exists(s["names"], tx.blank), moved).otherwise(s)

    return fold_slots(df, F.exists("_moves", lambda x: x), put).drop("_moves", "_full")


def addresses_to_streets(df: DataFrame) -> DataFrame:
    """An address in a name goes to the first empty street, unless a street says the same; without one it stays in the name."""
    piece = lambda x: F.when(ex.may_hold_street(x), F.get(F.filter(ex.address_fragments(x), lambda y: ex.looks_like_street(y)), F.lit(0)))
    df = df.withColumn("_pieces", F.transform(F.array(*NAMES), piece))
    any_piece = F.exists("_pieces", lambda x: x.isNotNull())
    known = F.transform(F.array(*STREETS), ex.street_key)
    df = df.withColumn("_new", F.when(any_piece, tx.let(known, lambda have: F.transform("_pieces", lambda x: F.when(~F.array_contains(have, ex.street_key(x)), x)))))

    def put(s: Column, n: Column) -> Column:
        out, new = F.get("_pieces", n), F.get("_new", n)
        names = with_slot(s["names"], n, lambda x: tx.nullify(ex.cut_first(x, out)))
        streets = F.when(new.isNotNull(), with_first_empty(s["streets"], new)).otherwise(s["streets"])
        return F.when(out.isNotNull() & (new.isNull() | F.exists(s["streets"], tx.blank)), slots_of(names, streets, s["full"])).otherwise(s)

    return fold_slots(df, any_piece, put).drop("_pieces", "_new", "_full")


def split_embedded_department(df: DataFrame) -> DataFrame:
    """'Ohio University Department of X' in Name 1: the unit goes to the first empty department."""
    pattern = r"^(.*\b(?:University|College|Institute|Hospital)\b.*?)[\s,\-]+((?:Department|Dept\.?|Division|School|Faculty)\s+of\s+\S.*)$"
    df = df.withColumns({"_org": ex.found(F.col("name_1"), pattern, 1), "_unit": ex.found(F.col("name_1"), pattern, 2)})
    free = F.greatest(*[tx.blank(F.col(c)) for c in DEPARTMENTS])
    df = df.withColumns({"_org": F.when(free, F.col("_org")), "_unit": F.when(free, F.col("_unit"))})
    return put_first_empty(df, DEPARTMENTS, F.col("_unit")).withColumn("name_1", F.coalesce("_org", "name_1")).drop("_org", "_unit")


def preprocess(df: DataFrame) -> DataFrame:
    """Names and contacts, in order: codes, repeats, parents, acronyms beside what they stand for, care-of (departments to names), street segments, departments in streets,
    accounts payable, e-mail, addresses in names, brackets, DBA, legal forms, opaque codes, persons, embedded
    departments, junk, packing, duplicates."""
    for c in ("contact", "email", "care_of", "building"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumns({f"{c}_original": F.col(c) for c in NAMES})
    df = _all(df, NAMES, lambda c: ex.collapse_repeat(ex.strip_leading_code(c)))
    df = _all(df, STREETS, ex.collapse_repeat)
    df = split_parents(df)
    df = df.withColumn("name_1", cov.without_acronym(F.col("name_1")))
    df = route_care_of(df, DEPARTMENTS)
    df = split_streets(df)
    df = departments_to_names(df)
    df = df.withColumn("_desk", F.when(has_room(DEPARTMENTS), ex.split_accounts_payable(F.col("name_1"))))
    df = put_first_empty(df, DEPARTMENTS, F.when(F.col("_desk").isNotNull(), "Accounts Payable")).withColumn("name_1", F.coalesce("_desk", "name_1")).drop("_desk")
    df = df.withColumns({c: F.when(ex.is_accounts_payable(F.col(c)), "Accounts Payable").otherwise(F.col(c)) for c in DEPARTMENTS})
    df = route_first(df, NAMES + STREETS, take(ex.email), "email")
    df = addresses_to_streets(df)
    df = split_brackets(df)
    df = _all(df, NAMES, lambda c: tx.collapse_legal_suffix(ex.normalise_dba(tx.strip_parentheticals(c))))
    df = df.withColumns({c: F.when(~ex.is_opaque_code(F.col(c)), F.col(c)) for c in DEPARTMENTS})
    df = route_first(df, DEPARTMENTS, take(ex.titled_person), "contact")
    df = split_embedded_department(df)
    df = _all(_all(df, DEPARTMENTS, ex.strip_junk), STREETS, ex.strip_street_junk)
    return drop_equal_slots(left_pack(df, DEPARTMENTS), NAMES)


def drop_equal_slots(df: DataFrame, columns: list[str]) -> DataFrame:
    """A slot equal (as a unit, whatever its wording) to one above it is cleared, then slots are packed."""
    df = df.withColumn("_units", F.transform(F.array(*[F.col(c) for c in columns]), lambda x: F.lower(tx.canonicalise_unit(x))))
    unit = lambda k: F.get(F.col("_units"), F.lit(k))
    seen = lambda k: reduce(lambda a, b: a | b, [F.coalesce(unit(k) == unit(j), F.lit(False)) for j in range(k)])
    df = df.withColumns({c: F.when(~seen(k), F.col(c)) for k, c in enumerate(columns) if k}).drop("_units")
    return left_pack(df, columns[1:])


def process_address(df: DataFrame) -> DataFrame:
    """Streets, in order: full address, typed segments of a mixed street, PO box, care-of, unloading point, mail code, sub-locations,
    trailing qualifier, abbreviations, equal lines, packing."""
    for c in ("po_box", "care_of", "unloading_point", "mail_code", "city", "state", "postal_code", *NAMES, *ex.KINDS):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    if "preprocess_flags" not in df.columns:
        df = df.withColumn("preprocess_flags", F.array().cast("array<string>"))
    df = df.withColumn("_full", ex.full_address(F.col("street_1")))
    whole = F.col("_full.street").isNotNull()
    df = df.withColumns({"street_1": F.when(whole, F.col("_full.street")).otherwise(F.col("street_1")), "city": F.coalesce(tx.nullify(F.col("city")), "_full.city"), "state": F.coalesce(tx.nullify(F.col("state")), "_full.state"), "postal_code": F.coalesce(tx.nullify(F.col("postal_code")), "_full.postal_code")}).drop("_full")
    df = route_segments(df)
    df = route_first(df, STREETS, ex.po_box, "po_box")
    df = route_care_of(df, STREETS)
    df = route_first(df, STREETS, ex.logistics, "unloading_point")
    df = route_first(df, STREETS[:1], lambda c: ex.mail_code(c, bare=False), "mail_code")
    df = route_first(df, STREETS[1:], ex.mail_code, "mail_code")
    df = df.withColumns({f"_s_{c}": ex.sublocations(F.col(c)) for c in STREETS})
    df = df.withColumns({k: F.coalesce(tx.nullify(F.col(k)), *[F.col(f"_s_{c}.{k}") for c in STREETS]) for k in ex.KINDS})
    # a street loses its pieces only where each of them is what the record now has
    kept = lambda c: reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_s_{c}.{k}") == F.col(k), F.col(f"_s_{c}.{k}").isNull()) for k in ex.KINDS])
    df = raise_flag(df, "sub-location-conflict", reduce(lambda a, b: a | b, [~kept(c) for c in STREETS]))
    df = df.withColumns({c: F.when(F.col(c).isNotNull() & kept(c), tx.nullify(F.col(f"_s_{c}.rest"))).otherwise(F.col(c)) for c in STREETS}).drop(*[f"_s_{c}" for c in STREETS])
    df = df.withColumn("_q", F.when(has_room(STREETS[1:]), ex.location_qualifier(F.col("street_1")))).withColumn("street_1", F.coalesce("_q.street", "street_1"))
    df = put_first_empty(df, STREETS[1:], F.col("_q.qualifier")).drop("_q")
    df = _all(df, STREETS, ex.normalise_street)
    lines = F.array_distinct(F.filter(F.array(*[F.col(c) for c in STREETS]), lambda x: x.isNotNull()))
    return df.withColumn("_l", lines).withColumns({c: F.get(F.col("_l"), F.lit(k)) for k, c in enumerate(STREETS)}).drop("_l")


def finalise(df: DataFrame) -> DataFrame:
    """Abbreviations, legal forms and unit names made official, Division before Department, changes marked."""
    df = df.withColumn("name_1", tx.let(tx.expand_abbreviations(F.col("name_1")), tx.collapse_legal_suffix))
    df = _all(df, DEPARTMENTS, lambda c: F.when(tx.is_granular_unit(c), c).otherwise(tx.canonicalise_unit(c)))
    df = drop_equal_slots(df, NAMES)
    rank = lambda x: F.when(tx.ordered_unit_word(x) == "Division", 0).otherwise(1)
    slots = F.filter(F.array(*[F.col(c) for c in DEPARTMENTS]), lambda x: x.isNotNull())
    units = F.transform(slots, lambda x: F.struct(rank(x).alias("r"), x.alias("v")))
    divisions, rest = F.filter(units, lambda u: u["r"] == 0), F.filter(units, lambda u: u["r"] == 1)
    df = df.withColumn("_d", F.transform(F.concat(divisions, rest), lambda u: u["v"])).withColumns({c: F.get(F.col("_d"), F.lit(k)) for k, c in enumerate(DEPARTMENTS)}).drop("_d")
    return df.withColumns({f"{c}_changed": F.coalesce(F.lower(F.col(c)) != F.lower(F.coalesce(F.col(f"{c}_original"), F.lit(""))), F.lit(False)) for c in NAMES})


def join_evidence(df: DataFrame, evidence: DataFrame, key: Column, prefix: str) -> DataFrame:
    """Left join with an evidence table (key, ...); a miss is null. Evidence has one row per key."""
    e = evidence.select(F.col("key").alias("_key"), *(F.col(c).alias(f"{prefix}_{c}") for c in evidence.columns if c != "key"))
    return df.withColumn("_lookup", key).join(e, F.col("_lookup") == F.col("_key"), "left").drop("_lookup", "_key")


def route_tiers(df: DataFrame) -> DataFrame:
    """tier and status by what the evidence answered: registry A, registry B, crosswalk, proposal, else unresolved.

    Needs ror_name, lei_name, wikidata_name and proposal_name; research names skip registry B.
    """
    research = tx.looks_like_research(F.col("name_1"))
    name = F.coalesce("ror_name", F.when(~research, F.col("lei_name")), "wikidata_name", F.when(~research, F.col("proposal_name")))
    tier = F.when(F.col("ror_name").isNotNull() | (~research & F.col("lei_name").isNotNull()) | F.col("wikidata_name").isNotNull(), 1).when(~research & F.col("proposal_name").isNotNull(), 2)
    status = F.when(name.isNull(), "unresolved").when(F.lower(name) == F.lower("name_1"), "verified").otherwise("enriched")
    return df.withColumns({"tier_used": tier, "enrichment_status": status, "name1_enriched": F.coalesce(name, "name_1")})


def summarise(results: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("enrichment_status") == s).alias(s)
    return results.agg(F.count("*").alias("total"), n("enriched"), n("verified"), n("unresolved"), F.count_if(F.col("tier_used") == 1).alias("tier1"), F.count_if(F.col("tier_used") == 2).alias("tier2"))


def search_terms(df: DataFrame) -> DataFrame:
    """search_term_1 (institution) and search_term_2 (unit) of name_1 and name_2, with domain, department_domain, ror_acronym,
    city, region and country where ``df`` has them: at most two words each, upper case, 32 wide."""
    have = lambda *names: next((F.col(c).cast("string") for c in names if c in df.columns), F.lit(None).cast("string"))
    regions = {k: v.lower() for k, v in STATES.items() if len(k) == 2}
    states = F.split(F.lit(" ".join(v for v in sorted(set(regions.values())) if " " not in v)), " ")
    df = df.withColumn("_geo", F.array_union(st.geo_words(have("city"), have("region", "state"), have("country"), regions), states))
    one = st.search_term_1(F.col("name_1"), have("domain"), have("ror_acronym"), F.col("_geo"))
    two = st.search_term_2(F.col("name_2"), have("domain"), have("department_domain"), F.col("_geo"), is_admin_desk(F.col("name_2")))
    return df.withColumns({"search_term_1": one, "search_term_2": two}).drop("_geo")
