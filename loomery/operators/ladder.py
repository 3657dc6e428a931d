"""The tier ladder: records climb from the strongest evidence to the weakest.

A *rung* sees only the records that are still open. It takes their distinct
lookup keys, asks its source once for each key that it wasn't asked for before,
joins the answers back, and settles a record or passes it on. What a rung has
worked out is written once; the settled rows of all rungs, put together, are the
result. So a source (a table, or a client that answers keys) never sees a key
twice, however many records share it, and a settled record costs nothing more.

Sources answer a table of distinct ``key`` values with (key, ...); a key without
an answer is a miss. ``table_source`` makes one of an evidence table. By name:

=========== ============================================== ==========================================
source      key                                            answer
=========== ============================================== ==========================================
ror, lei    name, country                                  name, id, research, website, variants, children
crosswalk   name, country                                  registry, id, name, website
proposal    name, country                                  name, accepted
affiliation contact, country                               institution, department, confidence
parent      institution, unit                              name, confidence
unit        institution, unit                              name
contact     institution, contact                           unit, confidence, status
grounded    names 1 and 2, country                         name_1, origin_1, id_1, name_2, origin_2, confidence, clear_2, degraded
last        names 1 and 2, country                         name_1 .. name_5, confidence, status
=========== ============================================== ==========================================

Rungs, in order: *affiliation* (a contact without a name), *registry* (research
and company registry), *legal* (company registry), *crosswalk*, *proposal* (a
canonical name, confirmed by the legal registry where it only mends a typo),
*desk* (accounts payable), *parent* (the department of a laboratory), *units*
(official names of departments), *contact*, *last* (grounded answers, then a
plain suggestion). At the end a record without an identifier whose name was
changed goes back to the registries once, under its new name.

Defined cases: blank and null slots are the same; records may share a key and a
record_id, rows are told apart by ``row``; null keys are never asked; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.functions import extract as ex
from loomery.functions import text as tx
from loomery.functions.similarity import ratio_of, token_sort_ratio
from loomery.operators.issues import NAMES
from loomery.sources.evidence import registry_key
from loomery.sources.scratch import staged

DEPARTMENTS = NAMES[1:]
CHILD_THRESHOLD, TYPO_RATIO = 70.0, 85.0
Source = Callable[[DataFrame], DataFrame]

ANSWERS = {
    "ror": "name string, id string, research boolean, website string, variants array<string>, children array<string>",
    "lei": "name string, id string, confidence string",
    "crosswalk": "registry string, id string, name string, website string",
    "proposal": "name string, accepted boolean",
    "affiliation": "institution string, department string, confidence string",
    "parent": "name string, confidence string",
    "unit": "name string",
    "contact": "unit string, confidence string, status string",
    "grounded": "name_1 string, origin_1 string, id_1 string, name_2 string, origin_2 string, confidence string, clear_2 boolean, degraded boolean",
    "last": "name_1 string, name_2 string, name_3 string, name_4 string, name_5 string, confidence string, status string",
}
ENRICHED = [f"{c}_enriched" for c in NAMES]
RESULT = ["ror_id", "lei_id", "domain", "tier_used", "source", "confidence", "routing_type", "enrichment_status", "use_cases", "flags", "retried"]

# Words that don't tell one organisation from another, and words that a name may gain.
GENERIC_WORDS = "group inc incorporated llc llp lp corp corporation company co ltd limited holdings holding plc gmbh ag sa nv bv spa srl pty the and of for".split()
ADDABLE_WORDS = "university universities college colleges school schools institute institutes laboratory laboratories foundation center centre centers hospital hospitals clinic academy conservatory seminary polytechnic".split()


def table_source(answers: DataFrame, schema: str) -> Source:
    """A source made of a table (key, ...); of several answers to a key the least counts."""
    names = [c.split()[0] for c in schema.split(", ")]
    have = [F.col(c).cast(t) if c in answers.columns else F.lit(None).cast(t) for c, t in (x.split() for x in schema.split(", "))]
    one = answers.groupBy("key").agg(F.min(F.struct(*(h.alias(n) for h, n in zip(have, names)))).alias("a")).select("key", "a.*")
    return lambda wanted: wanted.join(one, "key", "left")


def two_part_key(a: Column, b: Column) -> Column:
    """Key of a name within another: null where either is blank."""
    return F.when(~tx.blank(a) & ~tx.blank(b), F.concat_ws("|", tx.fold_key(a), tx.fold_key(b)))


def name_key(name: Column, country: Column) -> Column:
    return F.when(~tx.blank(name), registry_key(name, country))


def spelling_variant_of(a: str, b: str) -> bool:
    """``b`` is ``a`` but for typing errors: every telling word of ``a`` has one in ``b`` that equals,
    begins or nearly equals it, one of them only nearly; what ``b`` has besides says its type alone."""
    words = lambda x: {w for w in re.findall("[a-z0-9]+", x.lower()) if len(w) > 1 and w not in GENERIC_WORDS}
    covers = lambda x, y: x == y or (min(len(x), len(y)) >= 4 and (x.startswith(y) or y.startswith(x)))
    near = lambda x, y: covers(x, y) or (min(len(x), len(y)) >= 4 and ratio_of(x, y) >= TYPO_RATIO)
    x, y = words(a), words(b)
    if not x or not y or all(any(covers(s, t) for t in y) for s in x) or not all(any(near(s, t) for t in y) for s in x):
        return False
    return all(t in ADDABLE_WORDS for t in y if not any(near(s, t) for s in x))


@F.pandas_udf(T.BooleanType())
def spelling_variant(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bool(x and y and spelling_variant_of(x, y)) for x, y in zip(a, b)])


class Sources:
    """Asks each source once for a key, and remembers what it said."""

    def __init__(self, sources: dict[str, Source]):
        self.sources, self.known = sources, {}

    def ask(self, source: str, rows: DataFrame, key: Column, when: Column) -> DataFrame:
        """``rows`` with the struct ``answer``, null on a miss and where ``when`` doesn't hold."""
        rows = rows.withColumn("_key", F.when(when, key))
        wanted = rows.select(F.col("_key").alias("key")).filter("key is not null").distinct()
        before = self.known.get(source)
        if before is not None:
            wanted = wanted.join(before, "key", "left_anti")
        got = staged(self.sources[source](wanted), f"answers-{source}")
        self.known[source] = got if before is None else before.unionByName(got)
        fields = [c.split()[0] for c in ANSWERS[source].split(", ")]
        said = self.known[source].filter(F.greatest(*(F.col(c).isNotNull() for c in fields)) if len(fields) > 1 else F.col(fields[0]).isNotNull())
        answers = said.select(F.col("key").alias("_of"), F.struct(*fields).alias("answer"))
        return rows.join(answers, F.col("_key") == F.col("_of"), "left").drop("_key", "_of")


def _put(df: DataFrame, when: Column, **values) -> DataFrame:
    """``values`` where ``when`` holds; all of them see the row as it was."""
    df = df.withColumn("_when", F.coalesce(when, F.lit(False)))
    new = {c: F.when(F.col("_when"), v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}
    return df.withColumns(new).drop("_when")


def _cases(*n: int) -> Column:
    return F.array_union("use_cases", F.array(*map(F.lit, n)))


def _flag(name: str) -> Column:
    return F.array_union("flags", F.array(F.lit(name)))


def _filled(c: str) -> Column:
    return ~tx.blank(F.col(c))


def _any_department() -> Column:
    return F.greatest(*map(_filled, DEPARTMENTS))


def _registered(df: DataFrame, when: Column, registry: str, name: Column, id_: Column, **more) -> DataFrame:
    """A registry's name and identifier, as an authority of tier 1."""
    ids = {"ror_id": id_} if registry == "ROR" else {"lei_id": id_}
    return _put(df, when, name_1_enriched=name, tier_used=1, source=registry, enrichment_status="enriched", use_cases=_cases(2, 3), **ids, **{"confidence": F.lit("high")} | more)


def _site(website: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(website, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://)?([^/?#:]+)", 1)), r"^www\.", "")
    return F.when(host != "", host)


class Ladder:
    def __init__(self, sources: dict[str, Source]):
        self.sources = Sources(sources)

    def start(self, records: DataFrame) -> DataFrame:
        have = lambda c, t="string": F.col(c).cast(t) if c in records.columns else F.lit(None).cast(t)
        text = {c: tx.nullify(have(c)) for c in (*NAMES, "contact", "country")}
        first = {"ror_id": "string", "lei_id": "string", "domain": "string", "tier_used": "int", "source": "string", "confidence": "string", "enrichment_status": "string", "retried": "string"}
        rows = records.select(have("row", "long").alias("row"), have("record_id").alias("record_id"), *(v.alias(c) for c, v in text.items()), *(have(f"{c}_original").alias(f"{c}_original") for c in NAMES))
        if "row" not in records.columns:
            rows = rows.withColumn("row", F.monotonically_increasing_id())
        rows = rows.withColumns({f"{c}_original": F.coalesce(f"{c}_original", c) for c in NAMES})
        empty = F.array().cast("array<string>")
        return staged(rows.withColumns({c: F.lit(None).cast("string") for c in ENRICHED} | {c: F.lit(None).cast(t) for c, t in first.items()} | {"routing_type": F.lit("unknown"), "use_cases": F.array().cast("array<int>"), "flags": empty, "children": empty, "ran_unit": F.lit(False), "settled": F.lit(False)}), "records")

    def run(self, records: DataFrame) -> DataFrame:
        """All rows of ``records`` (name_1..5, contact, country, record_id) with what the ladder found, and the rung that settled each."""
        rows, done = self.start(records), []
        for rung in (self.affiliation, self.registry, self.legal, self.crosswalk, self.proposal, self.desk, self.parent, self.units, self.contact, self.last):
            name = rung.__name__
            out = staged(rung(rows), name)
            done.append(out.filter("settled").withColumn("rung", F.lit(name)))
            rows = out.filter("not settled")
        done = reduce(DataFrame.unionByName, done)
        return self.again(done).select("row", "record_id", *NAMES, *ENRICHED, *RESULT, "rung")

    def _child_names(self, df: DataFrame) -> DataFrame:
        """Departments that are children of the matched organisation take the child's name."""
        open_ = df.filter("not settled and size(children) > 0").select("row", F.posexplode(F.array(*DEPARTMENTS)).alias("slot", "unit"), "children").filter("unit is not null")
        pairs = open_.select("row", "slot", tx.expand_abbreviations(F.col("unit")).alias("unit"), F.posexplode("children").alias("place", "child"))
        scored = pairs.withColumn("score", token_sort_ratio(F.lower("unit"), F.lower("child"))).filter(F.col("score") >= CHILD_THRESHOLD)
        best = scored.groupBy("row", "slot").agg(F.min_by("child", F.struct(-F.col("score"), F.col("place"))).alias("child"))
        by_row = best.groupBy(F.col("row").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "child"))).alias("_child"))
        out = df.join(by_row, F.col("row") == F.col("_row"), "left")
        return out.withColumns({f"{c}_enriched": F.coalesce(F.col("_child")[F.lit(k)], F.col(f"{c}_enriched")) for k, c in enumerate(DEPARTMENTS)}).drop("_row", "_child")

    def affiliation(self, rows: DataFrame) -> DataFrame:
        """A record with a contact and no name: the person's institution, if the registry knows it."""
        alone = ~_filled("name_1") & _filled("contact")
        rows = self.sources.ask("affiliation", rows, name_key(F.col("contact"), F.col("country")), alone).withColumnRenamed("answer", "person")
        rows = self.sources.ask("ror", rows, name_key(F.col("person.institution"), F.col("country")), alone & F.col("person.confidence").isin("high", "medium"))
        hit = alone & F.col("answer.id").isNotNull()
        site = _site(F.col("answer.website"))
        rows = _registered(rows, hit, "ROR", F.coalesce("answer.name", "person.institution"), F.col("answer.id"), confidence=F.lit("medium"), domain=site, routing_type=_type_of(), name_2_enriched=F.when(~_filled("name_2"), F.col("person.department")))
        rows = _put(rows, hit, use_cases=F.array().cast("array<int>"))
        rows = _put(rows, alone & ~hit, enrichment_status="unresolved", flags=_flag("person-unresolved"))
        return _put(rows, alone, settled=True).drop("answer", "person")

    def registry(self, rows: DataFrame) -> DataFrame:
        """The research registry; departments are compared with the organisation's children."""
        rows = self.sources.ask("ror", rows, name_key(F.col("name_1"), F.col("country")), F.lit(True))
        hit = F.col("answer.id").isNotNull()
        rows = _registered(rows, hit, "ROR", _stated_or_official(F.col("name_1")), F.col("answer.id"), domain=_site(F.col("answer.website")), routing_type=_type_of(), children=F.coalesce("answer.children", F.array().cast("array<string>")))
        ends = hit & F.col("answer.research") & ~_filled("name_2") & ~_filled("contact")
        return self._child_names(_put(rows, ends, settled=True).drop("answer"))

    def legal(self, rows: DataFrame) -> DataFrame:
        """The company registry, for companies of the first one and names that it missed and that aren't research."""
        missed, research = F.col("ror_id").isNull(), tx.looks_like_research(F.col("name_1"))
        asked = _filled("name_1") & F.when(missed, ~research).otherwise(F.col("routing_type") == "company")
        rows = self.sources.ask("lei", rows, name_key(F.col("name_1"), F.col("country")), asked)
        rows = rows.withColumn("_hit", F.col("answer.id").isNotNull())
        rows = _registered(rows, F.col("_hit"), "gleif", F.col("answer.name"), F.col("answer.id"), confidence=F.coalesce("answer.confidence", F.lit("high")))
        ends = F.when(F.col("ror_id").isNotNull(), (F.col("routing_type") == "company") & ~_filled("name_2") & ~_filled("contact")).otherwise(F.col("_hit") & ~_filled("name_2"))
        return _put(rows, ends, settled=True).drop("answer", "_hit")

    def crosswalk(self, rows: DataFrame) -> DataFrame:
        """Pointers of a knowledge base to a registry, for names without an identifier."""
        research = tx.looks_like_research(F.col("name_1"))
        none = _filled("name_1") & F.col("ror_id").isNull() & F.col("lei_id").isNull()
        rows = self.sources.ask("crosswalk", rows, name_key(F.col("name_1"), F.col("country")), none).withColumns({"_hit": F.col("answer.id").isNotNull(), "_none": none, "_research": research})
        for registry, label in (("ror", "ROR"), ("lei", "gleif")):
            rows = _registered(rows, F.col("_hit") & (F.col("answer.registry") == registry), label, F.col("answer.name"), F.col("answer.id"), domain=F.coalesce(_site(F.col("answer.website")), "domain"))
        rows = _put(rows, F.col("_hit") & F.col("_research"), routing_type="research_institution")
        rows = _put(rows, F.col("_none") & F.col("_research") & ~F.col("_hit"), name_1_enriched=F.col("name_1"), source="passthrough", confidence="low", tier_used=1, routing_type="research_institution", enrichment_status="unresolved")
        ends = F.col("_none") & ~_filled("name_2") & F.when(F.col("_research"), ~_filled("contact")).otherwise(F.col("_hit"))
        return _put(rows, ends, settled=True).drop("answer", "_hit", "_none", "_research")

    def proposal(self, rows: DataFrame) -> DataFrame:
        """A proposed canonical name; a rejected one that only mends a typo is asked of the company registry."""
        none = _filled("name_1") & F.col("ror_id").isNull() & F.col("lei_id").isNull() & ~tx.looks_like_research(F.col("name_1"))
        rows = self.sources.ask("proposal", rows, name_key(F.col("name_1"), F.col("country")), none).withColumnRenamed("answer", "said").withColumn("_none", none)
        typo = F.col("_none") & ~F.coalesce("said.accepted", F.lit(False)) & F.col("said.name").isNotNull()
        rows = rows.withColumn("_typo", F.when(typo, spelling_variant("name_1", "said.name")).otherwise(False))
        rows = self.sources.ask("lei", rows, name_key(F.col("said.name"), F.col("country")), F.col("_typo")).withColumn("_mended", F.col("answer.id").isNotNull())
        rows = _registered(rows, F.col("_mended"), "gleif", F.col("answer.name"), F.col("answer.id"), confidence=F.coalesce("answer.confidence", F.lit("high")))
        accepted = F.coalesce(F.col("said.accepted"), F.lit(False)) & F.col("said.name").isNotNull()
        same = accepted & (tx.fold_key(F.col("said.name")) == tx.fold_key(F.col("name_1")))
        rows = rows.withColumns({"_same": F.col("_none") & F.coalesce(same, F.lit(False)), "_new": F.col("_none") & accepted & ~F.coalesce(same, F.lit(False)), "_new_name": F.col("said.name")})
        passed = {"name_1_enriched": F.col("name_1"), "source": "passthrough", "confidence": "low", "tier_used": 1}
        rows = _put(rows, F.col("_same"), routing_type="company", enrichment_status="unresolved", **passed)
        rows = _put(rows, F.col("_new"), name_1_enriched=F.col("_new_name"), source="llm_canonical", confidence="high", routing_type="company", tier_used=2, use_cases=_cases(2, 3), enrichment_status="enriched")
        rows = _put(rows, F.col("_none") & ~F.col("_same") & ~F.col("_new") & ~F.col("_mended"), routing_type="unknown", **passed)
        rows = _put(rows, (F.col("_same") | F.col("_new") | F.col("_mended")) & ~_filled("name_2"), settled=True)
        return rows.drop("answer", "said", "_none", "_typo", "_mended", "_same", "_new", "_new_name")

    def desk(self, rows: DataFrame) -> DataFrame:
        """Accounts payable among the names: its departments are as they should be."""
        desk = F.greatest(*(F.coalesce(F.lower(F.col(c)) == "accounts payable", F.lit(False)) for c in NAMES))
        return _put(rows, desk, tier_used=2, source="pattern_match", confidence="high", enrichment_status="enriched", use_cases=_cases(6), settled=True, **{f"{c}_enriched": F.coalesce(c, f"{c}_enriched") for c in DEPARTMENTS})

    def parent(self, rows: DataFrame) -> DataFrame:
        """A research institution's laboratory: its department takes the slot, the laboratory the next free one."""
        child = F.col("name_2_enriched").isNotNull() & (F.lower("name_2_enriched") != F.lower("name_2")) & ~tx.is_granular_unit(F.col("name_2_enriched"))
        lab = (F.col("routing_type") == "research_institution") & _filled("name_2") & tx.is_granular_unit(F.col("name_2")) & ~F.coalesce(child, F.lit(False))
        rows = self.sources.ask("parent", rows, two_part_key(F.coalesce("name_1_enriched", "name_1"), F.col("name_2")), lab).withColumn("_lab", lab)
        hit = F.col("answer.name").isNotNull()
        free = F.array_position(F.array(*(tx.blank(F.col(c)) for c in DEPARTMENTS[1:])), True)
        rows = rows.withColumns({"_hit": hit, "_free": F.when(hit, free)})
        rows = _put(rows, F.col("_lab"), use_cases=_cases(13))
        rows = _put(rows, F.col("_hit"), name_2_enriched=F.col("answer.name"), tier_used=2, source="dept_search", confidence=F.col("answer.confidence"), enrichment_status="enriched", settled=True, flags=F.when(F.col("_free") > 0, _flag("dept-via-lab")).otherwise(F.array_union(_flag("dept-via-lab"), F.array(F.lit("name3-not-demoted")))), **{f"{c}_enriched": F.when(F.col("_free") == k + 1, F.col("name_2")).otherwise(F.col(f"{c}_enriched")) for k, c in enumerate(DEPARTMENTS[1:])})
        return rows.drop("answer", "_lab", "_hit", "_free")

    def units(self, rows: DataFrame) -> DataFrame:
        """Official names of the departments, slot by slot; labs and groups are too fine to be one."""
        known = F.col("routing_type").isin("research_institution", "company") & F.col("name_1_enriched").isNotNull()
        slots = F.filter(F.transform(F.array(*(F.struct(F.lit(k).alias("slot"), F.when(known & F.col(f"{c}_enriched").isNull(), F.col(c)).alias("unit")) for k, c in enumerate(DEPARTMENTS))), lambda s: s), lambda s: s["unit"].isNotNull())
        open_ = rows.select("row", "name_1_enriched", F.explode(slots).alias("s")).select("row", "name_1_enriched", "s.slot", "s.unit")
        admin = ex.is_accounts_payable(F.col("unit"))
        asked = self.sources.ask("unit", open_, two_part_key(F.col("name_1_enriched"), F.col("unit")), ~admin)
        good = F.col("answer.name").isNotNull() & ~tx.is_granular_unit(F.col("answer.name"))
        by_row = asked.withColumns({"_good": F.coalesce(good, F.lit(False)), "_ran": ~admin}).groupBy(F.col("row").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.when(F.col("_good"), F.col("answer.name")).otherwise(F.col("unit"))))).alias("_unit"), F.max("_ran").alias("_ran"), F.max("_good").alias("_made"))
        rows = rows.join(by_row, F.col("row") == F.col("_row"), "left")
        rows = rows.withColumns({f"{c}_enriched": F.coalesce(F.col("_unit")[F.lit(k)], F.col(f"{c}_enriched")) for k, c in enumerate(DEPARTMENTS)} | {"ran_unit": F.coalesce("_ran", F.lit(False)), "use_cases": F.when(F.col("_made"), _cases(5)).otherwise(F.col("use_cases"))})
        rows = _canonical_end(rows.drop("_row", "_unit", "_ran", "_made"), F.col("ran_unit") & _changed() & ~_reachable())
        return _put(rows, ~F.col("settled") & ~_reachable(), ran_unit=False)

    def contact(self, rows: DataFrame) -> DataFrame:
        """The contact's department at the institution, under its official name."""
        rows = self.sources.ask("contact", rows, two_part_key(F.col("name_1_enriched"), F.col("contact")), _reachable()).withColumnRenamed("answer", "found")
        good = F.col("found.status").isNotNull() & ~F.coalesce(tx.is_granular_unit(F.col("found.unit")), F.lit(False))
        rows = rows.withColumn("_good", good)
        rows = self.sources.ask("unit", rows, two_part_key(F.col("name_1_enriched"), F.col("found.unit")), F.col("_good"))
        official = F.when(F.col("answer.name").isNotNull() & ~tx.is_granular_unit(F.col("answer.name")), F.col("answer.name")).otherwise(F.col("found.unit"))
        rows = _put(rows, F.col("_good"), name_2_enriched=F.coalesce(tx.nullify(official), "name_2_enriched"), tier_used=2, source="contact_search", confidence=F.col("found.confidence"), enrichment_status=F.col("found.status"), use_cases=_cases(4), settled=True)
        rows = rows.drop("answer", "found", "_good")
        return _canonical_end(rows, ~F.col("settled") & F.col("ran_unit"))

    def last(self, rows: DataFrame) -> DataFrame:
        """Grounded answers, then plain suggestions; what neither changes stays as it came in."""
        key = F.when(_filled("name_1") | _filled("name_2"), F.concat_ws("|", tx.fold_key(F.col("name_1")), tx.fold_key(F.col("name_2")), F.upper(F.coalesce("country", F.lit("")))))
        rows = self.sources.ask("grounded", rows, key, F.lit(True)).withColumnRenamed("answer", "g")
        rows = rows.withColumn("_degraded", F.coalesce(F.col("g.degraded"), F.col("g").isNull()))
        rows = self.sources.ask("last", rows, key, F.col("_degraded")).withColumnRenamed("answer", "t")
        rank = lambda c: F.when(F.col(c).isin("ror", "lei"), 3).when(F.col(c) == "serp", 2).when(F.col(c) == "llm", 1).otherwise(0)
        n1, n2 = F.when(F.col("g.name_1").isNotNull(), rank("g.origin_1")).otherwise(0), F.when(F.col("g.name_2").isNotNull(), rank("g.origin_2")).otherwise(0)
        best = F.when(n1 >= n2, F.col("g.origin_1")).otherwise(F.col("g.origin_2"))
        rows = rows.withColumns({"_best": F.when(F.greatest(n1, n2) > 0, best), "_grounded": ~F.col("_degraded")})
        registry = F.col("_best").isin("ror", "lei")
        ids = {"ror_id": F.when((F.col("g.origin_1") == "ror") & F.col("g.name_1").isNotNull(), F.col("g.id_1")).otherwise(F.col("ror_id")), "lei_id": F.when((F.col("g.origin_1") == "lei") & F.col("g.name_1").isNotNull(), F.col("g.id_1")).otherwise(F.col("lei_id"))}
        rows = _put(rows, F.col("_grounded"), tier_used=3, name_1_enriched=F.coalesce("g.name_1", "name_1_enriched"), name_2_enriched=F.when(~F.coalesce(F.col("g.clear_2"), F.lit(False)), F.coalesce("g.name_2", "name_2_enriched")), **ids)
        rows = _put(rows, F.col("_grounded") & F.col("_best").isNotNull(), source=F.when(F.col("_best") == "ror", "ROR").when(F.col("_best") == "lei", "gleif").when(F.col("_best") == "serp", "SERP+LLM").otherwise("LLM"), confidence=F.when(registry, "high").otherwise(F.col("g.confidence")), enrichment_status=F.when(registry | (F.col("_best") == "serp"), "enriched").otherwise("unresolved"))
        rows = _put(rows, F.col("_grounded") & F.col("_best").isNull(), source="passthrough", confidence="low", enrichment_status="unresolved")
        rows = _put(rows, F.col("_degraded"), tier_used=3, source="LLM", confidence=F.coalesce("t.confidence", F.lit("low")), enrichment_status=F.coalesce("t.status", F.lit("unresolved")), **{f"{c}_enriched": F.coalesce(tx.nullify(F.col(f"t.{c}")), f"{c}_enriched") for c in NAMES})
        rows = rows.withColumn("name_1_enriched", F.coalesce("name_1_enriched", "name_1"))
        signal = _any_department() | _filled("contact")
        clear = {}
        for c in DEPARTMENTS:
            dropped = ~signal | (F.col(f"{c}_original").isNotNull() & ~_filled(c)) | F.coalesce(F.lower(F.trim(f"{c}_enriched")) == F.lower(F.trim("name_1_enriched")), F.lit(False))
            clear[f"{c}_enriched"] = F.when(~dropped, F.col(f"{c}_enriched"))
        return rows.withColumns(clear).withColumn("settled", F.lit(True)).drop("g", "t", "_degraded", "_best", "_grounded")

    def again(self, rows: DataFrame) -> DataFrame:
        """Records without an identifier, once more by the name that the ladder gave them."""
        changed = F.col("ror_id").isNull() & F.col("lei_id").isNull() & _filled("name_1") & _filled("name_1_enriched") & (tx.fold_key(F.col("name_1_enriched")) != tx.fold_key(F.col("name_1")))
        rows = rows.withColumn("_again", F.coalesce(changed, F.lit(False)))
        key = name_key(F.col("name_1_enriched"), F.col("country"))
        rows = self.sources.ask("ror", rows, key, F.col("_again")).withColumnRenamed("answer", "r")
        rows = rows.withColumn("_ror", F.col("r.id").isNotNull())
        rows = self.sources.ask("lei", rows, key, F.col("_again") & ~F.col("_ror") & ~tx.looks_like_research(F.col("name_1_enriched")))
        rows = rows.withColumn("_lei", F.col("answer.id").isNotNull())
        rows = _registered(rows.withColumn("_answer", F.col("answer")).drop("answer").withColumnRenamed("r", "answer"), F.col("_ror"), "ROR", _stated_or_official(F.col("name_1_enriched")), F.col("answer.id"), domain=F.coalesce(_site(F.col("answer.website")), "domain"), retried=F.lit("ROR"))
        rows = _registered(rows, F.col("_lei"), "gleif", F.col("_answer.name"), F.col("_answer.id"), confidence=F.coalesce("_answer.confidence", F.lit("high")), retried=F.lit("gleif"))
        return rows.drop("answer", "_answer", "_again", "_ror", "_lei")


def _type_of() -> Column:
    return F.when(F.col("answer.research"), "research_institution").otherwise("company")


def _stated_or_official(stated: Column) -> Column:
    """The registry's own variant that the record states, else its official name."""
    variant = F.get(F.filter("answer.variants", lambda v: tx.strip_legal_suffix(v) == tx.strip_legal_suffix(stated)), F.lit(0))
    return F.coalesce(variant, F.col("answer.name"))


def _reachable() -> Column:
    """A research institution with a site, and one contact."""
    return (F.col("routing_type") == "research_institution") & _filled("contact") & ~ex.has_multiple_contacts(F.col("contact")) & _filled("domain")


def _changed() -> Column:
    return F.greatest(*(F.col(f"{c}_enriched").isNotNull() & ~F.col(f"{c}_enriched").eqNullSafe(F.col(f"{c}_original")) for c in DEPARTMENTS))


def _canonical_end(rows: DataFrame, when: Column) -> DataFrame:
    """Records end with the official names of their departments, or with those they had."""
    rows = rows.withColumn("_made", _changed())
    return _put(rows, when, tier_used=2, source=F.when(F.col("_made"), "llm_canonical").otherwise("passthrough"), confidence=F.when(F.col("_made"), "high").otherwise("low"), enrichment_status=F.when(F.col("_made"), "enriched").otherwise("unresolved"), settled=True).drop("_made")


def enriched_batch(records: DataFrame, evidence: dict[str, DataFrame]) -> DataFrame:
    """The ladder's result for ``records``, with evidence tables as sources; a missing table never answers."""
    nothing = lambda schema: records.sparkSession.createDataFrame([], f"key string, {schema}")
    return Ladder({name: table_source(evidence.get(name, nothing(schema)), schema) for name, schema in ANSWERS.items()}).run(records)
