"""The tier ladder over customers as records, with evidence made from the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.operators import ladder
from loomery.sources.evidence import registry_key
from loomery.sources.scratch import staged

KINDS = ["Acme Works", "North University", "South University", "Lei Trading", "Cross Holding", "Same Goods", "Propr Goods", "Typo Indstries", "Nothing Known", "West Institute", "Lab University"]


def ladder_records(spark, sf_dir) -> DataFrame:
    """Customers as records of twelve kinds; four share a name."""
    k = F.col("c_custkey")
    n = F.floor(k / 48).cast("string")
    kind = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, KINDS)), (k % 12 + 1).cast("int"))
    unit = F.element_at(F.array(*(F.lit(x).cast("string") for x in (None, None, "Department of Chemistry", "Accounts Payable", "Polymer Laboratory", "Chem Dept", "Main Hall"))), (k % 7 + 1).cast("int"))
    turn = F.floor(k / 12) % 4
    person = F.when(k % 12 == 0, F.concat(F.lit("Person "), n)).otherwise(F.concat(F.lit("Jane Roe "), n))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").select(
        k.alias("row"), k.cast("string").alias("record_id"), F.concat(kind, F.lit(" "), n).alias("name_1"), unit.alias("name_2"), F.when(k % 10 == 0, "Division of Biology").alias("name_3"),
        F.when(turn == 2, "Jane Roe / John Doe").when(turn > 0, person).alias("contact"), F.when(F.floor(k / 48) % 2 == 0, "DE").otherwise("US").alias("country"), F.floor(k / 48).alias("n"))


def _answers(numbers: DataFrame, source: str, entries: list[tuple]) -> DataFrame:
    """A table of answers for every number: entries of (key, condition, values by name)."""
    fields = [f.split() for f in ladder.ANSWERS[source].split(", ")]
    made = [F.struct(when.alias("_when"), key.alias("key"), *(F.lit(values[f]).cast(t).alias(f) if f in values else F.lit(None).cast(t).alias(f) for f, t in fields)) for key, when, values in entries]
    return numbers.select(F.explode(F.array(*made)).alias("e")).select("e.*").filter("_when").drop("_when")


def ladder_evidence(records: DataFrame) -> dict[str, DataFrame]:
    """Answers for the numbers that occur in the records."""
    numbers = staged(records.select("n", "country").distinct(), "numbers")
    n, s, always = F.col("n"), F.col("n").cast("string"), F.lit(True)
    named = lambda x, end="": F.concat(F.lit(f"{x} "), s, F.lit(end))
    key = lambda x: registry_key(named(x), F.col("country"))
    site = lambda x, end: F.concat(F.lit(f"https://www.{x}-"), s, F.lit(f".example.{end}/x"))
    id_ = lambda x: F.concat(F.lit(f"{x}-"), s)
    kids = F.array(F.lit("Chemistry Department"), F.lit("Institute of Biology"))
    houses = [named(x) for x in ("Same Goods", "Proper Goods", "South University", "Southern University", "West Institute", "Lab University", "North University")] + [named("Acme Works", " GmbH"), named("Acme Works", " Aktiengesellschaft")]
    research = [named(x) for x in ("University of the North", "North University", "Southern University", "West Institute", "Lab University")]
    pointer = F.when(n % 2 == 1, "lei").otherwise("ror")
    entries = {
        "ror": [
            (key("Acme Works"), always, {"name": named("Acme Works", " GmbH"), "id": id_("ror-acme"), "research": False, "website": site("acme", "com")}),
            (key("North University"), always, {"name": named("University of the North"), "id": id_("ror-north"), "research": True, "website": site("north", "edu"), "variants": F.when(n % 2 == 0, F.array(named("North University"))), "children": kids}),
            (key("West Institute"), always, {"name": named("West Institute"), "id": id_("ror-west"), "research": True, "website": site("west", "org")}),
            (key("Lab University"), always, {"name": named("Lab University"), "id": id_("ror-lab"), "research": True, "website": F.when(n % 2 == 1, site("lab", "edu"))}),
            (key("Home Institute"), n % 4 < 2, {"name": named("Home Institute"), "id": id_("ror-home"), "research": True, "website": site("home", "org")}),
            (key("Proper Goods"), n % 2 == 1, {"name": named("Proper Goods", " Company"), "id": id_("ror-proper"), "research": False}),
        ],
        "lei": [
            (key("Lei Trading"), always, {"name": named("Lei Trading", " Ltd"), "id": id_("lei-trade"), "confidence": F.when(n % 2 == 1, "medium")}),
            (key("Acme Works"), n % 3 == 0, {"name": named("Acme Works", " Aktiengesellschaft"), "id": id_("lei-acme")}),
            (key("Typo Industries"), n % 2 == 0, {"name": named("Typo Industries", " Inc"), "id": id_("lei-typo")}),
            (key("Proper Goods"), n % 4 == 0, {"name": named("Proper Goods", " Ltd"), "id": id_("lei-proper")}),
        ],
        "crosswalk": [
            (key("South University"), n % 2 == 0, {"registry": "ror", "id": id_("ror-x"), "name": named("Southern University"), "website": site("south", "edu")}),
            (key("Cross Holding"), n % 5 < 4, {"registry": pointer, "id": F.concat(pointer, F.lit("-x-"), s), "name": named("Cross Holding", " SE")}),
        ],
        "proposal": [
            (key("Same Goods"), always, {"name": named("SAME goods"), "accepted": True}), (key("Propr Goods"), n % 5 < 4, {"name": named("Proper Goods"), "accepted": True}), (key("Typo Indstries"), always, {"name": named("Typo Industries"), "accepted": False}),
        ],
        "affiliation": [(key("Person"), always, {"institution": named("Home Institute"), "department": "Physics", "confidence": F.when(n % 3 == 0, "high").when(n % 3 == 1, "medium").otherwise("low")})],
        "parent": [(ladder.two_part_key(named("Lab University"), F.lit("Polymer Laboratory")), n % 3 > 0, {"name": "Department of Materials", "confidence": "medium"})],
        "unit": [(ladder.two_part_key(h, F.lit(a)), n % 2 == 0, {"name": b}) for h in houses for a, b in (("Chem Dept", "Department of Chemistry"), ("Main Hall", "Main Laboratory"), ("Division of Biology", "Division of Biological Sciences"))],
        "contact": [(ladder.two_part_key(h, named("Jane Roe")), n % 3 > 0, {"unit": F.when(n % 3 == 1, "Department of Physics").otherwise("Physics Group"), "confidence": "high", "status": "enriched"}) for h in research],
    }
    asked = records.filter("name_1 like 'Nothing Known %'").select(F.concat_ws("|", tx.fold_key(F.col("name_1")), tx.fold_key(F.col("name_2")), "country").alias("key"), "n").distinct()
    quarter = n % 4
    grounded = asked.select("key", F.when(quarter == 0, named("Nothing Known", " Ltd")).when(quarter == 1, named("Known")).alias("name_1"), F.when(quarter == 0, "serp").when(quarter == 1, "ror").alias("origin_1"), F.when(quarter == 1, id_("ror-g")).alias("id_1"), F.when(quarter == 1, named("Office")).alias("name_2"), F.when(quarter == 1, "llm").alias("origin_2"), F.lit("medium").alias("confidence"), (quarter == 3).alias("clear_2"), (quarter == 2).alias("degraded"))
    last = asked.filter(quarter == 2).select("key", named("Suggested").alias("name_1"), F.lit("Suggested Unit").alias("name_2"), F.lit("medium").alias("confidence"), F.lit("enriched").alias("status"))
    return {name: _answers(numbers, name, some) for name, some in entries.items()} | {"grounded": grounded, "last": last}


def enriched_batch(spark, sf_dir) -> DataFrame:
    """What the ladder makes of every record, and the rung that settled it."""
    records = ladder_records(spark, sf_dir)
    out = ladder.enriched_batch(records, ladder_evidence(records))
    return out.select("record_id", *ladder.ENRICHED, "ror_id", "lei_id", "domain", "tier_used", "source", "confidence", "routing_type", "enrichment_status", F.array_join(F.transform("use_cases", lambda x: x.cast("string")), ",").alias("use_cases"), F.array_join("flags", ",").alias("flags"), "retried", "rung")


QUERIES = {"enriched_batch": enriched_batch}

#: The outcome by kind of record (c), number (n), turn of the contact (j) and unit (m), rung by rung.
ORACLE_SQL = {
    "enriched_batch": """
WITH r AS (
  SELECT c_custkey k, c_custkey % 12 c, c_custkey // 48 n, c_custkey // 12 % 4 j, c_custkey % 7 m,
    ([NULL, 'Acme Works', 'North University', 'South University', 'Lei Trading', 'Cross Holding', 'Same Goods', 'Propr Goods', 'Typo Indstries', 'Nothing Known', 'West Institute', 'Lab University'])[(c_custkey % 12 + 1)::INT] || ' ' || (c_custkey // 48) name_1,
    ([NULL, NULL, 'Department of Chemistry', 'Accounts Payable', 'Polymer Laboratory', 'Chem Dept', 'Main Hall'])[(c_custkey % 7 + 1)::INT] name_2,
    CASE WHEN c_custkey % 10 = 0 THEN 'Division of Biology' END name_3
  FROM customer),
a AS (
  SELECT *, m > 1 h2, j > 0 hc,
    CASE WHEN c = 3 THEN n % 2 = 0 WHEN c = 5 THEN n % 5 < 4 END crossed, c = 4 OR (c = 1 AND n % 3 = 0) OR (c = 8 AND n % 2 = 0) legal, c = 7 AND n % 5 < 4 renamed
  FROM r),
t AS (
  SELECT *,
    CASE WHEN c = 1 THEN name_1 || CASE WHEN legal THEN ' Aktiengesellschaft' ELSE ' GmbH' END WHEN c = 2 THEN CASE WHEN n % 2 = 0 THEN name_1 ELSE 'University of the North ' || n END
      WHEN c = 3 AND crossed THEN 'Southern University ' || n WHEN c = 4 THEN name_1 || ' Ltd' WHEN c = 5 AND crossed THEN name_1 || ' SE' WHEN renamed THEN 'Proper Goods ' || n
      WHEN c = 8 AND legal THEN 'Typo Industries ' || n || ' Inc' ELSE name_1 END e1,
    CASE WHEN c IN (1, 2, 10, 11) THEN 'ror-' || (CASE c WHEN 1 THEN 'acme' WHEN 2 THEN 'north' WHEN 10 THEN 'west' ELSE 'lab' END) || '-' || n WHEN (c = 3 AND crossed) OR (c = 5 AND crossed AND n % 2 = 0) THEN 'ror-x-' || n END ror_id,
    CASE WHEN legal THEN 'lei-' || (CASE c WHEN 1 THEN 'acme' WHEN 4 THEN 'trade' ELSE 'typo' END) || '-' || n WHEN c = 5 AND crossed AND n % 2 = 1 THEN 'lei-x-' || n END lei_id,
    CASE WHEN c = 1 THEN 'acme-' || n || '.example.com' WHEN c = 2 THEN 'north-' || n || '.example.edu' WHEN c = 3 AND crossed THEN 'south-' || n || '.example.edu' WHEN c = 10 THEN 'west-' || n || '.example.org' WHEN c = 11 AND n % 2 = 1 THEN 'lab-' || n || '.example.edu' END "domain",
    CASE WHEN c = 0 THEN NULL WHEN renamed THEN 2 ELSE 1 END tier,
    CASE WHEN c = 0 THEN NULL WHEN legal OR (c = 5 AND crossed AND n % 2 = 1) THEN 'gleif' WHEN c IN (1, 2, 10, 11) OR crossed THEN 'ROR' WHEN renamed THEN 'llm_canonical' ELSE 'passthrough' END src,
    CASE WHEN c IN (2, 3, 10, 11) THEN 'research_institution' WHEN c IN (1, 6) OR renamed THEN 'company' ELSE 'unknown' END rt
  FROM a),
u AS (
  SELECT *, CASE WHEN c = 0 THEN NULL WHEN src = 'passthrough' THEN 'low' WHEN c = 4 AND n % 2 = 1 THEN 'medium' ELSE 'high' END conf,
    CASE WHEN src IN ('ROR', 'gleif', 'llm_canonical') THEN 'enriched' WHEN c IN (3, 6) THEN 'unresolved' END st, CASE WHEN src IN ('ROR', 'gleif', 'llm_canonical') THEN [2, 3] ELSE []::INT[] END uc,
    CASE WHEN c = 0 AND hc THEN 'affiliation' WHEN c IN (2, 10, 11) AND NOT h2 AND NOT hc THEN 'registry' WHEN (c = 1 AND NOT h2 AND NOT hc) OR (c = 4 AND NOT h2) THEN 'legal'
      WHEN (c = 3 AND NOT h2 AND NOT hc) OR (c = 5 AND crossed AND NOT h2) THEN 'crosswalk' WHEN (c = 6 OR renamed OR (c = 8 AND legal)) AND NOT h2 THEN 'proposal' WHEN m = 3 THEN 'desk' END rung
  FROM t),
child AS (SELECT *, CASE WHEN c = 2 AND m IN (2, 5) AND rung IS DISTINCT FROM 'registry' THEN 'Chemistry Department' END c2, CASE WHEN c = 2 AND name_3 IS NOT NULL AND rung IS DISTINCT FROM 'registry' THEN 'Institute of Biology' END c3 FROM u),
lab AS (SELECT *, rung IS NULL AND rt = 'research_institution' AND m = 4 lab, rt = 'research_institution' AND j IN (1, 3) AND "domain" IS NOT NULL reach FROM child),
unit AS (
  SELECT *, lab AND c = 11 AND n % 3 > 0 parent, rt <> 'unknown' AND rung IS NULL AND NOT (lab AND c = 11 AND n % 3 > 0) AND ((name_2 IS NOT NULL AND c2 IS NULL) OR (name_3 IS NOT NULL AND c3 IS NULL)) ran,
    CASE WHEN n % 2 = 0 AND m = 5 THEN 'Department of Chemistry' ELSE name_2 END o2, CASE WHEN n % 2 = 0 AND name_3 IS NOT NULL THEN 'Division of Biological Sciences' ELSE name_3 END o3
  FROM lab),
made AS (
  SELECT *, CASE WHEN ran THEN coalesce(c2, o2) ELSE c2 END d2, CASE WHEN ran THEN coalesce(c3, o3) ELSE c3 END d3,
    ran AND ((c2 IS NULL AND o2 IS DISTINCT FROM name_2) OR (c3 IS NULL AND o3 IS DISTINCT FROM name_3)) good FROM unit),
ended AS (
  SELECT *, coalesce(d2 IS NOT NULL AND d2 IS DISTINCT FROM name_2, false) OR coalesce(d3 IS NOT NULL AND d3 IS DISTINCT FROM name_3, false) changed,
    CASE WHEN rung IS NOT NULL THEN rung WHEN parent THEN 'parent'
      WHEN ran AND NOT reach AND ((d2 IS NOT NULL AND d2 IS DISTINCT FROM name_2) OR (d3 IS NOT NULL AND d3 IS DISTINCT FROM name_3)) THEN 'units'
      WHEN reach AND (n % 3 = 1 OR ran) THEN 'contact' ELSE 'last' END stop FROM made),
g AS (SELECT *, stop = 'contact' AND n % 3 = 1 found, stop = 'affiliation' AND j <> 2 AND n % 3 < 2 AND n % 4 < 2 home, stop = 'last' AND c = 9 grounded, stop IN ('units') OR (stop = 'contact' AND NOT n % 3 = 1) canon FROM ended),
f AS (
  SELECT k, c, n, j, stop, name_1,
    CASE WHEN home THEN 'Home Institute ' || n WHEN stop = 'affiliation' THEN NULL WHEN grounded AND n % 4 = 0 THEN name_1 || ' Ltd' WHEN grounded AND n % 4 = 1 THEN 'Known ' || n WHEN grounded AND n % 4 = 2 THEN 'Suggested ' || n WHEN c = 0 AND stop = 'desk' THEN NULL ELSE e1 END e1,
    CASE WHEN home THEN CASE WHEN NOT h2 THEN 'Physics' END WHEN stop = 'affiliation' THEN NULL WHEN stop = 'desk' THEN name_2 WHEN parent THEN 'Department of Materials' WHEN found THEN 'Department of Physics'
      WHEN grounded AND (h2 OR hc OR name_3 IS NOT NULL) THEN CASE n % 4 WHEN 1 THEN 'Office ' || n WHEN 2 THEN 'Suggested Unit' END WHEN grounded THEN NULL ELSE d2 END e2,
    CASE WHEN stop = 'desk' THEN coalesce(name_3, d3) WHEN parent AND name_3 IS NULL THEN 'Polymer Laboratory' ELSE d3 END e3, CASE WHEN parent AND name_3 IS NOT NULL THEN 'Polymer Laboratory' END e4,
    CASE WHEN home THEN 'ror-home-' || n WHEN grounded AND n % 4 = 1 THEN 'ror-g-' || n ELSE ror_id END ror_id, lei_id, CASE WHEN home THEN 'home-' || n || '.example.org' ELSE "domain" END "domain",
    CASE WHEN home THEN 1 WHEN stop IN ('desk', 'parent') OR canon OR found THEN 2 WHEN stop = 'last' THEN 3 ELSE tier END tier,
    CASE WHEN home THEN 'ROR' WHEN stop = 'desk' THEN 'pattern_match' WHEN parent THEN 'dept_search' WHEN found THEN 'contact_search' WHEN canon THEN CASE WHEN changed THEN 'llm_canonical' ELSE 'passthrough' END
      WHEN grounded AND n % 4 = 0 THEN 'SERP+LLM' WHEN grounded AND n % 4 = 1 THEN 'ROR' WHEN grounded AND n % 4 = 3 THEN 'passthrough' WHEN stop = 'last' THEN 'LLM' ELSE src END src,
    CASE WHEN home OR parent THEN 'medium' WHEN stop = 'desk' OR found THEN 'high' WHEN canon THEN CASE WHEN changed THEN 'high' ELSE 'low' END
      WHEN grounded AND n % 4 IN (0, 2) THEN 'medium' WHEN grounded AND n % 4 = 1 THEN 'high' WHEN stop = 'last' THEN 'low' ELSE conf END conf,
    CASE WHEN home THEN 'research_institution' ELSE rt END rt,
    CASE WHEN home OR stop IN ('desk', 'parent') OR found THEN 'enriched' WHEN stop = 'affiliation' THEN 'unresolved' WHEN canon THEN CASE WHEN changed THEN 'enriched' ELSE 'unresolved' END
      WHEN grounded AND n % 4 < 3 THEN 'enriched' WHEN stop = 'last' THEN 'unresolved' ELSE st END st,
    list_concat(uc, list_concat(CASE WHEN stop = 'desk' THEN [6] ELSE []::INT[] END, list_concat(CASE WHEN lab THEN [13] ELSE []::INT[] END, list_concat(CASE WHEN good THEN [5] ELSE []::INT[] END, CASE WHEN found THEN [4] ELSE []::INT[] END)))) uc,
    CASE WHEN parent THEN 'dept-via-lab' WHEN stop = 'affiliation' AND NOT home THEN 'person-unresolved' ELSE '' END flags,
    CASE WHEN renamed AND n % 2 = 1 THEN 'ROR' WHEN renamed AND n % 4 = 0 THEN 'gleif' END retried
  FROM g)
SELECT k::VARCHAR record_id, CASE retried WHEN 'ROR' THEN e1 || ' Company' WHEN 'gleif' THEN e1 || ' Ltd' ELSE e1 END name_1_enriched, e2 name_2_enriched, e3 name_3_enriched, e4 name_4_enriched, NULL::VARCHAR name_5_enriched,
  CASE WHEN retried = 'ROR' THEN 'ror-proper-' || n ELSE ror_id END ror_id, CASE WHEN retried = 'gleif' THEN 'lei-proper-' || n ELSE lei_id END lei_id, "domain",
  (CASE WHEN retried IS NOT NULL THEN 1 ELSE tier END)::INT tier_used, coalesce(retried, src) source, CASE WHEN retried IS NOT NULL THEN 'high' ELSE conf END confidence, rt routing_type, CASE WHEN retried IS NOT NULL THEN 'enriched' ELSE st END enrichment_status,
  array_to_string(uc, ',') use_cases, flags, retried, stop rung
FROM f""",
}
