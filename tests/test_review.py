"""Review flags and provenance scalars: late codes, retraction, desks, logs with transforms and rejections."""

import json

from pyspark.sql import functions as F

from loomery.operators import provenance, provenance_log, review

SF = "/root/testdata/sf0.01"


def test_all_codes_are_raised_on_the_table(spark):
    from loomery.plans.review import flag_evidence

    codes = review.with_scopes(flag_evidence(spark, SF)).select(F.explode(F.map_keys("flag_scopes"))).distinct()
    assert {r[0] for r in codes.collect()} == set(provenance.FLAGS)


def test_late_codes_and_retraction_render_in_order(spark):
    df = spark.createDataFrame([("12345678", True)], "name1_enriched string, dept_via_lab boolean")
    df = review.with_scopes(df)
    more = review.raised(review.raised(F.col("flag_scopes"), "overflow", F.array(F.lit("name3"))), "overflow", F.array(F.lit("name1"), F.lit("name3")))
    less = provenance.retract(provenance.retract(more, "opaque-code", "name1"), "dept-via-lab", "name3")
    r = df.select(*(c.alias(n) for n, c in review.rendered(less, F.col("flag_details"), F.col("flag_notes"), F.col("flag_low_confidence")).items())).first()
    assert r["flag_codes"] == ["overflow", "dept-via-lab"] and r["flagged_fields"] == ["name1", "name2", "name3"] and r["flag_for_review"]
    assert r["flag_reason"].startswith("Name 1 and Name 3: one value appears") and "; Name 2: parent department" in r["flag_reason"]


def test_nothing_and_no_match(spark):
    rows = [("unresolved", None, None), ("enriched", None, None), (None, "x.org", None), (None, None, ["name2"]), ("", "", None)]
    got = review.with_flags(spark.createDataFrame(rows, "enrichment_status string, domain string, changed_fields array<string>")).collect()
    assert [r["flag_codes"] for r in got] == [["no-match"], [], [], [], ["no-match"]]
    assert got[1]["flag_reason"] is None and not got[1]["flag_for_review"] and got[0]["flag_reason"] == "Name 1: " + review.REASONS["no-match"]
    only = review.with_flags(spark.createDataFrame([("x.org", "seen in Rome")], "domain_unverified string, domain_page_note string")).first()
    assert not only["flag_for_review"] and only["flag_reason"].endswith("confirm it — seen in Rome")  # advisory


def test_desks(spark):
    yes = ["Accounts Payable", "accts. payable", "A/P", "Office of Purchasing", "Central Procurement Services", "Corporate Finance", "Billing Services Department", "Business Office", "Shipping & Receiving", "Mailroom", "Invoice Processing Team"]
    no = ["Department of Chemistry", "Dept. of Administration", "Business", "Business Administration", "School of Finance Law", "", None, "Group", "Mail Order Laboratory"]
    got = spark.createDataFrame([(x,) for x in [*yes, *no]], "c string").select("c", review.is_admin_desk(F.col("c")).alias("d")).collect()
    assert {r["c"] for r in got if r["d"]} == set(yes)


def event(seq, field, producer, kind="write", scale="rule", rule=None, value="V", **ref):
    return {"seq": seq, "field": field, "kind": kind, "new_value": value, "producer_chain": ["serp", producer] if producer else [], "confidence_scale": scale, "rule_id": rule, "evidence_ref": ref}


def test_scalars_of_a_log(spark):
    events = [
        event(3, "name1_enriched", "pipeline", "transform"), event(2, "name1_enriched", "ror"), event(1, "name1_enriched", "llm_tier3"), event(5, "domain", "website_resolver", value=" X.Org ", verified_by="email"), event(4, "domain", "website_resolver", rule="domain-ownership:unverified"),
        event(6, "name2_enriched", "llm_grounded"), event(7, "record_type", "casing", "transform"), event(8, "ror_id", None, scale="inherited"), event(9, "lei_id", "gleif"), event(10, "lei_id", "pipeline", "revert"),
    ]
    rejections = [{"seq": k, "field": "domain", "candidate": f"c{k}", "guard": "g"} for k in (5, 1, 3, 2)]
    logs = [json.dumps({"events": events, "rejections": rejections}), "{broken", None, "{}"]
    got = provenance_log.with_provenance(spark.createDataFrame([(k, x) for k, x in enumerate(logs)], "k int, log string"), "log").orderBy("k").collect()
    r = got[0]
    assert (r["name1_provenance"], r["name2_provenance"], r["domain_provenance"]) == ("ror:verified", "llm:provisional", "web:x.org:verified+domain")
    assert (r["record_type_provenance"], r["ror_id_provenance"], r["lei_id_provenance"]) == (None, "ror:provisional", "input:low")  # transforms decide nothing, a revert does
    assert r["weak_fields"] == ["name2"] and r["registry_fields"] == ["name1"]
    assert [(x["field"], x["candidates"], x["omitted"]) for x in r["rejections"]] == [("domain", ["c1", "c2", "c3"], 1)]
    for r in got[1:]:
        assert r["name1_provenance"] is None and r["weak_fields"] == [] and r["rejections"] == []


def test_scalars_are_valid(spark):
    from loomery.plans.review import provenance_scalars

    rows = provenance_scalars(spark, SF)
    for name in provenance_log.SCOPED_FIELDS.values():
        c = F.col(f"{name}_provenance")
        assert rows.filter(c.isNotNull() & ~provenance.is_valid(c)).count() == 0
