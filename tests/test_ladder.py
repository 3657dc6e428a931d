"""The tier ladder: every rung is met, no key is asked twice, and odd rows have defined ends."""

from collections import Counter

from loomery.operators import ladder
from loomery.plans.ladder import ladder_evidence, ladder_records

SF = "/root/testdata/sf0.01"
RUNGS = {"affiliation", "registry", "legal", "crosswalk", "proposal", "desk", "parent", "units", "contact", "last"}


def recording(source, asked):
    def ask(wanted):
        asked.extend(r["key"] for r in wanted.collect())
        return source(wanted)

    return ask


def test_every_rung_settles_records_and_no_key_is_asked_twice(spark):
    records = ladder_records(spark, SF)
    evidence, asked = ladder_evidence(records), {}
    sources = {name: recording(ladder.table_source(evidence[name], schema), asked.setdefault(name, [])) for name, schema in ladder.ANSWERS.items()}
    got = ladder.Ladder(sources).run(records).select("row", "rung", "retried").collect()
    assert sorted(r["row"] for r in got) == sorted(r["row"] for r in records.collect())
    assert {r["rung"] for r in got} == RUNGS
    assert {r["retried"] for r in got} == {None, "ROR", "gleif"}
    for name, keys in asked.items():
        assert keys and max(Counter(keys).values()) == 1, name
    names = {(r["name_1"], r["country"]) for r in records.collect() if r["name_1"]}
    assert len(names) <= len(asked["ror"]) < len(got)  # by distinct names, and those that the ladder found


SCHEMA = "record_id string, name_1 string, name_2 string, name_3 string, contact string, country string, rung string, answer string"


def run(spark, rows, **evidence):
    records = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    tables = {name: spark.createDataFrame(rows, f"key string, {ladder.ANSWERS[name]}") for name, rows in evidence.items()}
    return {(r["record_id"], r["name_1"]): r for r in ladder.enriched_batch(records, tables).collect()}


def test_odd_rows(spark):
    rows = [
        ("a", None, None, None, None, None), ("a", "", " ", None, "", "DE"), ("b", "Acme GmbH", None, None, None, "DE"), ("b", "acme  gmbh", None, None, None, "de"), ("c", None, None, None, "Jane Roe", None),
        ("d", "Bayr Werke", None, None, None, "DE"), ("e", "Iso Group", None, None, None, "DE"), ("f", "Unknown " * 3000, "Accounts Payable", "Unit", None, None),
    ]
    got = run(
        spark, rows,
        lei=[("acme gmbh|DE", "Acme GmbH & Co", "L1", None), ("acme gmbh|DE", "Acme Z", "L2", None), ("bayer werke|DE", "Bayer Werke AG", "L3", "medium"), ("costar group|DE", "CoStar Group", "L4", None)],
        proposal=[("bayr werke|DE", "Bayer Werke", False), ("iso group|DE", "CoStar Group", False)],
    )
    assert len(got) == 7  # the two rows without a name share their record_id
    both = got["b", "Acme GmbH"], got["b", "acme gmbh"]
    assert [(r["lei_id"], r["name_1_enriched"], r["rung"]) for r in both] == [("L1", "Acme GmbH & Co", "legal")] * 2  # the least of several answers
    assert got["c", None]["flags"] == ["person-unresolved"] and got["c", None]["rung"] == "affiliation"
    mended, swapped = got["d", "Bayr Werke"], got["e", "Iso Group"]
    assert (mended["lei_id"], mended["confidence"]) == ("L3", "medium")  # a typo, confirmed by the registry
    assert (swapped["lei_id"], swapped["name_1_enriched"], swapped["rung"]) == (None, "Iso Group", "last")  # another organisation
    desk = next(r for r in got.values() if r["record_id"] == "f")
    assert (desk["rung"], desk["name_3_enriched"], desk["use_cases"]) == ("desk", "Unit", [6])
    assert got["a", None]["rung"] == "last" and got["a", None]["name_1_enriched"] is None


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_spelling_variants():
    same = ladder.spelling_variant_of
    assert same("Bayr AG", "Bayer AG") and same("Typo Indstries", "Typo Industries Institute")
    assert not same("Bayer", "Bayer") and not same("Iso Group", "CoStar Group") and not same("Bayr", "Bayer Leverkusen") and not same("", "x") and not same("abc", "abd")
