"""Ties between equally frequent spellings: closeness to the supplied names, then tier, then order."""

from loomery.functions import text as tx
from loomery.functions.similarity import token_sort_of
from loomery.operators import consensus

SCHEMA = "_seq int, country string, postal_code string, street_cleaned string, house_number string, name1_enriched string, name1_original string, ror_id string, lei_id string, domain string, website_url string, record_type string, tier_used int"


def run(spark, rows, originals=True):
    """Rows of (street, enriched, original, tier); the spelling that each ends with."""
    df = spark.createDataFrame([(k, "DE", "12345", street, "1", name, original, None, None, None, None, "unknown", tier) for k, (street, name, original, tier) in enumerate(rows)], SCHEMA)
    df = df if originals else df.drop("name1_original")
    return [r["name1_enriched"] for r in consensus.apply_consensus(df, tx.fold_key).orderBy("_seq").collect()]


def test_a_tie_goes_to_the_supplied_spelling(spark):
    rows = [("A", "Coastal Diagnostics Inc.", "COASTAL DIAGNOSTIC", 2), ("A", "Coastal Diagnostics, Inc", "Coastal Diagnostics, Inc", 2), ("A", "Coastal Diagnostics INC", "Coastal Diagnostics, Inc", 2), ("B", "Beta Inc", None, 3), ("B", "beta inc", None, 1), ("B", "BETA Inc", " ", 2)]
    got = run(spark, rows)
    assert got[:3] == ["Coastal Diagnostics, Inc"] * 3
    assert got[3:] == ["beta inc"] * 3  # nothing supplied: the lowest tier
    assert run(spark, rows, originals=False)[:3] == ["Coastal Diagnostics Inc."] * 3


def test_the_majority_comes_before_closeness(spark):
    rows = [("A", "Acme Inc.", "acme", 2), ("A", "Acme Inc.", "acme", 2), ("A", "Acme, INC", "Acme, INC", 1)]
    assert run(spark, rows) == ["Acme Inc."] * 3


def test_tiers_and_order_are_those_of_a_spelling_as_a_whole(spark):
    rows = [("A", "Acme Inc.", None, 2), ("A", "Acme, Inc", None, 1), ("A", "Acme, Inc", None, 3), ("A", "Acme Inc.", None, 1)]
    assert run(spark, rows) == ["Acme Inc."] * 4  # tier 1 both, first row 0


def test_affinity_is_the_sum_over_all_supplied_names(spark):
    forms, supplied = ["Gamma Works Ltd", "GAMMA works, Ltd."], ["Gamma Work", "gamma works ltd", "Gama Works Ltd."]
    rows = [("A", forms[k % 2], supplied[k % 3], 2) for k in range(6)]
    sums = [round(sum(token_sort_of(f.lower(), s.lower()) * 2 for s in supplied)) for f in forms]
    want = min(range(2), key=lambda k: (-sums[k], k))
    assert run(spark, rows) == [forms[want]] * 6
