"""Search terms by example: heads, what is stepped over, acronyms, sites, desks."""

import pytest
from pyspark.sql import functions as F

from loomery.functions import search_terms as st
from loomery.operators import enrich

COLUMNS = "name_1 string, name_2 string, domain string, department_domain string, ror_acronym string, city string, region string, country string"
CASES = [
    (("Kellogg Battle Creek MI Plant", None, None, None, None, "Battle Creek", "MI", "US"), "KELLOGG", None),
    (("Kellogg North America", "Central Warehouse", None, None, None, None, None, None), "KELLOGG", None),
    (("Novartis Institute Biomedical", "Procurement Services", None, None, None, None, None, None), "NOVARTIS BIOMEDICAL", "ADMIN"),
    (("Procter & Gamble Company", "Office of Purchasing", None, None, None, None, None, None), "PROCTER & GAMBLE", "ADMIN"),
    (("Massachusetts Institute of Technology", "Department of Chemistry", "mit.edu", None, "MIT", None, None, None), "MIT", "CHEMISTRY"),
    (("Massachusetts Institute of Technology", "Chemistry Dept", "mit.edu", "chem.mit.edu", "XYZ", None, None, None), "MIT", "CHEMISTRY"),
    (("University of Oxford", "Centre for Brain Science (CBS)", "ox.ac.uk", None, None, None, None, None), "OX", "CBS"),
    (("Princeton University", None, "princeton.edu", "web.astro.princeton.edu", None, None, None, None), "PRINCETON", "ASTRO"),
    (("Johns Hopkins", "", "jhu.edu", "hopkinsmedicine.org", None, None, None, None), "JHU", "HOPKINSMEDICINE"),
    (("MIT", "Electrical Engineering and Computer Science", "mit.edu", "eecs.mit.edu", None, None, None, None), "MIT", "EECS"),
    (("Harvard", "Harvard Medical School", None, None, None, None, None, None), "HARVARD", "HARVARD MEDICAL"),
    (("Ohio", "University of Texas", None, None, None, None, None, None), "OHIO", None),
    ((None, None, None, None, "ABC", None, None, None), "ABC", None),
    ((" ", " ", "", "", "", "", "", ""), None, None),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_terms(terms, k):
    assert terms[k] == CASES[k][1:]


@pytest.fixture(scope="module")
def terms(spark):
    rows = [(n, *c[0]) for n, c in enumerate(CASES)]
    got = enrich.search_terms(spark.createDataFrame(rows, "n int, " + COLUMNS)).orderBy("n").collect()
    return [(r["search_term_1"], r["search_term_2"]) for r in got]


def test_pieces(spark):
    row = spark.range(1).select(
        st.without_ending(F.lit("cs.ox.ac.uk")).alias("a"), st.without_ending(F.lit("acme.de")).alias("b"), st.without_ending(F.lit("host")).alias("c"), st.name_handle(F.lit("& Acme, Inc. & Co. &")).alias("d"), st.unit_phrase(F.lit("Department of Physics Laboratory")).alias("e"),
        st.unit_phrase(F.lit("Department")).alias("f"), st.unit_words(F.lit("Group of Soil & Water Labs")).alias("g"), st.geo_words(F.lit("San Jose"), F.lit("CA"), F.lit(None), {"ca": "california"}).alias("h"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g) == ("cs.ox", "acme", "host", "Acme", "Physics", None, "Soil & Water")
    assert row.h == ["san", "jose", "ca", "california"]
