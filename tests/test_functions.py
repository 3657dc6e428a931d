import pytest
from pyspark.sql import functions as F

from loomery.functions import extract as ex
from loomery.functions import similarity as sim
from loomery.functions import text as tx
from loomery.functions import urls


def one(spark, *columns):
    return spark.range(1).select(*columns).first()[0]


@pytest.mark.parametrize("a,b,want", [("MARTHA", "MARHTA", 0.961111), ("", "x", 0.0), ("same", "same", 1.0), ("DIXON", "DICKSONX", 0.813333)])
def test_jaro_winkler(a, b, want):
    assert sim.jaro_winkler_of(a, b) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("a,b,want", [("", "", 100.0), ("abc", "abc", 100.0), ("abc", "abd", 66.666667), ("kitten", "sitting", 61.538462)])
def test_ratio(a, b, want):
    assert sim.ratio_of(a, b) == pytest.approx(want, abs=1e-6)


def test_lcs_against_table():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for a, b in [("abcbdab", "bdcaba"), ("aaa", "aa"), ("", "x"), ("xyz", "abc"), ("hello world", "world hello")]:
        assert sim.lcs(a, b) == slow(a, b)


@pytest.mark.parametrize("value,want", [("Chemistry Department", "Department of Chemistry"), ("Dept of Physics", "Department of Physics"), ("Cancer Research Center", "Center for Cancer Research"), ("Sales", "Sales"), ("", ""), (None, None), ("Neuro Dept", "Neuro Dept")])
def test_canonical_unit(spark, value, want):
    assert one(spark, tx.canonicalise_unit(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize("value,want", [("Muster GmbH & Co. KG", "muster"), ("AG Berlin Services", "ag berlin services"), ("GmbH", "gmbh"), ("Acme A/S", "acme"), (None, "")])
def test_legal_suffix(spark, value, want):
    assert one(spark, tx.strip_legal_suffix(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize("value,want", [("3M (Detroit)", "3M"), ("Bayer (Leverkusen Werk", "Bayer"), ("(Research Division)", "Research Division"), ("A (B (C) D) E", "A E"), ("Acme, (US), Ltd", "Acme, Ltd"), ("plain", "plain")])
def test_parentheticals(spark, value, want):
    assert one(spark, tx.strip_parentheticals(F.lit(value))) == want


def test_wrapping_keeps_all_words(spark):
    text = "word " * 20 + "x" * 70
    lines = one(spark, tx.wrap_words(F.lit(text)))
    assert all(len(x) <= 32 for x in lines) and "".join(lines).replace(" ", "") == text.replace(" ", "")


def test_granular_units(spark):
    check = lambda v: one(spark, tx.is_granular_unit(F.lit(v)))
    assert check("NMR Lab") and check("Center for X") and not check("Department of Laboratory Medicine") and not check("Physics")


@pytest.mark.parametrize("url,want", [("https://web.mit.edu/path", "mit.edu"), ("https://www.example.co.uk/page", "example.co.uk"), ("example.org", "example.org"), ("http://u@h.x.de:80/", "x.de"), ("", None), (None, None)])
def test_domain(spark, url, want):
    assert one(spark, urls.domain(F.lit(url).cast("string"))) == want


def test_sublocations(spark):
    r = spark.range(1).select(ex.sublocations(F.lit("2200 LAKE BLVD STE 300 BLDG 4 RM 412A")).alias("s")).first().s
    assert (r.suite, r.building, r.room, r.rest, r.bare) == ("300", "4", "412A", "2200 LAKE BLVD", False)


def test_po_box_and_care_of(spark):
    r = spark.range(1).select(ex.po_box(F.lit("12 Main St, PO Box 44")).alias("p"), ex.care_of(F.lit("Main Hall c/o Jane Roe")).alias("c")).first()
    assert (r.p.value, r.p.rest) == ("PO Box 44", "12 Main St") and (r.c.value, r.c.rest) == ("Jane Roe", "Main Hall")


@pytest.mark.parametrize("value,want", [("McLaren Corp/Acct Pay", "McLaren Corp"), ("Accounts Payable Department", None), ("Acme, A/P", "Acme"), ("Acme", None)])
def test_accounts_payable(spark, value, want):
    assert one(spark, ex.split_accounts_payable(F.lit(value))) == want


def test_title_case():
    assert sim.title_of("UNIVERSITY OF OHIO") == "University of Ohio" and sim.title_of("MCDONALD LAB") == "McDonald Lab" and sim.title_of("Mixed Case") == "Mixed Case"
