"""Mixed streets, care-of parts, sub-locations and junk: every segment ends in the field of its kind."""

import re

import pytest
from pyspark.sql import functions as F

from loomery.functions import extract as ex
from loomery.operators import enrich, streets

NAMES = [f"name_{k}" for k in range(1, 6)]
STREETS = [f"street_{k}" for k in range(1, 6)]
FIELDS = ["city", "state", "postal_code"]


@pytest.fixture(scope="module")
def run(spark):
    def go(rows):
        """Rows as dicts, processed together; results in order."""
        columns = [*NAMES, *STREETS, *FIELDS]
        made = spark.createDataFrame([(k, *(r.get(c) for c in columns)) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{c} string" for c in columns))
        return enrich.process_address(made).orderBy("k").collect()

    return go


def test_mixed_streets_go_to_their_fields(run):
    rows = [
        {"street_1": "C/O RCUK SSC Ltd, Polaris House, North Star House, North Star Avenue", "city": "Swindon"},
        {"street_1": "ASTER HOUSE, 2A UNIVERSITY ROAD, BELFAST BT7 1NH", "city": "Belfast"},
        {"street_1": "The Sherard Bldg, Edmund Halley Rd, Oxford Science Park", "city": "Oxford"},
        {"street_1": "100 Main St, Suite 400", "city": "Boston"},
        {"street_1": "3120 TAMU | 5045 Emerging Technologies Building", "city": "College Station"},
        {"street_1": "c/o Chemistry Dept. | 12 Elm St | 14 Oak Ave", "name_1": "Acme"},
        {"street_1": "Aster House, c/o Jane Roe | c/o jane roe, c/o John Doe, 1 Elm St"},
    ]
    a, b, c, d, e, f, g = run(rows)
    assert (a.care_of, a.building, a.street_1, a.street_2) == ("RCUK SSC Ltd", "Polaris House", "N Star Ave", "N Star House")
    assert (b.building, b.street_1.lower(), b.street_2) == ("Aster House", "2a university rd", None) and b.postal_code == "BT7 1NH"
    assert (c.building, c.street_1, c.street_2) == ("The Sherard Bldg", "Edmund Halley Rd", "Oxford Science Park")
    assert (d.street_1, d.suite, d.building) == ("100 Main St", "400", None)
    assert (e.mail_code, e.building, e.street_1) == ("3120 TAMU", "Emerging Technologies Building", None)
    assert (f.name_2, f.care_of, f.street_1, f.street_2, f.preprocess_flags) == ("Chemistry Dept", None, "12 Elm St", "14 Oak Ave", ["second-street"])
    assert (g.care_of, g.building, g.street_1) == ("Jane Roe | John Doe", "Aster House", "1 Elm St")


def test_full_slots_keep_what_finds_none(run):
    r = run([{"street_1": "A Wing | B Wing | Aster House | Oak House", **{f"street_{k}": f"Line {k}" for k in range(2, 6)}, **{n: "Org" for n in NAMES}}, {"street_1": "Chem Dept | Aster House | 1 Elm St", **{n: "Org" for n in NAMES}}])
    assert [r[0][s] for s in STREETS] == ["A Wing", "B Wing", "Oak House", "Line 2", "Line 3, Line 4, Line 5"] and "street-slots-full" in r[0].preprocess_flags
    assert (r[1].street_1, r[1].street_2, r[1].building) == ("1 Elm St", "Chem Dept", "Aster House")


def test_single_streets(run):
    rows = ["51 Sleeper St, 7th", "1500 Graduate Ln A104", "2721 Sullivan Dr Campus Box 7212", "51 Sleeper St, 7th Unit 5", "Att. Bayard Huck 200 Clarendon Street 22nd Floor", "c/o Chemistry Dept.", "c/o Jane Roe", "70174"]
    a, b, c, d, e, f, g, h = run([{"street_1": x, "street_2": "c/o John Doe" if x == "c/o Jane Roe" else None} for x in rows])
    assert (a.street_1, a.floor) == ("51 Sleeper St", "7") and (b.street_1, b.room) == ("1500 Graduate Ln", "A104") and (c.street_1, c.mail_stop) == ("2721 Sullivan Dr", "Campus Box 7212")
    assert (d.street_1, d.unit, d.floor) == ("51 Sleeper St, 7th", "5", None)  # earlier patterns don't look again
    assert (e.care_of, e.street_1, e.floor) == ("Bayard Huck", "200 Clarendon St", "22")
    assert (f.name_1, f.care_of, f.street_1) == ("Chemistry Dept", None, None)
    assert (g.care_of, g.street_1) == ("Jane Roe | John Doe", None)
    assert h.street_1 == "70174"


def test_junk(spark):
    r = spark.range(1).select(ex.strip_junk(F.lit("Chemistry 70174 AB-12 see www.x.org")).alias("d"), ex.strip_street_junk(F.lit("70174 Elm St 415 555-1234 http://x.org")).alias("s"), ex.strip_junk(F.lit("MIT 5th floor")).alias("k"), ex.strip_junk(F.lit("12345")).alias("e")).first()
    assert (r.d, r.s, r.k, r.e) == ("Chemistry see", "70174 Elm St", "MIT 5th floor", "")


def test_no_word_is_lost(spark, run):
    """Every word of a street ends in a field, or is a marker, a city or a postal code of the record."""
    pieces = ["c/o Jane Roe", "Attn: Bob Ray", "Aster House", "Oak Hall", "12 Elm Street", "Science Park", "Chemistry Dept.", "3120 TAMU", "Boston", "Suite 12", "Dock 4", "Anything Else", "PO Box 9", "70174"]
    rows, k = [], 0
    for a in pieces:
        for b in pieces:
            k += 1
            rows.append({"street_1": f"{a} {'|,'[k % 2]} {b}", "street_2": pieces[k % len(pieces)], "city": "Boston", "name_1": "Org"})
    markers = set("c o attn suite boston po box street st".split())
    words = lambda x: set(re.findall(r"[a-z0-9]+", (x or "").lower()))
    for row, r in zip(rows, run(rows)):
        out = set().union(*(words(v) for v in r.asDict().values() if isinstance(v, str)))
        assert words(row["street_1"]) | words(row["street_2"]) <= out | markers, (row, r)


def test_title_of_capitals(spark):
    r = spark.range(1).select(streets.title_capitals(F.lit("HOUSE OF THE SUN")).alias("a"), streets.title_capitals(F.lit("McKay Hall")).alias("b")).first()
    assert (r.a, r.b) == ("House of the Sun", "McKay Hall")
