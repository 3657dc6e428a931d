"""What enrichment costs: tasks, passes over a text, and the slots that the folds leave."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomery import registry
from loomery.functions import extract as ex
from loomery.functions import text as tx
from loomery.operators import enrich


def test_one_split_of_records_is_many_tasks(spark):
    found = registry.QUERIES["enrich_records"](spark, "/root/testdata/sf0.1")
    assert spark.read.parquet("/root/testdata/sf0.1/customer.parquet").rdd.getNumPartitions() == 1
    assert found.rdd.getNumPartitions() > 1


def test_spread_keeps_rows(spark):
    for rows, tasks in ((0, 1), (1, 1), (1000, 10)):
        out = enrich.spread(spark.range(rows).coalesce(1), "id", 100)
        assert out.rdd.getNumPartitions() == tasks and sorted(r.id for r in out.collect()) == list(range(rows))


def test_equal_cells_are_scanned_once(monkeypatch):
    scanned, scan = [], ex._scan
    monkeypatch.setattr(ex, "_scan", lambda x: scanned.append(x) or scan(x))
    cells = ["Suite 5", None, "Suite 5", "", "12 Elm St Suite", "Suite 5"]
    got = ex.sublocations.func(pa.array(cells, pa.string())).to_pylist()
    assert [tuple(x.values()) for x in got] == [scan(x or "") for x in cells]
    assert len(scanned) == 4
    assert ex.sublocations.func(pa.array([], pa.string())).to_pylist() == []
    assert ex.sublocations.func(pa.array([None], pa.string())).to_pylist() == [dict(zip([*ex.KINDS, "rest", "bare"], scan(""), strict=True))]


def rows_of(spark, *rows):
    columns = [*enrich.NAMES, *enrich.STREETS]
    return spark.createDataFrame([(k, *(r.get(c) for c in columns)) for k, r in enumerate(rows)], "k long, " + ", ".join(f"{c} string" for c in columns))


def slots(df):
    return [{c: r[c] for c in [*enrich.NAMES, *enrich.STREETS] if r[c] is not None} for r in df.orderBy("k").collect()]


def test_segments_take_the_slots_that_earlier_streets_left(spark):
    df = rows_of(spark, {"name_1": "A", "name_2": " ", "street_1": "12 Main St | Department of X | Depot", "street_3": "Division of Y; 5 Elm Rd; Gate"},
                 {"name_1": "A", "name_2": "B", "name_3": "C", "name_4": "D", "name_5": "E", "street_1": "12 Main St|Department of X|Depot", "street_2": "s", "street_3": "t", "street_4": "u", "street_5": "v"}, {"name_1": "A", "street_2": " "})
    out = enrich.split_streets(df)
    assert slots(out) == [
        {"name_1": "A", "name_2": "Department of X", "name_3": "Division of Y", "street_1": "12 Main St", "street_2": "Depot", "street_3": "5 Elm Rd", "street_4": "Gate"},
        {"name_1": "A", "name_2": "B", "name_3": "C", "name_4": "D", "name_5": "E", "street_1": "12 Main St; Department of X; Depot", "street_2": "s", "street_3": "t", "street_4": "u", "street_5": "v"}, {"name_1": "A"},
    ]
    assert [r.preprocess_flags for r in out.orderBy("k").collect()] == [[], ["street-slots-full"], []]


def test_departments_and_addresses_change_sides_while_there_is_room(spark):
    full = {"name_1": "A", "name_2": "B", "name_3": "C", "name_4": "D"}
    assert slots(enrich.departments_to_names(rows_of(spark, full | {"street_2": "Department of X", "street_4": "University Hospital"}))) == [full | {"name_5": "Department of X", "street_4": "University Hospital"}]
    named = {"name_1": "Lab 5 Elm Street", "name_2": "7 Oak Road", "name_3": "9 Fir Ave"}
    streets = {"street_1": "9 FIR AVENUE", "street_2": "s", "street_3": "t", "street_4": "u"}
    assert slots(enrich.addresses_to_streets(rows_of(spark, named | streets))) == [{"name_1": "Lab", "name_2": "7 Oak Road"} | streets | {"street_5": "5 Elm Street"}]


def test_one_search_before_many_rules_changes_nothing(spark):
    texts = ["", " ", None, "Foo  Bar", "Chem. Dept", "UNIV of X", "Unix", "Natl Lab", "ſci Group", "a limited liability company", "x INCORPORATED", "Northern North", "South Boulevard", "Main Street N", "12 mainstreet"]
    rules = [(tx.expand_abbreviations, lambda c: F.when(tx.blank(c), c).otherwise(F.trim(tx.replace_all(c, tx.ABBREVIATIONS)))), (tx.collapse_legal_suffix, lambda c: F.when(tx.blank(c), c).otherwise(tx.clean_whitespace(tx.replace_all(c, tx.LONG_LEGAL))))]
    got = spark.createDataFrame([(x,) for x in texts], "c string").select(*(f(F.col("c")).alias(f"{n}{k}") for k, pair in enumerate(rules) for n, f in zip("ab", pair, strict=True))).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)
