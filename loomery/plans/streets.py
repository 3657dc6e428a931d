"""Typed-segment routing of customers' streets, and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import streets

SHAPES = ["C/O Roe Ltd | Polaris House, # Elm St", "ASTER HOUSE, # OAK ROAD, Boston", "The Sherard Bldg, Halley Rd, Oxford Science Park", "# Main St, Suite 400", "3120 TAMU | 5045 Emerging Technologies Building", "c/o Chemistry Dept. | # Elm St | 14 Oak Ave", "Anything | Aster House | Star House", "70174 | # Elm St"]


def street_router(spark, sf_dir):
    """Fields of every customer's street; the house number is the key."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (k % len(SHAPES) + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.cast("string").alias("record_id"), F.replace(shape, F.lit("#"), k.cast("string")).alias("street_1"), F.when(k % 3 == 0, "Line two").alias("street_2"), *(none.alias(f"street_{n}") for n in (3, 4, 5)),
        F.lit("Org").alias("name_1"), F.when(k % 7 == 0, "Unit").alias("name_2"), *(none.alias(f"name_{n}") for n in (3, 4, 5)), F.lit("Boston").alias("city"), none.alias("state"), F.when(k % 16 == 7, "02110").alias("postal_code"),
        F.when(k % 5 == 0, "roe ltd").when(k % 5 == 1, "Bob").alias("care_of"), none.alias("building"), F.when(k % 11 == 0, "M1").alias("mail_code"), F.array().cast("array<string>").alias("preprocess_flags"))
    out = streets.route_segments(rows)
    return out.select("record_id", "street_1", "street_2", "street_3", "name_2", "name_3", "care_of", "building", "mail_code", "postal_code", F.array_join("preprocess_flags", ",").alias("flags"))


QUERIES = {"street_router": street_router}
ORACLE_SQL = {
    "street_router": """
WITH r AS (SELECT c_custkey k, c_custkey % 8 c, CASE WHEN c_custkey % 3 = 0 THEN ['Line two'] ELSE []::VARCHAR[] END two, CASE c_custkey % 5 WHEN 0 THEN 'roe ltd' WHEN 1 THEN 'Bob' END care, c_custkey % 7 = 0 unit, c_custkey % 11 = 0 coded, c_custkey % 16 = 7 own FROM customer),
l AS (SELECT *, list_concat(CASE c WHEN 0 THEN [k || ' Elm St'] WHEN 1 THEN [k || ' OAK ROAD'] WHEN 2 THEN ['Halley Rd', 'Oxford Science Park'] WHEN 3 THEN [k || ' Main St, Suite 400'] WHEN 4 THEN CASE WHEN coded THEN ['3120 TAMU'] ELSE []::VARCHAR[] END
  WHEN 5 THEN [k || ' Elm St', '14 Oak Ave'] WHEN 6 THEN ['Anything', 'Star House'] ELSE CASE WHEN own THEN [k || ' Elm St', '70174'] ELSE [k || ' Elm St'] END END, two) lines FROM r)
SELECT k::VARCHAR record_id, lines[1] street_1, lines[2] street_2, lines[3] street_3,
  CASE WHEN unit THEN 'Unit' WHEN c = 5 THEN 'Chemistry Dept' END name_2, CASE WHEN unit AND c = 5 THEN 'Chemistry Dept' END name_3,
  CASE WHEN c = 0 THEN CASE WHEN care = 'Bob' THEN 'Bob | Roe Ltd' WHEN care = 'roe ltd' THEN care ELSE 'Roe Ltd' END ELSE care END care_of,
  CASE c WHEN 0 THEN 'Polaris House' WHEN 1 THEN 'Aster House' WHEN 2 THEN 'The Sherard Bldg' WHEN 4 THEN 'Emerging Technologies Building' WHEN 6 THEN 'Aster House' END building,
  CASE WHEN coded THEN 'M1' WHEN c = 4 THEN '3120 TAMU' END mail_code, CASE WHEN own THEN '02110' WHEN c = 7 THEN '70174' END postal_code, CASE WHEN c = 5 THEN 'second-street' ELSE '' END flags
FROM l"""
}
