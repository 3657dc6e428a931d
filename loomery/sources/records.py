"""Record sources: headers onto canonical columns, spreadsheets, JSON runs; output projection."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spreadsheet headers of the canonical columns.
ALIASES = {
    "record_id": ["Customer", "Customer Number", "Record ID", "row_id"], "country": ["Country/Region Key", "Country", "country_region_key"], "postal_code": ["Postal Code", "ZIP", "zip"], "city": ["City"], "region": ["Region", "State"],
    **{f"name_{k}": [f"Name {k}", f"name{k}"] for k in range(1, 6)}, "street_1": ["Street", "Street 1"], **{f"street_{k}": [f"Street {k}"] for k in range(2, 6)},
    "house_number": ["House Number", "House No", "house_no"], "po_box": ["PO Box"], "contact": ["Contact", "Contact Person"], "email": ["Email", "E-Mail Address"], "search_term_1": ["Search Term 1"], "search_term_2": ["Search Term 2"],
    "language_key": ["Language Key", "Language"], "tax_jurisdiction": ["Tax Jurisdiction"], "flag_for_review": ["Flag for Review"], "cluster_id": ["Cluster ID"], "routing": ["Routing"], "confidence": ["Confidence"], "reasoning": ["Reasoning"],
    "last_order_year": ["Sales_Order_Last_Used"], "orders_in_last_used_year": ["Sales_Order_Total_Count"], "partner_last_order_year": ["Sales_Order_Partner_Last_Used"], "partner_orders_in_last_used_year": ["Sales_Order_Partner_Total_Count"],
    "equipment_count": ["Equipment_Total_Count"], "sleeping_band": ["SleepingCustomer"], "customer_status": ["CustomerStatus"], "account_group": ["Account group"], "company_code_consolidated": ["Company_Code_Consolidated"], "sales_org_consolidated": ["Sales_Org_Consolidated"],
}
#: Columns of an enriched file, in order; others pass through behind them.
OUTPUT = ["record_id", *[f"name_{k}" for k in range(1, 6)], *[f"street_{k}" for k in range(1, 6)], "house_number", "po_box", "postal_code", "city", "region", "country", "contact", "email", "search_term_1", "search_term_2", "ror_id", "lei_id", "domain", "website_url", "record_type", "enrichment_status", "flag_codes", "flag_for_review"]


def fold_header(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())


def alias_table() -> dict[str, str]:
    return {fold_header(a): field for field, names in ALIASES.items() for a in [field, *names]}


def canonical_columns(df: DataFrame) -> DataFrame:
    """Known headers renamed, first come first served, cells as trimmed text, and ``_seq``; other columns stay."""
    table, names, taken = alias_table(), {}, set()
    for c in df.columns:
        field = table.get(fold_header(c))
        if field and field not in taken:
            names[c] = field
            taken.add(field)
    columns = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(names[c]) if c in names else F.col(f"`{c}`") for c in df.columns if c in names or c not in taken]
    out = df.select(*columns)
    return out if "_seq" in out.columns else out.withColumn("_seq", F.monotonically_increasing_id())


def present_fields(df: DataFrame) -> set[str]:
    return set(df.columns) & set(ALIASES)


def with_schema(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields as text columns, null where the file has none."""
    return df.select(*(F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields), *(c for c in df.columns if c not in fields))


def output_projection(df: DataFrame, passthrough: bool = True) -> DataFrame:
    """Output columns in their order, then what isn't one of them or internal (``_`` in front)."""
    first = [c for c in OUTPUT if c in df.columns]
    return df.select(*first, *(c for c in df.columns if passthrough and c not in first and not c.startswith("_")))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes, wanted: str | None = None) -> Iterator[list[str | None]]:
    """Rows of the first sheet of a workbook whose header has ``wanted`` (any sheet without it)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        for sheet in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
            rows = []
            for row in ET.fromstring(z.read(sheet)).iter(f"{_NS}row"):
                cells: dict[int, str] = {}
                for place, c in enumerate(row.iter(f"{_NS}c")):
                    letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                    at = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters))) - 1 if letters else place
                    v = c.find(f"{_NS}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                    if text is not None and text.strip():
                        cells[at] = text.strip()
                if cells:
                    rows.append([cells.get(k) for k in range(max(cells) + 1)])
            if rows and (wanted is None or fold_header(wanted) in {fold_header(h or "") for h in rows[0]}):
                yield from rows
                return


def read_xlsx(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame:
    """path, row number and cells (header to value) of every data row of the workbooks under ``path``.

    Workbooks are read as binary files, one task each at most, so many files
    are read side by side and no local path is needed.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(sheet_rows(content, wanted))
                header = rows[0] if rows else []
                yield pd.DataFrame([(p, k, {h: v for h, v in zip(header, r, strict=False) if h and v is not None}) for k, r in enumerate(rows[1:])], columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, row long, cells map<string,string>")


def spread_cells(rows: DataFrame, headers: list[str]) -> DataFrame:
    """Rows of ``read_xlsx`` with a column per header."""
    return rows.select(F.col("row").alias("_seq"), *(F.col("cells")[h].alias(h) for h in headers))


def run_keys(df: DataFrame, name: str, city: str, customer: str) -> Column:
    """Key of a run's rows: name and city, with the customer where that repeats, with the place where both do."""
    norm = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    base = F.concat_ws("|", norm(name), norm(city))
    longer = F.concat_ws("|", base, norm(customer))
    n = F.count("*").over(Window.partitionBy(base))
    m = F.count("*").over(Window.partitionBy(longer))
    place = F.row_number().over(Window.partitionBy(longer).orderBy("_seq"))
    return F.when(n == 1, base).when(m == 1, longer).otherwise(F.concat_ws("|", longer, place.cast("string")))
