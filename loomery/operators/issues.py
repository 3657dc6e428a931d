"""Issue audit: one boolean column per catalogue code, an array of codes per record.

Everything is expressions over one row, so an audit is a narrow projection of
the scan at any size. A record has name_1..name_5, street_1..street_5 and the
other columns named below; a missing column counts as absent from the file:
required-field codes on it never fire.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import extract as ex
from loomery.functions import text as tx

NAMES, STREETS = [f"name_{k}" for k in range(1, 6)], [f"street_{k}" for k in range(1, 6)]
#: The catalogue in order. Group 6 is expected to persist, group 7 asks for verification.
CATALOGUE = """G1-CROSS-001 G1-CROSS-002 G1-CROSS-003 G1-ADDR-001 G1-ADDR-003 G1-ADDR-004 G1-ADDR-006 G1-ADDR-011 G1-NAME-001 G1-NAME-004 G1-NAME-013
G2-VAL-002 G2-VAL-004 G2-VAL-007 G2-VAL-008 G2-NAME-009 G3-NAME-003 G3-NAME-005 G3-ADDR-005 G3-ADDR-012 G3-ADDR-013 G3-ADDR-014 G3-CONTACT-007
G4-NAME-015 G4-ADDR-008 G4-ADDR-025 G4-ADDR-026 G4-ADDR-027 G5-NAME-001 G5-NAME-002 G2-VAL-001 G2-VAL-003 G2-VAL-006 G2-NAME-012 G7-VERIFY-001""".split()
#: Declared, never emitted.
SILENT = ["G1-ADDR-009", "G2-CONTACT-008", "G2-CONTACT-009"]
REQUIRED = {"name_1": "G2-VAL-001", "postal_code": "G2-VAL-002", "tax_jurisdiction": "G2-VAL-003", "region": "G2-VAL-004", "language_key": "G2-VAL-006", "search_term_1": "G2-VAL-007", "country": "G2-VAL-008"}
ORG_IN_STREET = r"(?i)\b(?:University|Universit[äa]t|Institute|Institut|College|Faculty|School|Hospital|Clinic|Corp(?:oration)?|Inc|Incorporated|LLC|Ltd|Limited|Company|GmbH|Technolog(?:y|ies)|Systems|Solutions|Laborator(?:y|ies)|Labs|Industries|Sciences|Instruments|Pharmaceuticals?|Pharma)\b"
CONTINUES = r"^\s*(?:and|&|of|for|the|de|der|und|et)\b|^\s*[a-z]"
ABBREVIATED = r"(?i)\b(?:Univ|Uni|Dept|Dep|Div|Inst|Natl|Nat'l|Intl|Int'l|Assoc|Assn|Ctr|Lab|Labs|Tech|Sch|Mgmt|Engrg|Eng|Sci|Med|Svcs|Svc|Co|Corp|Inc|Ltd|Mfg|Hosp|Grp|Fla)\b\.?"
DOTTED = r"\b[A-Za-z](?:\.[A-Za-z]){1,}\.?(?![A-Za-z])"
LEGAL = r"(?i)\b(?:inc|incorporated|corp|corporation|llc|llp|ltd|limited|gmbh|ag|plc|sa|nv|bv|kg|co|company)\b\.?\s*$"
MAIL_STOP = r"(?i)\b(?:Mail\s*Stop|Mailstop|Mail\s*Code|M\s*[./]\s*S)\b\.?\s*[:#\-]?\s*[A-Za-z0-9]"
BARE_MS = r"(?i)\bMS\b\.?\s*[:#\-]?\s*(?!\d{5}\b)(?:[A-Za-z0-9]{1,2}\b|[A-Za-z0-9][\w\-]*\d[\w\-]*\b|\d[\w\-]*\b)"
POSTAL = {"US": r"^\d{5}(?:-\d{4})?$", "CA": r"^[A-Za-z]\d[A-Za-z] ?\d[A-Za-z]\d$", "DE": r"^\d{5}$"}
COUNTRIES = {"UNITED STATES": "US", "USA": "US", "GERMANY": "DE", "DEUTSCHLAND": "DE", "DEU": "DE", "UNITED KINGDOM": "GB", "UK": "GB", "GBR": "GB", "FRANCE": "FR", "FRA": "FR", "JAPAN": "JP", "JPN": "JP", "CANADA": "CA", "CAN": "CA", "SWITZERLAND": "CH", "CHE": "CH", "AUSTRIA": "AT", "ITALY": "IT", "SPAIN": "ES", "CHINA": "CN"}
TRUTHY = ["true", "yes", "y", "x", "1"]


def iso_country(c: Column) -> Column:
    """Two-letter code of a name or code; null if it isn't known."""
    u = F.upper(F.trim(c))
    known = sorted({*COUNTRIES.values(), "NL", "SE", "BE", "DK", "FI", "NO", "PL", "PT", "IE", "AU", "NZ", "IN", "KR", "BR", "MX", "IL", "SG", "TW", "ZA", "CZ", "HU", "TR", "GR"})
    table = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    return F.coalesce(F.when(u.isin(known), u), table[u])


def is_set(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(TRUTHY), F.lit(False))


def street_signature(street: Column, house_number: Column) -> Column:
    """Set of numbers and sorted words; the house number stands in for missing numbers."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(street, F.lit(""))), F.lit(r"([a-z]+|\d+)"), F.lit(1))
    digits = F.filter(tokens, lambda t: t.rlike(r"^\d"))
    own = F.when(F.size(digits) > 0, digits).otherwise(F.regexp_extract_all(F.coalesce(house_number, F.lit("")), F.lit(r"(\d+)"), F.lit(1)))
    return F.when(F.size(tokens) > 0, F.concat_ws("|", F.array_join(F.array_sort(F.array_distinct(own)), ","), F.array_join(F.array_sort(F.filter(tokens, lambda t: ~t.rlike(r"^\d"))), ",")))


def issue_columns(columns: list[str]) -> dict[str, Column]:
    """A boolean column per emitted code, in catalogue order."""
    col = lambda c: F.col(c).cast("string") if c in columns else F.lit(None).cast("string")
    n, s = [col(c) for c in NAMES], [col(c) for c in STREETS]
    some = lambda f, xs: F.coalesce(F.exists(F.array(*xs), f), F.lit(False))
    any_pattern = lambda x, patterns: reduce(lambda a, b: a | b, [ex.has(x, p) for p in patterns])
    filled = [~tx.blank(x) for x in n]
    any_of = lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0]
    norm = lambda x: F.lower(tx.clean_whitespace(F.coalesce(x, F.lit(""))))
    street_type = rf"(?i)\b(?:{ex.STREET_TYPES})\b"
    boxes = F.size(F.filter(F.array(*s), lambda x: ex.has(x, ex.PO_BOX))) + (~tx.blank(col("po_box"))).cast("int")
    real = F.transform(F.filter(F.array(*s), ex.looks_like_street), norm)
    signs = F.filter(F.array(*[street_signature(x, col("house_number") if k == 0 else F.lit(None).cast("string")) for k, x in enumerate(s)]), lambda x: x.isNotNull())
    found = F.array(*[ex.sublocations(x) for x in s])
    subs = F.flatten(F.transform(found, lambda x: F.array(*[F.concat(F.lit(k + ":"), F.lower(x[k])) for k in ex.KINDS])))
    contact_data = some(lambda x: ex.has(x, ex.EMAIL) | ex.has(x, ex.PHONE) | ex.has(x, ex.URL) | ex.has(x, ex.CO_ATTN_PREFIX), n + s)
    iso = iso_country(col("country"))
    formats = F.lit(False)
    for code, p in POSTAL.items():
        formats = formats | ((iso == code) & ~F.trim(col("postal_code")).rlike(p))
    unofficial = lambda x: ex.has(x, ABBREVIATED) | ex.has(x, DOTTED)
    units = F.transform(F.array(*n[1:]), tx.is_unit_construction)
    fine = F.transform(F.array(*n[1:]), tx.is_granular_unit)
    out = {
        "G1-CROSS-001": some(lambda x: any_pattern(x, ex.ADDRESSES), n),
        "G1-CROSS-002": some(lambda x: ex.has(F.regexp_replace(x, r"(?i)\bUniversity\s+Cent(?:er|re)\b", " "), ORG_IN_STREET) & ~ex.has(x, street_type), s),
        "G1-CROSS-003": contact_data | some(lambda x: ex.titled_person(x).isNotNull(), s),
        "G1-ADDR-001": tx.blank(col("house_number")) & some(ex.looks_like_street, s),
        "G1-ADDR-003": some(lambda x: any_pattern(x, [p for _, p in ex.SUBLOCATIONS]) | ex.has(x, r"(?i)\b(?:Gate|Wing)\s+(?:\w{1,2}\b(?!-)|\w[\w\-]*\d)"), s),
        "G1-ADDR-004": some(lambda x: ex.has(x, ex.PO_BOX), s),
        "G1-ADDR-006": some(lambda x: ex.mail_code(x)["value"].isNotNull() | ex.has(x, MAIL_STOP) | ex.has(x, BARE_MS), s),
        "G1-ADDR-011": some(ex.looks_like_department, s),
        "G1-NAME-001": any_of([filled[k] & filled[k + 1] & ~ex.has(n[k], LEGAL) & ex.has(n[k + 1], CONTINUES) for k in range(4)]),
        "G1-NAME-004": any_of([~filled[k] & any_of(filled[:k]) & any_of(filled[k + 1 :]) for k in range(1, 4)]),
        "G1-NAME-013": some(ex.is_opaque_code, n),
        "G2-NAME-009": F.exists(F.arrays_zip(fine.alias("f"), F.sequence(F.lit(0), F.lit(3)).alias("k")), lambda z: z["f"] & ~F.exists(F.arrays_zip(units.alias("u"), F.sequence(F.lit(0), F.lit(3)).alias("j")), lambda y: y["u"] & (y["j"] != z["k"]))),
        "G2-NAME-012": tx.looks_like_university(n[0]) & ~filled[1],
        "G3-NAME-003": some(ex.is_dba, n),
        "G3-NAME-005": any_of([(norm(n[k]) != "") & (norm(n[k]) == norm(n[k + 1])) for k in range(4)]),
        "G3-ADDR-005": boxes >= 2,
        "G3-ADDR-012": F.size(signs) != F.size(F.array_distinct(signs)),
        "G3-ADDR-013": F.size(F.array_distinct(real)) >= 2,
        "G3-ADDR-014": (boxes >= 1) & (F.size(real) > 0),
        "G3-CONTACT-007": ex.has_multiple_contacts(col("contact")),
        "G4-NAME-015": sum((F.coalesce(F.length(x), F.lit(0)) for x in n), F.lit(0)) > 140,
        "G4-ADDR-008": some(lambda x: ex.has(x, ex.BARE_MARKER), s),
        "G4-ADDR-025": F.size(F.array_distinct(F.array_compact(subs))) > 4,
        "G4-ADDR-026": ~tx.blank(col("postal_code")) & F.coalesce(formats, F.lit(False)),
        "G4-ADDR-027": ~tx.blank(col("country")) & (iso.isNull() | (F.upper(F.trim(col("country"))) != iso)),
        "G5-NAME-001": unofficial(n[0]),
        "G5-NAME-002": some(unofficial, n[1:]),
        "G7-VERIFY-001": is_set(col("flag_for_review")),
    }
    out |= {code: tx.blank(col(c)) if c in columns else F.lit(False) for c, code in REQUIRED.items()}
    return {code: out[code] for code in CATALOGUE}


def detect_issues(records: DataFrame, origins: list[str] | None = None) -> DataFrame:
    """``records`` with a column issues: the codes that fire, in catalogue order."""
    codes = [F.when(c, F.lit(code)) for code, c in issue_columns(records.columns).items() if origins is None or code in origins]
    return records.withColumn("issues", F.array_compact(F.array(*codes)))


def issue_census(audited: DataFrame) -> DataFrame:
    """(code, records)"""
    return audited.select(F.explode("issues").alias("code")).groupBy("code").agg(F.count("*").alias("records"))
