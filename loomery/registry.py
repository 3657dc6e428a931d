"""Registered queries of the record engine and their DuckDB SQL."""

from __future__ import annotations

from loomery.plans import checks, dedup, golden, ladder, records, review, streets, structures

_PLANS = [golden, dedup, records, checks, ladder, streets, structures, review]
QUERIES = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLE_SQL = {k: v for p in _PLANS for k, v in p.ORACLE_SQL.items()}
