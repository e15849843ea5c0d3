"""Every registered query of the engine, with the SQL it is checked against."""

from __future__ import annotations

from . import details, records, retrieval

QUERIES = {**retrieval.QUERIES, **records.QUERIES, **details.QUERIES}
ORACLE = {**retrieval.ORACLE, **records.ORACLE, **details.ORACLE}
