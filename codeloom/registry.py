"""All registered queries of the graph engine and the SQL that each must agree with."""

from __future__ import annotations

from codeloom.plans import queries

QUERIES = queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL
