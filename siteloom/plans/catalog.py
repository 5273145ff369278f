"""Every registered query of the engine and its SQL twin."""

from __future__ import annotations

from siteloom.plans import companies, decisions, web, whole_runs

QUERIES: dict = {**web.QUERIES, **companies.QUERIES, **decisions.QUERIES, **whole_runs.QUERIES}
ORACLE_SQL: dict = {**web.ORACLE_SQL, **companies.ORACLE_SQL, **decisions.ORACLE_SQL, **whole_runs.ORACLE_SQL}
