"""All queries over the library's own operators, and the SQL that each is checked against."""

from __future__ import annotations

from tessera.plans import ingest_queries, ml_queries, search_queries, trend_queries

QUERIES = {**ingest_queries.QUERIES, **trend_queries.QUERIES, **search_queries.QUERIES, **ml_queries.QUERIES}
ORACLE_SQL = {**ingest_queries.oracle(), **trend_queries.oracle(), **search_queries.oracle(), **ml_queries.oracle()}
