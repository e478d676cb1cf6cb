"""Queries over the test tables, each with the SQL that says what it returns."""

from . import log_queries, report_queries, run_queries, text_queries

QUERIES = log_queries.QUERIES | run_queries.QUERIES | text_queries.QUERIES | report_queries.QUERIES
ORACLE_SQL = log_queries.ORACLE_SQL | run_queries.ORACLE_SQL | text_queries.ORACLE_SQL | report_queries.ORACLE_SQL
