"""Registered queries over the given tables, and the DuckDB SQL they are held against."""

from . import aggregates, files, increments, others, technicals, transforms

QUERIES = aggregates.QUERIES | transforms.QUERIES | technicals.QUERIES | others.QUERIES | files.QUERIES | increments.QUERIES
ORACLE_SQL = aggregates.ORACLE_SQL | transforms.ORACLE_SQL | technicals.ORACLE_SQL | others.ORACLE_SQL | files.ORACLE_SQL | increments.ORACLE_SQL
