

from . import flows, queries

QUERIES = queries.QUERIES | flows.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | flows.ORACLE_SQL
