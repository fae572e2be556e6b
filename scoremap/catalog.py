"""The registered queries of the library and their SQL twins."""

from scoremap.plans.oracle import oracle_sql
from scoremap.plans.queries import queries

__all__ = ["oracle_sql", "queries"]
