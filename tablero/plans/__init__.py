"""Registered queries over the driver tables, and the same results in SQL."""

from . import extra, more_sql, oracle, pages
from .queries import queries


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql() | pages.oracle_sql() | more_sql.oracle_sql() | extra.oracle_sql()


__all__ = ["oracle_sql", "queries"]
