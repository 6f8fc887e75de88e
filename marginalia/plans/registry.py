"""Where queries over the driver's tables and their SQL are registered."""

from __future__ import annotations

from functools import wraps

from ..session import prepare

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = wraps(f)(lambda spark, sf_dir: f(prepare(spark), sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
