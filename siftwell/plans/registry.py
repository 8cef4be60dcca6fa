"""Where queries are registered, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from .relations import oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = oracle(sql)
        return f

    return add
