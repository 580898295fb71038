"""All queries of this folder: name -> function(spark, sf_dir), and name -> SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query under ``name``, with the SQL that gives the same rows if there is any."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add
