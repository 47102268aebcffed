"""The collection of named queries."""

from __future__ import annotations

from lexloom.plans.fixtures import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with the SQL of its rows where SQL can tell them."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = with_views(sql)
        return function

    return add
