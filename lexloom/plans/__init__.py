"""Named queries over the driver's tables, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from lexloom.plans import aggregates, corpus, extraction, joins, ranking
from lexloom.plans.named import QUERIES, SQL

__all__ = ["aggregates", "corpus", "extraction", "joins", "oracle_sql", "queries", "ranking"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
