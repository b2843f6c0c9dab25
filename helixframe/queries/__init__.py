"""The operators applied to the star-schema, event, text and embedding tables, each beside equivalent SQL.

Every module registers its queries with ``query``; ``QUERIES`` and ``SQL`` hold them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load_all() -> None:
    from helixframe.queries import joining, modelling, selecting, storing, summarising, vectorial  # noqa: F401
