"""Registry of the engine's queries and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query (spark, sf_dir) -> DataFrame and its SQL, if SQL can express it."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


from tidefold.plans import analytics, changes, operations, snapshot  # noqa: E402, F401
