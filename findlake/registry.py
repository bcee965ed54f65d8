"""All registered queries of the library, by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name; `sql` gives the same rows in DuckDB."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from findlake.queries import code as _code  # noqa: E402,F401
from findlake.queries import comments as _comments  # noqa: E402,F401
from findlake.queries import dependencies as _dependencies  # noqa: E402,F401
from findlake.queries import events as _events  # noqa: E402,F401
from findlake.queries import files as _files  # noqa: E402,F401
from findlake.queries import guards as _guards  # noqa: E402,F401
from findlake.queries import manifests as _manifests  # noqa: E402,F401
from findlake.queries import reports as _reports  # noqa: E402,F401  these register their queries
from findlake.queries import rules as _rules  # noqa: E402,F401
from findlake.queries import stores as _stores  # noqa: E402,F401
