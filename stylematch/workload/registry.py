"""Registry of queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stylematch.workload.tables import ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
COVERS: dict[str, list[str]] = {}
_SQL: dict[str, tuple[str, str, str]] = {}


def query(name: str, covers: str, sql: str | None = None, tables: str = "", extra: str = ""):
    """Register a query for the operators in ``covers``.

    ``tables`` names the derived tables its check SQL reads, ``extra`` adds CTEs.
    """

    def register(fn):
        QUERIES[name] = fn
        COVERS[name] = covers.split()
        if sql is not None:
            _SQL[name] = (sql.strip(), tables, extra.strip())
        return fn

    return register


def oracles() -> dict[str, str]:
    """Check SQL per query, with the CTEs it needs in front."""
    out = {}
    for name, (body, tables, extra) in _SQL.items():
        head = [c for c in (ctes(tables.split()), extra) if c]
        if head and body.upper().startswith("WITH "):
            out[name] = f"WITH {', '.join([*head, body[5:]])}"
        else:
            out[name] = (f"WITH {', '.join(head)}\n" if head else "") + body
    return out
