"""Registry of named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Named tables the checking SQL may build on: name -> (names it needs, SQL)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {}


def table(name: str, sql: str, *needs: str) -> None:
    TABLES[name] = (needs, sql)


def _ordered(names, seen):
    for name in names:
        if name not in seen:
            _ordered(TABLES[name][0], seen)
            seen.append(name)
    return seen


def with_tables(body: str, *names: str) -> str:
    ctes = [f"{n} AS ({TABLES[n][1]})" for n in _ordered(names, [])]
    head = f"WITH RECURSIVE {', '.join(ctes)} " if ctes else ""
    return head + body


def query(key: str, oracle: str | None = None, using: tuple[str, ...] = (), extra: str = ""):
    """Register a query; ``extra`` holds further comma-led CTEs for the SQL."""
    def register(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ctes = [f"{n} AS ({TABLES[n][1]})" for n in _ordered(using, [])]
            if extra:
                ctes.append(extra)
            ORACLE[key] = (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + oracle
        return fn
    return register


def values(rows, columns) -> str:
    """SQL table of literals."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def sql_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"
