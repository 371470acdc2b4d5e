"""The queries of the library, by inventory key, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.roles import Roles, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, roles: str, sql: str):
    """Register a function of `Roles` under a key; ``sql`` follows the CTEs of the named roles."""

    def wrap(f: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        QUERIES[key] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        head = ctes(*roles.split()) if roles else ""
        body = sql.strip()
        if head and body.upper().startswith("WITH "):
            head, body = head + ",", body[5:]
        ORACLES[key] = f"{head}\n{body}"
        return f

    return wrap
