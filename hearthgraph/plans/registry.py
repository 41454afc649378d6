"""Registered queries and their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RAW: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    """A named sub-select that oracle statements may refer to."""
    CTES[name] = body


def _closure(sql: str) -> list[str]:
    ordered: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in CTES:
            if name in path or name in ordered:
                continue
            if re.search(rf"\b{name}\b", text):
                visit(CTES[name], path + (name,))
                ordered.append(name)

    visit(sql, ())
    return ordered


def with_ctes(sql: str) -> str:
    names = _closure(sql)
    if not names:
        return sql
    heads = ",\n".join(f"{n} as ({CTES[n]})" for n in names)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {heads},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {heads},\n{body[len('with '):]}"
    return f"with {heads}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is its oracle, given in terms of the tables and the CTEs."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            RAW[name] = sql
            ORACLES[name] = with_ctes(sql)
        return fn

    return register
