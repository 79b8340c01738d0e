"""Query registry and the views the SQL side shares with the Spark side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the common table expressions it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in views.DUCK.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    ctes = [f"{n} AS ({views.DUCK[n]})" for n in needed]
    body = sql.strip()
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(lead):
            ctes.append(body[len(lead):])
            return lead + ", ".join(ctes)
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
