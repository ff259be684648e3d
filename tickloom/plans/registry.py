"""Registered queries: one Spark callable per operator and, where SQL can say it, its check text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans.fixtures import check_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``name``; ``sql`` is the check text over the named fixture views."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = check_sql(sql, *views)
        return fn

    return add


def rint(expr: str, digits: int) -> str:
    """Check text of functions.numbers.round_to."""
    scale = f"{10**digits}.0D"
    return f"(round_even(({expr})*{scale}, 0)/{scale} + 0.0D)"


def load() -> None:
    """Import every module that registers queries."""
    from tickloom.plans import (  # noqa: F401
        q_columns, q_joins, q_models, q_paths, q_sources, q_stats, q_streams, q_sweeps, q_trades, q_validate,
    )
