"""The registered queries: each pairs a Spark plan with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    """Register a query under ``name``; without SQL it is checked by the unit tests alone."""

    def keep(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query '{name}' registered twice")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def load_all() -> None:
    from tabulens.plans import (  # noqa: F401
        cleaning,
        distributions,
        evaluation,
        modelling,
        profiling,
        relations,
    )
