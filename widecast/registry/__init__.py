"""Registered queries: each is a Spark query, most with the equal SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_REGISTERED: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query under ``name`` with the SQL it must agree with, if SQL can say it."""

    def add(run):
        if name in _REGISTERED:
            raise ValueError(f"query {name!r} registered twice")
        _REGISTERED[name] = Query(name, run, sql)
        return run

    return add


def registered() -> dict[str, Query]:
    from widecast.registry import bayes, checks, encoding, profiles, reports, samples, tables, training  # noqa: F401

    return dict(_REGISTERED)
