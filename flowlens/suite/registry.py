"""The registered queries: a Spark function and, where SQL can say it, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from flowlens.suite.views import Views, with_views


@dataclass(frozen=True)
class Query:
    run: Callable[[Views], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, run: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    if name in REGISTRY:
        raise ValueError(f"query {name} is registered twice")
    REGISTRY[name] = Query(run, sql)


def query(name: str, sql: str | None = None):
    """Decorator form of :func:`register`."""

    def keep(run):
        register(name, run, sql)
        return run

    return keep


def _load() -> None:
    from flowlens.suite import flows, monitoring, requests, scoring, storage, vectors  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, sf_dir, q=q: q.run(Views(spark, sf_dir))) for n, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: with_views(q.sql) for n, q in REGISTRY.items() if q.sql}
