"""Query registry: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curbline.plans.views import SQL_VIEWS, Views

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(views)`` under ``name``; ``sql`` sees the shared views and ``ctes``."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in SPARK:
            raise ValueError(f"query {name} is registered twice")
        SPARK[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            more = f",\n{ctes.strip()}" if ctes else ""
            recursive = "RECURSIVE " if "UNION ALL -- step" in ctes else ""
            SQL[name] = f"WITH {recursive}{SQL_VIEWS.strip()}{more}\n{sql.strip()}"
        return fn

    return register
