"""Registry of the driver-facing queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plazalens.plans.driver_views import Views, compose
from plazalens.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the driver views, with its oracle when SQL can say it."""

    def register(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Views(prepare(spark), folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = compose(sql)
        return build

    return register
