"""Named checks: a Spark query over the inputs and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.inputs import PRELUDE, Inputs, portable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(name: str, run: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
    """Register ``run``; ``sql`` continues the common table expressions of ``PRELUDE``."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(run(Inputs(spark, sf_dir)))

    QUERIES[name] = query
    if sql is not None:
        SQL[name] = PRELUDE.rstrip() + "\n" + sql.strip()
