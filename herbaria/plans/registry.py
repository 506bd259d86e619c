"""Query registry: name -> (Spark callable, oracle SQL or None).

Every registered query reads the driver's tables through the binding, so its
work grows with them. The oracle SQL is written independently against the
same raw views (see ``oracle_binding``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from herbaria.plans.oracle_binding import with_binding
from herbaria.sources.testdata import Model

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(model) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn: Callable[[Model], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Model(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_binding(sql)
        return fn

    return deco
