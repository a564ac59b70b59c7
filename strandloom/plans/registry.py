"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans.inputs import Inputs, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, longs: tuple[str, ...] = ()):
    """Register a function of :class:`Inputs`; ``check`` is the equivalent SQL, if there is one.

    ``longs`` names result columns the SQL side would return with another integer width.
    """

    def wrap(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Inputs(spark, folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if check is not None:
            sql = check_sql(check)
            if longs:
                casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in longs)
                sql = f"SELECT * REPLACE ({casts}) FROM ({sql}) checked"
            CHECKS[name] = sql
        return fn

    return wrap
