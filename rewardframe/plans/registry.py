"""Registered queries: each one a Spark plan over the driver's tables, with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``. Column names and types
agree on both sides; doubles are rounded to 6 places and arrays rendered as text so that value
hashes compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardframe.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__ = run.__qualname__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def join_doubles(c) -> F.Column:
    """Array of doubles as comma text, each rounded to 6 places."""
    return F.array_join(F.transform(c, lambda x: F.round(x, 6).cast("string")), ",")


# Import the modules that register queries (order only affects listing).
from rewardframe.plans import q_data, q_code, q_io, q_reward, q_verify  # noqa: E402,F401
