"""Registry of the named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and widen integers so that two engines print the same values."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its checking SQL."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf), digits)
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def d(expr: str, name: str, digits: int = 6) -> str:
    """SQL for a rounded double column, the counterpart of ``tidy``."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def i(expr: str, name: str) -> str:
    """SQL for a 64-bit integer column."""
    return f"CAST({expr} AS BIGINT) AS {name}"


def check(name: str, sql: str) -> None:
    """Add the checking SQL of a query registered without one."""
    if name in ORACLES:
        raise ValueError(f"{name} already has its SQL")
    ORACLES[name] = sql.strip()
