"""What the query modules share: registration, literal tables that both engines read, rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.store import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query of its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, rows: str) -> DataFrame:
    """A literal table: ``(VALUES ...) AS t(...)``."""
    return spark.sql(f"SELECT * FROM {rows.replace('TIMESTAMP ', 'TIMESTAMP_NTZ ')}")


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def round_scaled(name: str, digits: int) -> Column:
    """A double rounded as the SQL rounds it, after scaling; ``F.round`` rounds its shortest decimal, so ties may differ (11.50035).

    A zero keeps its sign, as it does there.
    """
    x, by = F.col(name), 10.0**digits
    near = F.round(x * by) / by
    return F.when(near == 0, x * 0.0).when(F.abs(x * by) < float("inf"), near).otherwise(x)


def rounded(df: DataFrame, digits: int = 4, how: Callable[[str, int], Column] = F.round) -> DataFrame:
    return df.select(*[how(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


__all__ = ["QUERIES", "SQL", "at", "load", "query", "round_scaled", "rounded", "values"]
