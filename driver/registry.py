"""A query is a Spark function, a result shape and, where plain SQL can express it, a statement.

The shape casts and rounds both results the same way, so that they compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    shape: dict[str, str]
    sql: str | None = None

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(spark, folder).select(*[_spark_cast(name, kind) for name, kind in self.shape.items()])

    def oracle(self) -> str:
        columns = ", ".join(_sql_cast(name, kind) for name, kind in self.shape.items())
        return f"SELECT {columns} FROM (\n{self.sql}\n) AS result"


def shape(**kinds: str) -> dict[str, str]:
    """Column names by kind: `i` integer, `s` text, `b` boolean, `f4`/`f6` rounded double."""
    return {name: kind for kind, names in kinds.items() for name in names.split()}


def _spark_cast(name: str, kind: str) -> Column:
    value = F.col(name)
    if kind == "i":
        return value.cast("long").alias(name)
    if kind == "b":
        return value.cast("boolean").alias(name)
    if kind == "s":
        return value.cast("string").alias(name)
    return (F.round(value.cast("double"), int(kind[1:])) + F.lit(0.0)).alias(name)


def _sql_cast(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "b":
        return f"CAST({name} AS BOOLEAN) AS {name}"
    if kind == "s":
        return f"CAST({name} AS VARCHAR) AS {name}"
    return f"round(CAST({name} AS DOUBLE), {kind[1:]}) + 0.0 AS {name}"
