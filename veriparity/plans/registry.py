"""Registered queries and the SQL that states the same result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DECIMALS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its check statement if SQL can express it."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Round floating columns for comparison between engines; the sum turns -0.0 into 0.0."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        (F.round(F.col(c), DECIMALS) + F.lit(0.0)).alias(c) if c in floating else F.col(c) for c in df.columns
    ])


def r(expression: str) -> str:
    """The same rounding in a check statement."""
    return f"round({expression}, {DECIMALS}) + 0.0"
