"""Quantiles by mergeable sketches (KLL), for data that keeps arriving.

A sketch has a bounded size whatever the rows behind it, and two sketches merge
into the sketch of both, so a table of sketches per column and group answers for
all data so far without reading the old rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriparity.functions.values import col
from veriparity.operators.detectors import long_numbers

SKETCH_K = 800  # size of a sketch; the rank of a quantile is off by less than RANK_ERROR of the rows
RANK_ERROR = 0.01


def column_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """``by, column, n, n_missing, sketch``: one scan for all columns and groups; NaN is a missing value."""
    cells = long_numbers(df, columns, by)
    return cells.groupBy(*by, "column").agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.kll_sketch_agg_double("value", k).alias("sketch"),
    )


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One sketch per group and column of tables of sketches that were put together."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The sketches with one column ``q0``, ``q1``, ... per probability; NULL where there is no value."""
    found = [
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(f"q{i}") for i, p in enumerate(probs)
    ]
    return sketches.select(*[col(c) for c in sketches.columns if c != "sketch"], *found)
