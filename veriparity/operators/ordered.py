"""Ranks and running sums over groups of any size.

A window ``PARTITION BY group ORDER BY key`` puts a whole group into one task.
Here the rows are range-partitioned on (group, key) instead, so that a large
group spans many balanced slices; a running sum is then the sum within the
slice plus the totals of the group's earlier slices.  Those totals are one row
per slice and group, never the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriparity.session import cut_lineage

SLICE = "_slice"


def slice_by(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows cut into ascending slices of (by, order), with the slice number attached.

    ``by`` and ``order`` together should identify a row: equal keys cannot be
    split over slices.  The rows are written once because the slice borders come
    from a sample, and the totals and the rows must see the same borders.  Their
    number is left to the session: adaptive execution merges neighbouring slices
    that are small.
    """
    cut = df.repartitionByRange(*[F.col(c) for c in (*by, *order)])
    return cut_lineage(cut.withColumn(SLICE, F.spark_partition_id()))


def running_sums(
    sliced: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    measures: Mapping[str, Column],
    backward: bool = False,
) -> DataFrame:
    """Add inclusive running sums of ``measures`` to the output of ``slice_by``."""
    span = [*by, SLICE]
    turn = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
    inner = Window.partitionBy(*span).orderBy(*[turn(c) for c in order])
    inner = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy(turn(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*span).agg(*[F.sum(m).alias(f"_t_{n}") for n, m in measures.items()])
    offsets = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in span],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in measures],
    )
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col(SLICE) == F.col(f"_k_{SLICE}")]
    local = sliced.select("*", *[F.sum(m).over(inner).alias(f"_w_{n}") for n, m in measures.items()])
    joined = local.join(offsets, same, "inner")
    return joined.select(
        *[F.col(c) for c in sliced.columns],
        *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in measures],
    )


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """``row_number()`` within ``by`` in ascending ``order`` for groups of any size."""
    sliced = slice_by(df, by, order)
    return running_sums(sliced, by, order, {name: F.lit(1).cast("bigint")}).drop(SLICE)
