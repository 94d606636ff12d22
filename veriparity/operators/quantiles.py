"""Exact order statistics and percentiles without sorting or collecting a column.

The built-in exact percentile merges a map of all distinct values in one task.
Here four scans narrow the position of each wanted rank:

1. count the values in cells of a 64th of an octave and pick the cell of the rank,
2. three times, count again in 65 536 even steps between the smallest and largest
   value of that cell and pick the step of the rank.

A cell of the first scan spans fewer than 2**46 different doubles, so a step of
the last one holds a single value whatever the distribution.  Every scan
aggregates before it shuffles: what moves is at most one row per cell and task, and
the cells of a scan are bounded by its resolution, not by the data.  A value held
by a third of all rows is one cell with a large count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriparity.functions.values import null_if_nan

CELLS_PER_OCTAVE = 64
LEAST_EXPONENT = -1075  # below that of the smallest double
STEPS = 1 << 16
NARROWINGS = 3


def _with_position(counted: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows before each cell, in cell order; the cells per key are bounded."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _holds(rank: Column) -> Column:
    return (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))


def order_statistics(
    df: DataFrame, by: Sequence[str], value: str, targets: Callable[[DataFrame], DataFrame], few_groups: bool = True
) -> DataFrame:
    """The values at wanted 0-based ranks (ascending) within each ``by`` group.

    ``targets`` receives rows with the ``by`` columns, ``total`` and ``missing``,
    the numbers of present and missing values of the group, and adds to each row
    one row per wanted rank: ``target`` (a number telling the ranks apart),
    ``rank`` and any columns to carry along.  ``few_groups`` says that the number
    of groups does not grow with the data (columns, classes): one row per wanted
    rank is then broadcast, else joined by a shuffle.  Result: ``by``, ``target``,
    the carried columns and ``value``.
    """
    by = list(by)
    rows = df.select(*by, null_if_nan(F.col(value).cast("double")).alias("_v"))

    octave = F.log2(F.abs("_v")) - LEAST_EXPONENT
    infinite = F.abs(F.col("_v")) == float("inf")
    cell = F.when(F.col("_v") == 0, F.lit(0)).otherwise(
        F.signum("_v").cast("int") * (1 + F.when(infinite, F.lit(1 << 30)).otherwise(F.floor(octave * CELLS_PER_OCTAVE)))
    )
    spread = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    # missing values share one cell, which sorts first
    grid = rows.groupBy(*by, cell.alias("_cell")).agg(*spread)
    whole, present = Window.partitionBy(*by), F.col("_cell").isNotNull()
    grid = grid.select(
        "*",
        F.coalesce(F.sum(F.when(present, F.col("_n"))).over(whole), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(~present, F.col("_n"))).over(whole), F.lit(0)).alias("missing"),
    )
    wanted = targets(_with_position(grid.where(present), by, "_cell"))
    grid_columns = (*grid.columns, "_before", "rank")
    keys = [c for c in wanted.columns if c in by or c not in grid_columns]
    narrowed = (F.col("_rank") - F.col("_before")).alias("_rank")
    bracket = wanted.withColumn("_rank", F.col("rank").cast("bigint")).where(_holds(F.col("_rank")))
    bracket = bracket.select(*keys, "_lo", "_hi", narrowed)

    def within(found: DataFrame) -> DataFrame:
        small = F.broadcast(found) if few_groups else found
        return rows.join(small, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    width = F.col("_hi") - F.col("_lo")
    step = F.when(F.col("_lo") == F.col("_hi"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_lo")) / width * STEPS), F.lit(STEPS - 1))
    )
    for _ in range(NARROWINGS):
        finer = within(bracket).groupBy(*keys, F.col("_rank"), step.alias("_cell")).agg(*spread)
        bracket = _with_position(finer, keys, "_cell").where(_holds(F.col("_rank")))
        bracket = bracket.select(*keys, "_lo", "_hi", narrowed)
    return bracket.select(*keys, F.col("_lo").alias("value"))


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated percentiles, one column ``q0``, ``q1``, ... per probability.

    Missing values are skipped; ``n_missing`` tells how many there were.  The two
    neighbours of each position are found exactly and interpolated from the
    nearer one.  A group without any value has no row.
    """

    def targets(cells: DataFrame) -> DataFrame:
        wanted = []
        for i, p in enumerate(probs):
            place = (F.col("total") - 1) * F.lit(float(p))
            for side, edge in enumerate((F.floor(place), F.ceil(place))):
                wanted.append(
                    F.struct(
                        F.lit(2 * i + side).alias("target"),
                        edge.cast("bigint").alias("rank"),
                        (place - F.floor(place)).alias("_fraction"),
                    )
                )
        return cells.select("*", F.col("missing").alias("n_missing"), F.inline(F.array(*wanted)))

    found = order_statistics(df, by, value, targets)
    sides = [F.max(F.when(F.col("target") == t, F.col("value"))).alias(f"_s{t}") for t in range(2 * len(probs))]
    parts = [F.max(F.when(F.col("target") == 2 * i, F.col("_fraction"))).alias(f"_p{i}") for i in range(len(probs))]

    def between(i: int) -> Column:
        low, high, part = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}"), F.col(f"_p{i}")
        return F.when(part >= 0.5, high - (high - low) * (1 - part)).otherwise(low + (high - low) * part)

    wide = found.groupBy(*by, "n_missing").agg(*sides, *parts)
    return wide.select(*by, "n_missing", *[between(i).alias(f"q{i}") for i in range(len(probs))])
