"""Questions over the impact table: how often did cleaning help or hurt?

All of them aggregate one scan.  The "is there any cleaning approach" questions
select the distinct keys of the rows that qualify, which is what a self-join on
all keys would return.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriparity.functions.values import percent, ratio

# The outcomes of an impact test, worst first.
OUTCOMES = ("negative", "insignificant", "positive")
# Fixed value: impact rows per metric in the published table.
PUBLISHED_ROWS_PER_METRIC = 318.0


def _tally() -> Column:
    return F.count(F.lit(1)).alias("count")


def fairness_is(outcome: str) -> Column:
    return F.col("fairness_impact") == outcome


def accuracy_is(outcome: str) -> Column:
    return F.col("accuracy_impact") == outcome


def fairness_not_worse() -> Column:
    return F.col("fairness_impact") != "negative"


def accuracy_not_worse() -> Column:
    return F.col("accuracy_impact") != "negative"


def tally(
    impact: DataFrame,
    keys: Sequence[str | Column],
    where: Column | None = None,
    order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Rows per key, of those that satisfy ``where``, sorted by ``order`` (default: the keys)."""
    rows = impact if where is None else impact.where(where)
    out = rows.groupBy(*keys).agg(_tally())
    return out.orderBy(*(order or out.columns[:-1]))


def impact_counts(impact: DataFrame, by: Sequence[str] = ("error",)) -> DataFrame:
    """Rows per ``by``, fairness and accuracy outcome."""
    order = [*by, F.col("fairness_impact").desc(), F.col("accuracy_impact").desc()]
    return tally(impact, [*by, "fairness_impact", "accuracy_impact"], order=order)


def not_worse_counts(
    impact: DataFrame, by: Sequence[str], flag: Column, name: str
) -> DataFrame:
    """Rows per ``by`` and computed flag."""
    return tally(impact, [*by, flag.alias(name)], order=[*by, F.col(name).desc()])


def impact_matrix(impact: DataFrame) -> DataFrame:
    """Fairness x accuracy table per error, with margins, in counts and percent of the error's rows.

    ``all`` marks a margin.  Every cell of the table is present, empty ones as 0.
    """
    cells = impact.groupBy("error", "fairness_impact", "accuracy_impact").agg(_tally())
    wanted = [(f, a) for f in (*OUTCOMES, "all") for a in (*OUTCOMES, "all")]

    def within(fairness: str, accuracy: str) -> Column:
        met = [F.col(c) == o for c, o in (("fairness_impact", fairness), ("accuracy_impact", accuracy)) if o != "all"]
        return F.when(reduce(and_, met, F.lit(True)), F.col("count"))

    # a row per error from here: the counts of all cells side by side
    counted = [F.coalesce(F.sum(within(*w)), F.lit(0)).alias(f"_n{i}") for i, w in enumerate(wanted)]
    wide = cells.groupBy("error").agg(*counted)
    listed = [
        F.struct(F.lit(f).alias("fairness_impact"), F.lit(a).alias("accuracy_impact"), F.col(f"_n{i}").alias("count"))
        for i, (f, a) in enumerate(wanted)
    ]
    full = wide.select("error", F.col(f"_n{len(wanted) - 1}").alias("total"), F.inline(F.array(*listed)))
    return full.select(
        "error", "fairness_impact", "accuracy_impact", "count", percent(F.col("count"), F.col("total")).alias("pct")
    )


def metric_share(
    impact: DataFrame, rows_per_metric: float | None = None
) -> DataFrame:
    """Rows per metric and fairness outcome, and their share of the metric's rows.

    ``rows_per_metric`` takes the share of a given number instead, such as
    ``PUBLISHED_ROWS_PER_METRIC`` for the published table.
    """
    counted = impact.groupBy("metric", "fairness_impact").agg(_tally())
    if rows_per_metric is not None:
        out = counted.withColumn("perc", F.col("count") / F.lit(float(rows_per_metric)))
    else:
        totals = counted.groupBy("metric").agg(F.sum("count").alias("_total"))
        out = counted.join(totals, "metric").withColumn("perc", ratio(F.col("count"), F.col("_total"))).drop("_total")
    return out.orderBy("metric", "fairness_impact")


def keys_with(
    impact: DataFrame, keys: Sequence[str], found: Column, constant: str | None = None, ordered: bool = True
) -> DataFrame:
    """Distinct ``keys`` for which at least one row satisfies ``found``; a NULL key equals nothing and has none.

    ``constant`` adds a TRUE column of that name.
    """
    hits = impact.where(found).select(*keys).dropna().distinct()
    if ordered:
        hits = hits.orderBy(*keys)
    return hits if constant is None else hits.select("*", F.lit(True).alias(constant))
