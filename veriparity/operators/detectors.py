"""Column error detectors as flags on the audited rows.

A detector never makes a second table: missing values and outliers become
boolean columns, so one pass over the data serves all columns and detectors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriparity.functions.values import col, null_if_nan
from veriparity.operators.quantiles import exact_percentiles

MISSING, SD, IQR = "missing-values", "outliers-sd", "outliers-iqr"

# Reach of the two outlier rules.
SD_REACH = 3.0
IQR_REACH = 1.5
SKETCH_ACCURACY = 100_000


def number(name: str) -> Column:
    return null_if_nan(col(name).cast("double"))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    floating = df.schema[name].dataType.simpleString() in ("double", "float")
    return col(name).isNull() | F.isnan(col(name)) if floating else col(name).isNull()


def long_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """One row per input row and column: ``column``, ``value``."""
    cells = [F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*cells)))


def outlier_bounds(
    df: DataFrame,
    columns: Sequence[str],
    detectors: Sequence[str] = (SD, IQR),
    nulls: str = "propagate",
    exact: bool = True,
) -> DataFrame:
    """Lower and upper limit per column: ``column, detector, lo, hi``.

    A column without limits (no values at all) may have no row.

    Limits use population deviation and linear-interpolated quartiles.  With
    ``nulls="propagate"`` a column that holds a missing value has no quartiles,
    so nothing in it is an IQR outlier; ``nulls="skip"`` ignores missing values.
    ``exact=False`` takes the quartiles from a sketch in the same single scan.
    """
    if nulls not in ("propagate", "skip"):
        raise ValueError(f"Unsupported: {nulls}")
    if not columns:
        raise ValueError("no columns to audit")
    cells = long_numbers(df, columns)
    stats = None
    if SD in detectors or not exact:
        moments = [F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")]
        if IQR in detectors and not exact:
            moments.append(F.count_if(F.col("value").isNull()).alias("n_missing"))
            moments.append(F.percentile_approx("value", [0.25, 0.75], SKETCH_ACCURACY).alias("quartiles"))
        stats = cells.groupBy("column").agg(*moments)
    if IQR in detectors and exact:
        quartiles = exact_percentiles(cells, ["column"], "value", (0.25, 0.75))
        stats = quartiles if stats is None else stats.join(quartiles, "column", "left")
    elif IQR in detectors:
        stats = stats.withColumn("q0", F.col("quartiles")[0]).withColumn("q1", F.col("quartiles")[1])

    limits = []
    if SD in detectors:
        reach = SD_REACH * F.col("sd")
        limits.append((SD, F.col("mean") - reach, F.col("mean") + reach))
    if IQR in detectors:
        usable = F.lit(True) if nulls == "skip" else F.col("n_missing") == 0
        span = IQR_REACH * (F.col("q1") - F.col("q0"))
        limits.append((IQR, F.when(usable, F.col("q0") - span), F.when(usable, F.col("q1") + span)))
    # infinite values can make a limit NaN, which Spark would order above every value
    rows = [
        F.struct(F.lit(d).alias("detector"), null_if_nan(lo).alias("lo"), null_if_nan(hi).alias("hi"))
        for d, lo, hi in limits
    ]
    return stats.select("column", F.inline(F.array(*rows)))


def outside(value: Column, lo: Column, hi: Column) -> Column:
    """Strictly outside; FALSE for a missing value or a missing limit."""
    return F.coalesce((value > hi) | (value < lo), F.lit(False))


def with_flags(
    df: DataFrame, columns: Mapping[str, Sequence[str]], nulls: str = "propagate", exact: bool = True
) -> tuple[DataFrame, dict[str, dict[str, Column]]]:
    """``df`` with what the flags need, and per detector one flag expression per column.

    ``columns`` maps detectors to the columns they look at.  All limits are one
    row from a scalar subquery, attached as struct ``_limits``, so the data is
    not shuffled.
    """
    unknown = [d for d in columns if d not in (MISSING, SD, IQR)]
    if unknown:
        raise ValueError(f"Unsupported: {unknown[0]}")
    found: dict[str, dict[str, Column]] = {}
    fields, audited = [], []
    for detector, names in columns.items():
        if detector == MISSING:
            found[detector] = {c: is_missing(df, c) for c in names}
            continue
        found[detector] = {}
        for c in names:
            lo, hi = f"lo{len(fields)}", f"hi{len(fields)}"
            mine = (F.col("detector") == detector) & (F.col("column") == c)
            fields += [F.max(F.when(mine, F.col("lo"))).alias(lo), F.max(F.when(mine, F.col("hi"))).alias(hi)]
            found[detector][c] = outside(number(c), F.col(f"_limits.{lo}"), F.col(f"_limits.{hi}"))
            audited += [c] if c not in audited else []
    if not fields:
        return df, found
    bounds = outlier_bounds(df, audited, [d for d in columns if d != MISSING], nulls, exact)
    limits = bounds.agg(*fields).select(F.struct("*").alias("limits")).scalar()
    return df.select("*", limits.alias("_limits")), found


def any_flag(by_column: dict[str, Column]) -> Column:
    """TRUE when any column is flagged: the distinct union of the per-column slices."""
    return reduce(lambda a, b: a | b, by_column.values())


def dirty_rows(df: DataFrame, columns: Sequence[str], detector: str, **options: object) -> DataFrame:
    """The flagged rows themselves, each once."""
    ready, found = with_flags(df, {detector: columns}, **options)
    return ready.where(any_flag(found[detector])).select(*[col(c) for c in df.columns])
