"""Do errors fall unevenly on the two groups?  Counts, G-test and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriparity.functions.significance import g_disparate, g_or_null, g_p_value
from veriparity.functions.values import percent, percent_text, ratio
from veriparity.operators.detectors import (
    IQR,
    MISSING,
    SD,
    any_flag,
    is_missing,
    number,
    outlier_bounds,
    outside,
    with_flags,
)
from veriparity.spec import DIS, PRIV, AuditSpec

COUNTS = ("n_priv", "dirty_priv", "n_dis", "dirty_dis")


def count_groups(grp: Column, dirty: Column, weight: Column | None = None) -> list[Column]:
    """The four counts of a 2x2 audit table as aggregates, each row counting ``weight`` times."""
    priv, dis = F.coalesce(grp == PRIV, F.lit(False)), F.coalesce(grp == DIS, F.lit(False))
    cells = (priv, priv & dirty, dis, dis & dirty)
    if weight is None:
        return [F.count_if(cell).alias(name) for cell, name in zip(cells, COUNTS)]
    return [F.coalesce(F.sum(F.when(cell, weight)), F.lit(0)).alias(name) for cell, name in zip(cells, COUNTS)]


def judge(counts: DataFrame) -> DataFrame:
    """Add shares in percent, the G statistic, its p-value and the verdict to audit counts."""
    cells = [F.col(c) for c in COUNTS]
    tested = counts.withColumn("g", g_or_null(*cells))
    return tested.select(
        *counts.columns,
        percent(F.col("dirty_priv"), F.col("n_priv")).alias("pct_priv"),
        percent(F.col("dirty_dis"), F.col("n_dis")).alias("pct_dis"),
        "g",
        g_p_value(F.col("g")).alias("p_value"),
        g_disparate(F.col("g")).alias("disparate"),
    )


def audit_flag(df: DataFrame, spec: AuditSpec, criteria: str, dirty: Column) -> DataFrame:
    """One judged row for one flag."""
    return judge(df.agg(*count_groups(spec.group(criteria), dirty)))


def audit_criteria(
    df: DataFrame,
    spec: AuditSpec,
    criteria: Sequence[str],
    columns: Mapping[str, Sequence[str]],
    nulls: str = "propagate",
    exact: bool = True,
) -> DataFrame:
    """One judged row per criterion and detector; a row is dirty when any of the detector's columns is flagged.

    All criteria and detectors are counted in one pass, per combination of groups and flags.
    """
    ready, found = with_flags(df, columns, nulls, exact)
    hits = [any_flag(by_column).alias(f"hit{i}") for i, by_column in enumerate(found.values())]
    groups = [spec.group(c).alias(f"grp{i}") for i, c in enumerate(criteria)]
    combined = ready.groupBy(*groups, *hits).agg(F.count(F.lit(1)).alias("n"))
    # one literal array, which no filter has to be inferred for
    cells = [
        F.struct(F.lit(c).alias("criteria"), F.col(f"grp{i}").alias("grp"), F.lit(d).alias("detector"), F.col(f"hit{j}").alias("dirty"))
        for i, c in enumerate(criteria)
        for j, d in enumerate(found)
    ]
    spread = combined.select("n", F.inline(F.array(*cells)))
    return judge(spread.groupBy("criteria", "detector").agg(*count_groups(F.col("grp"), F.col("dirty"), F.col("n"))))


def audit_detectors(
    df: DataFrame, spec: AuditSpec, criteria: str, columns: Mapping[str, Sequence[str]], **options: object
) -> DataFrame:
    """One judged row per detector under one criterion."""
    return audit_criteria(df, spec, [criteria], columns, **options).drop("criteria")


def audit_rows(
    df: DataFrame, spec: AuditSpec, criteria: str, columns: Sequence[str], detector: str, **options: object
) -> DataFrame:
    """One judged row for one detector over several columns."""
    return audit_detectors(df, spec, criteria, {detector: columns}, **options).drop("detector")


def listed_columns(spec: AuditSpec) -> dict[str, Sequence[str]]:
    """Missing values in any column, outliers in any numeric column by both rules."""
    columns: dict[str, Sequence[str]] = {MISSING: (*spec.categorical, *spec.numeric)}
    if spec.numeric:
        columns |= {SD: spec.numeric, IQR: spec.numeric}
    return columns


def audit_dataset(df: DataFrame, spec: AuditSpec, criteria: str, **options: object) -> DataFrame:
    """The detectors of ``listed_columns`` under one criterion."""
    return audit_detectors(df, spec, criteria, listed_columns(spec), **options)


def audit_marked(df: DataFrame, spec: AuditSpec, criteria: str, marked_ids: DataFrame) -> DataFrame:
    """One judged row for the rows whose id a tuple detector returned, once or more often."""
    ids = marked_ids.select(F.col(spec.id_col)).distinct().withColumn("_marked", F.lit(True))
    base = df.select(F.col(spec.id_col), spec.group(criteria).alias("_grp"))
    joined = base.join(ids, spec.id_col, "left")
    return judge(joined.agg(*count_groups(F.col("_grp"), F.coalesce(F.col("_marked"), F.lit(False)))))


def audit_matrix(
    df: DataFrame,
    spec: AuditSpec,
    criteria: Sequence[str],
    columns: Mapping[str, Sequence[str]],
    nulls: str = "propagate",
    exact: bool = True,
) -> DataFrame:
    """Judge every (criteria, detector, column) in one grouped pass.

    ``columns`` maps a column detector to the columns it looks at.  The rows are
    first counted per column and combination of groups and flags, so that only
    those few combinations are spread over criteria and detectors.  Result:
    ``criteria, detector, column``, the counts and the verdict.
    """
    numeric = list(dict.fromkeys(c for d in (SD, IQR) for c in columns.get(d, ())))
    names = list(dict.fromkeys(c for wanted in columns.values() for c in wanted))
    groups = [spec.group(c).alias(f"grp{i}") for i, c in enumerate(criteria)]

    def cell(name: str) -> Column:
        value = number(name) if name in numeric else F.lit(None).cast("double")
        return F.struct(F.lit(name).alias("column"), value.alias("value"), is_missing(df, name).alias("missing"))

    cells = df.select(*groups, F.inline(F.array(*[cell(c) for c in names])))
    hits = {MISSING: F.col("missing")} if MISSING in columns else {}
    outliers = [d for d in (SD, IQR) if d in columns]
    if outliers:
        sides = []
        for i, d in enumerate(outliers):
            for side in ("lo", "hi"):
                sides.append(F.max(F.when(F.col("detector") == d, F.col(side))).alias(f"{side}{i}"))
            hits[d] = outside(F.col("value"), F.col(f"lo{i}"), F.col(f"hi{i}"))
        bounds = outlier_bounds(df, numeric, outliers, nulls, exact).groupBy("column").agg(*sides)
        # one row per audited column
        cells = cells.join(F.broadcast(bounds), "column", "left")

    combination = ["column", *[f"grp{i}" for i in range(len(criteria))]]
    flag_columns = [hit.alias(f"hit{i}") for i, hit in enumerate(hits.values())]
    combined = cells.groupBy(*combination, *flag_columns).agg(F.count(F.lit(1)).alias("n"))
    per_criteria = [
        F.struct(F.lit(c).alias("criteria"), F.col(f"grp{i}").alias("grp")) for i, c in enumerate(criteria)
    ]
    per_detector = [
        F.struct(F.lit(d).alias("detector"), F.col(f"hit{i}").alias("dirty")) for i, d in enumerate(hits)
    ]
    wanted = [F.struct(F.lit(d), F.lit(c)) for d in hits for c in columns[d]]
    spread = combined.select("column", "n", F.array(*per_detector).alias("seen"), F.inline(F.array(*per_criteria)))
    spread = spread.select("column", "n", "criteria", "grp", F.inline("seen"))
    spread = spread.where(F.struct("detector", "column").isin(*wanted))
    return judge(
        spread.groupBy("criteria", "detector", "column").agg(
            *count_groups(F.col("grp"), F.col("dirty"), F.col("n"))
        )
    )


def disparate_report(judged: DataFrame) -> DataFrame:
    """Only the significant rows, with the two shares as report cells."""
    return judged.where("disparate").withColumns({
        "priv": percent_text(F.col("dirty_priv"), F.col("n_priv")),
        "dis": percent_text(F.col("dirty_dis"), F.col("n_dis")),
    })


def mislabel_polarities(flagged: DataFrame, spec: AuditSpec, criteria: Sequence[str]) -> DataFrame:
    """Of the rows flagged as mislabelled, how many carry the positive label per group of each criterion?

    The share with a negative label is the remainder.  ``priv_higher`` tells which
    group has the larger positive share; the G-test compares the two shares.  All
    criteria are counted in one pass; one without flagged rows has zeros.
    """
    groups = [spec.group(c).alias(f"grp{i}") for i, c in enumerate(criteria)]
    combined = flagged.groupBy(*groups, spec.label_column().alias("label")).agg(F.count(F.lit(1)).alias("n"))
    sides = [F.struct(F.lit(c).alias("criteria"), F.col(f"grp{i}").alias("grp")) for i, c in enumerate(criteria)]
    spread = combined.select("n", "label", F.inline(F.array(*sides)))
    named = flagged.sparkSession.createDataFrame([(c,) for c in criteria], "criteria string")
    counted = named.join(
        F.broadcast(spread.groupBy("criteria").agg(*count_groups(F.col("grp"), F.col("label"), F.col("n")))), "criteria", "left"
    ).fillna(0, list(COUNTS))
    judged = judge(counted)
    rate = {g: ratio(F.col(f"dirty_{g}"), F.col(f"n_{g}")) for g in (PRIV, DIS)}
    return judged.select(
        "criteria",
        F.col("n_priv").alias("flagged_priv"),
        F.col("dirty_priv").alias("positive_priv"),
        F.col("n_dis").alias("flagged_dis"),
        F.col("dirty_dis").alias("positive_dis"),
        rate[PRIV].alias("positive_share_priv"),
        rate[DIS].alias("positive_share_dis"),
        (1 - rate[PRIV]).alias("negative_share_priv"),
        (1 - rate[DIS]).alias("negative_share_dis"),
        F.coalesce(rate[PRIV] > rate[DIS], F.lit(False)).alias("priv_higher"),
        "g",
        "p_value",
        "disparate",
    )


def mislabel_polarity(flagged: DataFrame, spec: AuditSpec, criteria: str) -> DataFrame:
    """One row: the polarity under one criterion."""
    return mislabel_polarities(flagged, spec, [criteria]).drop("criteria")
