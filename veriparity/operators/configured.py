"""Run the listed audits of a dataset: one grouped pass for all column detectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriparity.operators.audit import audit_criteria, audit_marked, audit_matrix, listed_columns, mislabel_polarities, mislabel_polarity
from veriparity.operators.detectors import IQR, MISSING, SD
from veriparity.operators.forest import outliers_by_isolation
from veriparity.operators.models import mislabelled_by_model
from veriparity.operators.valuation import mislabelled_by_value
from veriparity.session import cut_lineage
from veriparity.sources.catalog import CASES, CONFIDENT, CONFIGURATIONS, FOREST, SHAPLEY
from veriparity.spec import AuditSpec

Configuration = tuple[str, str, str, Sequence[str]]

TUPLE_DETECTORS = {
    FOREST: lambda df, spec, seed, fold: outliers_by_isolation(df, spec, seed),
    CONFIDENT: lambda df, spec, seed, fold: mislabelled_by_model(df, spec, fold=fold),
    SHAPLEY: lambda df, spec, seed, fold: mislabelled_by_value(df, spec, seed),
}


def marked_ids(df: DataFrame, spec: AuditSpec, detector: str, seed: int = 42, fold: Column | None = None) -> DataFrame:
    """Ids of the rows a detector over whole rows flags, written once."""
    if detector not in TUPLE_DETECTORS:
        raise ValueError(f"Unsupported: {detector}")
    return cut_lineage(TUPLE_DETECTORS[detector](df, spec, seed, fold).select(F.col("id").alias(spec.id_col)))


def mislabel_audit(
    df: DataFrame, spec: AuditSpec, criteria: str, detector: str = CONFIDENT, seed: int = 42
) -> DataFrame:
    """Detect wrong labels and compare the groups' shares of wrongly positive ones."""
    flagged = df.join(marked_ids(df, spec, detector, seed), spec.id_col, "left_semi")
    return mislabel_polarity(flagged, spec, criteria)


Tables = Mapping[str, tuple[DataFrame, AuditSpec]]


def _over_cases(tables: Tables, cases: Sequence[tuple[str, str]], audit) -> DataFrame:
    """One report of ``audit(df, spec, criteria)``, asked once per table for all its criteria.

    A case without a table raises ``KeyError``.
    """
    if not cases:
        raise ValueError("no cases")
    parts = []
    for name in dict.fromkeys(name for name, _ in cases):
        df, spec = tables[name]
        criteria = list(dict.fromkeys(c for owner, c in cases if owner == name))
        parts.append(audit(df, spec, criteria).select(F.lit(name).alias("dataset"), "*"))
    return reduce(DataFrame.unionByName, parts)


def audit_cases(tables: Tables, cases: Sequence[tuple[str, str]] = CASES, **options: object) -> DataFrame:
    """The main report: per dataset and criterion, missing values and outliers by both rules.

    ``tables`` holds the rows and the roles of every dataset that ``cases`` names.
    Result: ``dataset, criteria, detector``, the counts and the verdict.
    """
    return _over_cases(
        tables, cases, lambda df, spec, criteria: audit_criteria(df, spec, criteria, listed_columns(spec), **options)
    )


def mislabel_cases(
    tables: Tables, cases: Sequence[tuple[str, str]] = CASES, detector: str = CONFIDENT, seed: int = 42,
    fold: Column | None = None,
) -> DataFrame:
    """Per dataset and criterion, the polarity of the labels that look wrong.

    The rows of a dataset are flagged once, whatever the number of its criteria; ``fold`` deals them out to the
    models of confident learning.
    """
    flagged = {
        name: tables[name][0].join(marked_ids(*tables[name], detector, seed, fold), tables[name][1].id_col, "left_semi")
        for name in dict.fromkeys(name for name, _ in cases)
    }
    marked = {name: (flagged[name], tables[name][1]) for name in flagged}
    return _over_cases(marked, cases, mislabel_polarities)


def run_configurations(
    df: DataFrame, spec: AuditSpec, configurations: Sequence[Configuration] = CONFIGURATIONS, seed: int = 42
) -> DataFrame:
    """``criteria, detector, column``, counts and verdict for each listed audit of the dataset.

    A detector over whole rows has ``*`` as its column and needs row ids.
    """
    mine = [c for c in configurations if c[0] == spec.name]
    if not mine:
        raise ValueError(f"Unsupported: {spec.name}")
    parts = []
    by_column = [(criteria, detector, columns) for _, criteria, detector, columns in mine if columns]
    if by_column:
        wanted: dict[str, list[str]] = {}
        for _, detector, columns in by_column:
            known = wanted.setdefault(detector, [])
            known += [c for c in columns if c not in known]
        ordered = {d: wanted[d] for d in (MISSING, SD, IQR) if d in wanted}
        matrix = audit_matrix(df, spec, list(dict.fromkeys(c for c, _, _ in by_column)), ordered)
        asked = [F.struct(F.lit(a), F.lit(d), F.lit(c)) for a, d, columns in by_column for c in columns]
        parts.append(matrix.where(F.struct("criteria", "detector", "column").isin(*asked)))
    for detector in TUPLE_DETECTORS:
        under = [criteria for _, criteria, name, _ in mine if name == detector]
        if under:
            marked = marked_ids(df, spec, detector, seed)
            for criteria in under:
                named = [F.lit(criteria).alias("criteria"), F.lit(detector).alias("detector"), F.lit("*").alias("column")]
                parts.append(audit_marked(df, spec, criteria, marked).select(*named, "*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
