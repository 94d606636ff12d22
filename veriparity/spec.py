"""Roles of an audited table: identity, label, groups and feature columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriparity.functions.values import col, null_if_nan

PRIV, DIS = "priv", "dis"


@dataclass(frozen=True)
class Equals:
    """Privileged when the column has the value; a missing value is disadvantaged."""

    column: str
    value: object

    def group(self) -> Column:
        return F.when(col(self.column).eqNullSafe(F.lit(self.value)), PRIV).otherwise(DIS)


@dataclass(frozen=True)
class Above:
    """Privileged above the threshold; a missing value (or NaN) belongs to neither group."""

    column: str
    threshold: float

    def group(self) -> Column:
        value = null_if_nan(col(self.column).cast("double"))
        return F.when(value > self.threshold, PRIV).when(value <= self.threshold, DIS)


@dataclass(frozen=True)
class LabelIn:
    """TRUE for the listed values; missing is FALSE."""

    column: str
    values: tuple

    def label(self) -> Column:
        return F.coalesce(col(self.column).isin(list(self.values)), F.lit(False))


@dataclass(frozen=True)
class LabelAtLeast:
    """TRUE from the threshold on; missing (or NaN) is FALSE."""

    column: str
    threshold: float

    def label(self) -> Column:
        value = null_if_nan(col(self.column).cast("double"))
        return F.coalesce(value >= self.threshold, F.lit(False))


@dataclass(frozen=True)
class LabelNot:
    """TRUE for anything but the value; missing is TRUE."""

    column: str
    value: object

    def label(self) -> Column:
        return ~col(self.column).eqNullSafe(F.lit(self.value))


@dataclass(frozen=True)
class AuditSpec:
    name: str
    label: LabelIn | LabelAtLeast | LabelNot
    groups: Mapping[str, Equals | Above]
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    not_for_prediction: tuple[str, ...] = ()
    listed_criteria: tuple[str, ...] = ()
    id_col: str = "row_id"
    extra: Mapping[str, object] = field(default_factory=dict)

    @property
    def numeric_for_prediction(self) -> tuple[str, ...]:
        return tuple(c for c in self.numeric if c not in self.not_for_prediction)

    @property
    def categorical_for_prediction(self) -> tuple[str, ...]:
        return tuple(c for c in self.categorical if c not in self.not_for_prediction)

    @property
    def demographic_criteria(self) -> tuple[str, ...]:
        return self.listed_criteria or tuple(self.groups)

    def group(self, criteria: str) -> Column:
        """``priv``, ``dis`` or NULL under a criterion; unknown criteria are refused."""
        if criteria not in self.groups:
            raise ValueError(f"Unsupported: {criteria}")
        return self.groups[criteria].group()

    def label_column(self) -> Column:
        return self.label.label()

    def partition_by(self, df: DataFrame, criteria: str) -> DataFrame:
        """``df`` with its group in column ``grp``; rows of neither group are left out."""
        return df.withColumn("grp", self.group(criteria)).where(F.col("grp").isNotNull())
