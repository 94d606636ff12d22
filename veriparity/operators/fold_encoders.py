"""Feature encoders of every training part of a cross-validation, from one pass over the rows.

For each fold an encoder is wanted that has not seen it.  The rows are counted
once per fold -- moments of numbers, counts of categories -- and the encoder
without a fold is the sum over the others, so k folds cost what one costs and no
fold leaks into the features of its own evaluation.

Numbers are imputed by the mean and standardised by the population deviation of
the imputed column; a constant or empty column becomes 0.  A category that the
training part does not have is a zero block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriparity.functions.values import col, ratio
from veriparity.operators.detectors import number
from veriparity.operators.features import category

EVERY = -1  # the fold that no row belongs to: its encoder and its model have seen all rows


def fold_moments(rows: DataFrame, numbers: int) -> DataFrame:
    """One row per fold: ``fold, rows`` and count, mean and population variance of each number."""
    stats = []
    for i in range(numbers):
        c = F.col(f"num{i}")
        stats += [F.count(c).alias(f"count{i}"), F.avg(c).alias(f"mean{i}"), F.var_pop(c).alias(f"var{i}")]
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), *stats)


def fold_categories(rows: DataFrame, categories: int) -> DataFrame:
    """``i, value, fold, n``: rows of each fold with each value of categorical column i."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"cat{i}").alias("value")) for i in range(categories)])
    return rows.select("fold", F.inline(cells)).groupBy("i", "value", "fold").agg(F.count(F.lit(1)).alias("n"))


def training_stats(moments: DataFrame, numbers: int, folds: int) -> DataFrame:
    """``left_out``, ``all_rows`` and mean and deviation of each number over the other folds; a row for ``EVERY`` as well.

    Moments are merged, not subtracted, which keeps small variances beside large means.
    """
    encoders = F.filter(F.array(*[F.lit(f) for f in (EVERY, *range(folds))]), lambda f: f != F.col("fold"))
    merged = moments.select("*", F.explode(encoders).alias("left_out"))  # as many rows as pairs of folds
    means = []
    for i in range(numbers):
        n, mean = F.col(f"count{i}"), F.col(f"mean{i}")
        means.append(ratio(F.sum(n * F.coalesce(mean, F.lit(0.0))), F.sum(n)).alias(f"m{i}"))
    centred = merged.groupBy("left_out").agg(F.sum("rows").alias("all_rows"), *means)
    again = merged.join(centred, "left_out")
    spreads = []
    for i in range(numbers):
        n, off = F.col(f"count{i}"), F.col(f"mean{i}") - F.col(f"m{i}")
        squares = F.sum(F.when(n > 0, n * (F.col(f"var{i}") + off * off)).otherwise(0.0))
        spreads += [F.first(f"m{i}").alias(f"m{i}"), F.sqrt(ratio(squares, F.first("all_rows"))).alias(f"s{i}")]
    return again.groupBy("left_out").agg(F.first("all_rows").alias("all_rows"), *spreads)


def encode_by_fold(
    df: DataFrame, id_col: str, numeric: Sequence[str], categorical: Sequence[str], fold: Column, folds: int
) -> DataFrame:
    """``id, fold, feature, value``: every row under the encoder that has not seen the row's fold.

    Zeros of categories are left out, so a category that only the row's own fold has is absent.  The category
    counts are a table that is joined, whatever their number.
    """
    rows = df.select(
        col(id_col).alias("id"), fold.cast("int").alias("fold"),
        *[number(c).alias(f"num{i}") for i, c in enumerate(numeric)],
        *[category(c).alias(f"cat{i}") for i, c in enumerate(categorical)],
    )
    out = []
    if numeric:
        stats = training_stats(fold_moments(rows, len(numeric)), len(numeric), folds).withColumnRenamed("left_out", "fold")
        cells = []
        for i, c in enumerate(numeric):
            mean, value = F.col(f"m{i}"), F.col(f"num{i}")
            scaled = F.coalesce(ratio(F.coalesce(value, mean) - mean, F.col(f"s{i}")), F.lit(0.0))
            cells.append(F.struct(F.lit(c).alias("feature"), scaled.alias("value")))
        out.append(rows.join(F.broadcast(stats), "fold").select("id", "fold", F.inline(F.array(*cells))))
    if categorical:
        counts = fold_categories(rows, len(categorical))
        totals = counts.groupBy("i", "value").agg(F.sum("n").alias("total"))
        elsewhere = counts.join(totals, ["i", "value"]).where(F.col("total") > F.col("n")).select("i", "value", "fold")
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"cat{i}").alias("value")) for i in range(len(categorical))])
        named = F.concat(F.element_at(F.array(*[F.lit(c) for c in categorical]), F.col("i") + 1), F.lit("="), F.col("value"))
        seen = rows.select("id", "fold", F.inline(cells)).join(elsewhere, ["i", "value", "fold"], "left_semi")
        out.append(seen.select("id", "fold", named.alias("feature"), F.lit(1.0).alias("value")))
    return out[0] if len(out) == 1 else out[0].unionAll(out[1])


@dataclass(frozen=True)
class Encoders:
    """Encoders in memory, for models few features wide: the fold each leaves out, its numbers and its categories."""

    folds: tuple[int, ...]
    rows: np.ndarray  # training rows by encoder
    means: np.ndarray  # by encoder and number
    deviations: np.ndarray
    categories: tuple[tuple[str, ...], ...]
    seen: np.ndarray  # by encoder and category
    names: tuple[str, ...]

    @property
    def width(self) -> int:
        return 1 + len(self.names)

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (NaN if missing) and the place of the category of each column (-1 if no encoder has it)."""
        numbers = np.full((batch.num_rows, self.means.shape[1]), np.nan)
        for i in range(numbers.shape[1]):
            numbers[:, i] = batch[f"num{i}"].to_numpy(zero_copy_only=False)
        places, first = np.full((batch.num_rows, len(self.categories)), -1), 0
        for i, values in enumerate(self.categories):
            found = pa.compute.index_in(batch[f"cat{i}"], pa.array(values, pa.string()))
            places[:, i] = found.fill_null(-first - 1).to_numpy() + first
            first += len(values)
        return numbers, places

    def matrix(self, read: tuple[np.ndarray, np.ndarray], encoder: int) -> np.ndarray:
        """Rows as features: 1, the numbers, one column per category."""
        numbers, places = read
        out = np.zeros((len(numbers), self.width))
        out[:, 0] = 1
        spread = self.deviations[encoder]
        with np.errstate(invalid="ignore", divide="ignore"):
            scaled = (numbers - self.means[encoder]) / spread
        out[:, 1 : 1 + numbers.shape[1]] = np.where(np.isnan(numbers) | ~(spread > 0), 0, scaled)
        row, column = np.nonzero(places >= 0)
        at = places[row, column]
        known = self.seen[encoder][at]
        out[row[known], 1 + numbers.shape[1] + at[known]] = 1
        return out


def encoders_of(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], folds: int, most: int) -> Encoders:
    """The encoders of ``rows`` (from ``feature_input``, with ``fold``); more than ``most`` features raise."""
    stats = [r.asDict() for r in training_stats(fold_moments(rows, len(numeric)), len(numeric), folds).collect()]  # folds + 1 rows
    stats.sort(key=lambda r: r["left_out"])
    folds = tuple(r["left_out"] for r in stats)
    counted: list = []
    if categorical:
        counts = fold_categories(rows, len(categorical))
        width = counts.select("i", "value").distinct().count() + len(numeric)
        if width > most:
            raise ValueError(f"{width} features are too many for exact steps (at most {most}); use the other solver")
        counted = counts.collect()  # at most ``most`` values times the folds
    categories = tuple(tuple(sorted({r["value"] for r in counted if r["i"] == i})) for i in range(len(categorical)))
    place = {(i, v): k for k, (i, v) in enumerate((i, v) for i, values in enumerate(categories) for v in values)}
    inside = np.zeros((len(folds), len(place)), np.int64)
    for r in counted:
        for e, left_out in enumerate(folds):
            if r["fold"] != left_out:
                inside[e, place[r["i"], r["value"]]] += r["n"]
    table = lambda name: np.array([[r[f"{name}{i}"] or 0.0 for i in range(len(numeric))] for r in stats]).reshape(len(stats), len(numeric))
    names = (*numeric, *(f"{c}={v}" for c, values in zip(categorical, categories, strict=True) for v in values))
    return Encoders(folds, np.array([r["all_rows"] for r in stats]), table("m"), table("s"), categories, inside > 0, names)
