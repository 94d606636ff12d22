"""Confusion counts, accuracy, ROC-AUC and causal-impact summaries by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriparity.functions.fairness import fairness_gap, wide_counts
from veriparity.functions.values import ratio
from veriparity.operators.ordered import SLICE, running_sums, slice_by
from veriparity.spec import DIS, PRIV


def confusion_counts(truth: Column, predicted: Column, among: Column | None = None, suffix: str = "") -> list[Column]:
    """``tn, fp, fn, tp`` as aggregates; a class that does not occur counts 0."""
    among = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    cells = {
        "tn": ~truth & ~predicted,
        "fp": ~truth & predicted,
        "fn": truth & ~predicted,
        "tp": truth & predicted,
    }
    return [F.count_if(among & hit).alias(f"{name}{suffix}") for name, hit in cells.items()]


def group_confusion(df: DataFrame, grp: str, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per ``by`` and group with its confusion counts."""
    rows = df.where(F.col(grp).isNotNull())
    return rows.groupBy(*by, grp).agg(*confusion_counts(F.col(truth), F.col(predicted)))


def wide_confusion(
    df: DataFrame, grp: str, truth: str, predicted: str, by: Sequence[str] = (), dis: str = "dis"
) -> DataFrame:
    """One row per ``by`` with ``{cell}_priv`` and ``{cell}_{dis}`` columns."""
    truth, predicted = F.col(truth), F.col(predicted)
    return df.groupBy(*by).agg(
        *confusion_counts(truth, predicted, F.col(grp) == PRIV, "_priv"),
        *confusion_counts(truth, predicted, F.col(grp) == DIS, f"_{dis}"),
    )


def accuracy_and_auc(df: DataFrame, by: Sequence[str], truth: str, predicted: str, score: str) -> DataFrame:
    """Accuracy and exact ROC-AUC per ``by`` group, ties counting one half.

    The rows are first counted per score.  For the area, each score needs the
    negatives below it; they come from running sums over slices, so neither a
    group nor the distinct scores have to fit one task.
    """
    truth_flag = F.col(truth).cast("int")
    keys = list(by)
    per_score = df.groupBy(*keys, F.col(score).alias("_score")).agg(
        F.sum(truth_flag).cast("bigint").alias("_pos"),
        F.sum(1 - truth_flag).cast("bigint").alias("_neg"),
        F.count_if(F.col(truth) == F.col(predicted)).alias("_right"),
    )
    sliced = slice_by(per_score, keys, ["_score"])
    below = running_sums(sliced, keys, ["_score"], {"_neg_to_here": F.col("_neg")}).drop(SLICE)
    wins = F.col("_pos") * (F.col("_neg_to_here") - F.col("_neg") + F.col("_neg") / 2)
    summed = below.groupBy(*keys).agg(
        F.sum(F.col("_pos") + F.col("_neg")).alias("n"),
        F.sum("_right").alias("_right"),
        F.sum("_pos").alias("_pos"),
        F.sum("_neg").alias("_neg"),
        F.sum(wins).alias("_wins"),
    )
    return summed.select(
        *keys,
        "n",
        ratio(F.col("_right"), F.col("n")).alias("accuracy"),
        ratio(F.col("_wins"), F.col("_pos") * F.col("_neg")).alias("auc"),
    )


def causal_impact(frame: DataFrame, metric: str, keep: Sequence[str] = ()) -> DataFrame:
    """Per experiment: gap before and after cleaning, and what cleaning is responsible for.

    ``frame`` has ``{orig,clean}_{tp,fp,tn,fn}_{priv,nonpriv}`` and
    ``{orig,clean}_{accuracy,auc}``.  An experiment is applicable when the
    original gap is positive and unfair when cleaning also lowered it; only then
    the responsibility (share of the gap removed, the cleaned gap floored at 0)
    and the differences in accuracy and AUC are given.
    """
    orig = fairness_gap(metric, wide_counts("orig_", dis="nonpriv"))
    clean = fairness_gap(metric, wide_counts("clean_", dis="nonpriv"))
    scores = [f"{side}_{name}" for name in ("accuracy", "auc") for side in ("orig", "clean")]
    gaps = frame.select(*keep, *scores, orig.alias("orig_gap"), clean.alias("clean_gap"))
    applicable = F.coalesce(F.col("orig_gap") > 0, F.lit(False))
    unfair = applicable & F.coalesce(F.col("orig_gap") > F.col("clean_gap"), F.lit(False))
    left = F.greatest(F.col("clean_gap"), F.lit(0.0))
    return gaps.select(
        *keep,
        "orig_gap",
        "clean_gap",
        applicable.alias("applicable"),
        unfair.alias("unfair"),
        F.when(unfair, ratio(F.col("orig_gap") - left, F.col("orig_gap"))).alias("responsibility"),
        F.when(unfair, F.col("clean_accuracy") - F.col("orig_accuracy")).alias("accuracy_change"),
        F.when(unfair, F.col("clean_auc") - F.col("orig_auc")).alias("auc_change"),
    )


def causal_summary(impacts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and means over the output of ``causal_impact``."""
    return impacts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("unfair")).alias("n_unfair"),
        F.count_if(F.col("applicable")).alias("n_applicable"),
        F.avg("responsibility").alias("mean_responsibility"),
        F.avg("accuracy_change").alias("mean_accuracy_change"),
        F.avg("auc_change").alias("mean_auc_change"),
    )
