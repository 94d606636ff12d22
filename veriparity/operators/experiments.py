"""From experiment results to the impact table.

Experiments are rows of ``dataset, pos, experiment, metrics``: ``pos`` orders the
experiments of a dataset, ``experiment`` is the slash-separated key and
``metrics`` a map from metric name to number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from veriparity.functions.fairness import CELLS, GROUPS, fairness_gap, map_counts, wide_counts
from veriparity.functions.significance import ALPHA, impact_verdict, paired_p, paired_t
from veriparity.operators.ordered import ranked
from veriparity.session import cut_lineage

# Vocabulary of the experiment keys and result files.
ERRORS = ("outliers", "missing_values", "mislabel")
MODELS = ("logistic_regression", "knn_classification", "XGBoost")
IMPACT_METRICS = ("equal_opportunity", "predictive_parity")
DIRTY, DELETED, DUMMY_MEAN, CLEAN = "dirty", "delete", "impute_mean_dummy", "clean"

# Dataset, criterion as spelled in the result files, and whether the
# undesired class is the one of interest.
CASES = (
    ("adult", "sex", False),
    ("adult", "race", False),
    ("folktables", "sex", False),
    ("folktables", "rac1p", False),
    ("credit", "age", True),
    ("german", "age", True),
    ("heart", "gender", False),
)

APPROACH = ("train_method", "test_method")
RUN = (
    "dataset", "criteria", "model", "error", *APPROACH, "is_baseline", "pos", "split_seed", "retrain_seed", "accuracy",
)


def _found_in_key(words: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.col("experiment").contains(w))


def parse_keys(experiments: DataFrame, errors: Sequence[str] = ERRORS) -> DataFrame:
    """One row per experiment and error type named anywhere in its key, with the key's fields."""
    field = F.split("experiment", "/")
    return experiments.select(
        "*",
        F.explode(_found_in_key(errors)).alias("error"),
        field.getItem(1).alias("split_seed"),
        field.getItem(3).alias("train_method"),
        field.getItem(4).alias("model_field"),
        field.getItem(5).alias("retrain_seed"),
    )


def with_models(parsed: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """One row per model named anywhere in the key."""
    return parsed.select("*", F.explode(_found_in_key(models)).alias("model")).drop("model_field")


def baseline_method() -> Column:
    """The training method cleaning is compared with."""
    return F.when(F.col("error") == "missing_values", DELETED).otherwise(DIRTY)


def split_method(error: Column, train_method: Column) -> dict[str, Column]:
    """``detection`` and ``repair`` named in a training method.

    For outliers the part after ``_impute`` keeps its own underscore, so the
    repair of ``clean_SD_impute_mean_dummy`` reads ``impute__mean_dummy``.
    """
    by_dash = F.split(train_method, "-")
    by_impute = F.split(train_method, "_impute")
    missing, mislabel = error == "missing_values", error == "mislabel"
    return {
        "detection": F.when(missing, F.lit(""))
        .when(mislabel, F.get(by_dash, F.lit(0)))
        .otherwise(F.replace(F.get(by_impute, F.lit(0)), F.lit("clean_"), F.lit(""))),
        "repair": F.when(missing, train_method)
        .when(mislabel, F.get(by_dash, F.lit(1)))
        .otherwise(F.concat(F.lit("impute_"), F.get(by_impute, F.lit(1)))),
    }


def training_runs(experiments: DataFrame) -> DataFrame:
    """One row per experiment, error type and model, marked as baseline or cleaned run."""
    runs = with_models(parse_keys(experiments)).withColumn("baseline", baseline_method())
    return runs.withColumn("is_baseline", F.col("train_method") == F.col("baseline"))


def scored_runs(runs: DataFrame) -> DataFrame:
    """The runs with the test data, the score prefix and the accuracy each is judged by.

    A cleaned run appears twice, tested on data left dirty and on data repaired
    the way it was trained.  Dropping rows from test data is not an option in
    use, so the baseline for missing values is scored on dummy-imputed tests;
    mislabel runs are scored on clean labels throughout.
    """
    tested = F.when(F.col("is_baseline"), F.array("baseline")).otherwise(F.array("baseline", "train_method"))
    runs = runs.select("*", F.explode(tested).alias("test_method"))
    missing, mislabel = F.col("error") == "missing_values", F.col("error") == "mislabel"
    prefix = (
        F.when(F.col("is_baseline") & missing, DUMMY_MEAN)
        .when(F.col("is_baseline"), F.col("baseline"))
        .when(mislabel, CLEAN)
        .otherwise(F.col("test_method"))
    )
    judged_by = (
        F.when(F.col("is_baseline") & missing, DUMMY_MEAN)
        .when(F.col("test_method") == F.col("baseline"), F.col("baseline"))
        .when(~mislabel, F.col("train_method"))
    )
    return runs.withColumns({
        "prefix": prefix,
        "accuracy": F.try_element_at("metrics", F.concat(judged_by, F.lit("_test_acc"))),
    })


def score_runs(runs: DataFrame, cases: Sequence[tuple[str, str, bool]] = CASES) -> DataFrame:
    """One slim row per scored run and criterion: a gap per fairness metric, and the accuracy.

    The metric maps end here; what is paired and tested later is a few numbers.
    """
    listed = runs.sparkSession.createDataFrame(list(cases), "dataset string, criteria string, flipped boolean")
    looked_up = map_counts(F.col("metrics"), F.col("prefix"), F.col("criteria"))
    cells = [looked_up(g, c).alias(f"{c}_{g}") for g in GROUPS for c in CELLS]
    counted = scored_runs(runs).join(F.broadcast(listed), "dataset").select(*RUN, "flipped", *cells)
    return counted.select(
        *RUN, *[fairness_gap(m, wide_counts(), F.col("flipped")).alias(m) for m in IMPACT_METRICS]
    )


def _baseline_value(measure: str, is_baseline: Column, together: WindowSpec) -> Column:
    """The baseline's measure within a pair; a pair with two baselines raises, as either could be meant."""
    mine = F.when(is_baseline, F.col(measure))
    several = F.count(F.when(is_baseline, F.lit(1))).over(together) > 1
    refused = F.raise_error(F.lit("seeds do not identify a run: a pair has several baseline runs")).cast("double")
    return F.when(several, refused).otherwise(F.max(mine).over(together))


def pair_with_baseline(scored: DataFrame, pairing: str = "position") -> DataFrame:
    """Change of each score of a cleaned run from its baseline run (NULL when there is none).

    ``position`` pairs the i-th run of a cleaning approach with the i-th baseline
    run, so the longer list loses its tail.  ``seeds`` pairs on equal seeds, which
    needs no ranks and is the choice when runs may be absent; seeds that two baseline
    runs share raise.
    """
    place = ["dataset", "criteria", "model", "error"]
    if pairing == "position":
        scored = ranked(cut_lineage(scored), [*place, *APPROACH], ["pos", "split_seed", "retrain_seed"])
        pair = [*place, "rn"]
    elif pairing == "seeds":
        pair = [*place, "split_seed", "retrain_seed"]
    else:
        raise ValueError(f"Unsupported: {pairing}")
    # a pair key holds one row per approach
    together = Window.partitionBy(*pair)
    scores = [*IMPACT_METRICS, "accuracy"]
    compared = scored.select(
        *place,
        *APPROACH,
        "is_baseline",
        *[(F.col(s) - _baseline_value(s, F.col("is_baseline"), together)).alias(s) for s in scores],
    )
    return compared.where(~F.col("is_baseline")).drop("is_baseline")


def moments_of(changes: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Count, mean and sample deviation of each column of differences: ``{m}_n, {m}_mean, {m}_sd``."""
    moments = []
    for m in measures:
        moments += [F.count(m).alias(f"{m}_n"), F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd")]
    return changes.groupBy(*keys).agg(*moments)


def _moments(measure: str, name: str | None = None) -> list[Column]:
    return [F.col(f"{measure}_{part}").alias(f"{name or measure}_{part}") for part in ("n", "mean", "sd")]


def test_moments(moments: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Paired t-tests from the output of ``moments_of``: ``{m}_n, {m}_t, {m}_p``."""
    tested = moments.withColumns(
        {f"{m}_t": paired_t(F.col(f"{m}_n"), F.col(f"{m}_mean"), F.col(f"{m}_sd")) for m in measures}
    )
    tested = tested.withColumns({f"{m}_p": paired_p(F.col(f"{m}_n"), F.col(f"{m}_t")) for m in measures})
    return tested.select(*keys, *[f"{m}_{part}" for m in measures for part in ("n", "t", "p")])


def paired_tests(changes: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Paired t-test per key for each column of differences: ``{m}_n, {m}_t, {m}_p``."""
    return test_moments(moments_of(changes, keys, measures), keys, measures)


def judge_approaches(changes: DataFrame) -> DataFrame:
    """Verdicts per metric and approach, at a level shared among all approaches of a scenario."""
    place = ["dataset", "criteria", "model", "error"]
    moments = moments_of(changes, [*place, *APPROACH], [*IMPACT_METRICS, "accuracy"])
    # from here on one row per approach, so the window holds a handful of rows
    approaches = F.count(F.lit(1)).over(Window.partitionBy(*place))
    per_metric = [F.struct(F.lit(m).alias("metric"), *_moments(m, "gap")) for m in IMPACT_METRICS]
    spread = moments.withColumn("alpha", F.lit(ALPHA) / approaches).select(
        *place, *APPROACH, "alpha", *_moments("accuracy"), F.inline(F.array(*per_metric))
    )
    tested = test_moments(spread, [*place, "metric", *APPROACH, "alpha"], ["gap", "accuracy"])
    alpha = F.col("alpha")
    return tested.select(
        "*",
        impact_verdict(F.col("gap_t"), F.col("gap_p"), alpha, True).alias("fairness_impact"),
        impact_verdict(F.col("accuracy_t"), F.col("accuracy_p"), alpha, False).alias("accuracy_impact"),
    )


def impact_table(
    experiments: DataFrame, cases: Sequence[tuple[str, str, bool]] = CASES, pairing: str = "position"
) -> DataFrame:
    """The impact table: one row per scenario and retained cleaning approach.

    Approaches are dropped only after they have counted towards the shared level.
    """
    judged = judge_approaches(pair_with_baseline(score_runs(training_runs(experiments), cases), pairing))
    named = judged.withColumns(split_method(F.col("error"), F.col("train_method"))).withColumn(
        "test_repaired", F.col("train_method") == F.col("test_method")
    )
    mislabel = F.col("error") == "mislabel"
    dropped = mislabel & (F.col("test_repaired") | (F.col("detection") == "shapley"))
    kept = named.where(~dropped & (F.col("test_repaired") | mislabel))
    return kept.select(
        "dataset",
        "criteria",
        "metric",
        "model",
        "error",
        "detection",
        "repair",
        "test_repaired",
        "fairness_impact",
        "accuracy_impact",
    )


def best_models(experiments: DataFrame, errors: Sequence[str] = ERRORS) -> DataFrame:
    """Per dataset, error and split: the best test accuracy and the first model that reached it."""
    parsed = parse_keys(experiments, errors)
    accuracies = F.map_entries(F.map_filter("metrics", lambda k, _: k.contains("test_acc")))
    reached = parsed.select(
        "dataset", "error", "split_seed", F.col("model_field").alias("model"), "pos", F.explode(accuracies).alias("e")
    ).select("dataset", "error", "split_seed", "model", "pos", F.col("e.value").alias("accuracy"))
    best = F.max_by(F.struct("accuracy", "model"), F.struct(F.col("accuracy"), -F.col("pos")))
    return (
        reached.where(F.col("accuracy").isNotNull())
        .groupBy("dataset", "error", "split_seed")
        .agg(best.alias("best"))
        .select("dataset", "error", "split_seed", "best.accuracy", "best.model")
    )


def best_model_modes(best: DataFrame) -> DataFrame:
    """The models that win most splits per dataset and error, all ties kept."""
    wins = best.groupBy("dataset", "error", "model").agg(F.count(F.lit(1)).alias("splits"))
    # one row per model by now
    top = F.max("splits").over(Window.partitionBy("dataset", "error"))
    return wins.withColumn("_top", top).where(F.col("splits") == F.col("_top")).drop("_top")


def paired_changes(
    runs: DataFrame, pair: Sequence[str], method: str, baseline: str, measures: Sequence[str]
) -> DataFrame:
    """Change of each measure from the baseline run to every other method's run of the same pair.

    A pair holds one run per method, so its baseline is looked up in a window;
    pairs without a baseline run are left out, pairs with several raise.
    """
    together = Window.partitionBy(*pair)
    is_base = F.col(method) == baseline
    found = F.max(is_base).over(together).alias("_found")
    compared = runs.select(
        *pair, method, found, *[(F.col(m) - _baseline_value(m, is_base, together)).alias(m) for m in measures]
    )
    return compared.where(F.col("_found") & ~is_base).drop("_found")
