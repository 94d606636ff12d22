"""Logistic models over encoded features: evaluation by group and out-of-fold probabilities.

``solver="newton"`` encodes every fold by its own training rows and takes exact steps for all models of
the search at once (``logistic.py``), up to ``MAX_WIDTH`` features; ``solver="mllib"`` takes any number of
features, with one encoder for all folds.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriparity.operators.confusion import accuracy_and_auc, causal_impact, wide_confusion
from veriparity.operators.features import encoder, feature_input
from veriparity.operators.fold_encoders import EVERY, encoders_of
from veriparity.operators.logistic import MAX_WIDTH, best_strength, fit_logistic, probabilities
from veriparity.operators.mislabel import confident_issues
from veriparity.session import cut_lineage
from veriparity.spec import AuditSpec

# Regularisation strengths tried and folds used to choose among them.
STRENGTHS = (0.0001, 0.001, 0.01, 0.1)
CHOICE_FOLDS = 3
ISSUE_FOLDS = 5
MAX_ITERATIONS = 500


def fold_of(id_col: Column, folds: int, seed: int) -> Column:
    """Fold by hash of the id, whatever the partitioning."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(folds)).cast("int")


def logistic(max_iterations: int = MAX_ITERATIONS) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="target", maxIter=max_iterations)


def converged(model: LogisticRegressionModel, max_iterations: int) -> LogisticRegressionModel:
    """The model, unless its fit ran out of iterations; then raise."""
    if model.hasSummary and model.summary.totalIterations >= max_iterations:
        raise RuntimeError(f"the fit has not converged in {max_iterations} iterations; allow more")
    return model


def choose_logistic(encoded: DataFrame, max_iterations: int = MAX_ITERATIONS) -> LogisticRegressionModel:
    """Best of the regularisation strengths by cross-validated accuracy, refitted on all rows.

    ``encoded`` has ``features``, ``target`` and ``fold``.
    """
    model = logistic(max_iterations)
    search = CrossValidator(
        estimator=model,
        estimatorParamMaps=ParamGridBuilder().addGrid(model.regParam, list(STRENGTHS)).build(),
        evaluator=MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy"),
        numFolds=CHOICE_FOLDS,
        foldCol="fold",
        parallelism=len(STRENGTHS),
    )
    return converged(search.fit(encoded).bestModel, max_iterations)


def _input(df: DataFrame, spec: AuditSpec, prediction: bool, **keep: Column) -> tuple[DataFrame, tuple, tuple]:
    numeric = spec.numeric_for_prediction if prediction else spec.numeric
    categorical = spec.categorical_for_prediction if prediction else spec.categorical
    label = spec.label_column()
    columns = {"id": F.col(spec.id_col), "label": label, "target": label.cast("double"), **keep}
    return feature_input(df, numeric, categorical, columns), numeric, categorical


def predictions(
    train: DataFrame, test: DataFrame, spec: AuditSpec, criteria: str, seed: int = 0, solver: str = "newton",
    fold: Column | None = None,
) -> DataFrame:
    """``id, label, predicted, score, grp`` of the test rows under the chosen model.

    ``fold`` (``0 .. CHOICE_FOLDS - 1``) deals out the training rows for the choice; without it the id is hashed.
    """
    fold = fold_of(F.col(spec.id_col), CHOICE_FOLDS, seed) if fold is None else fold.cast("int")
    rows, numeric, categorical = _input(train, spec, True, fold=fold)
    unseen, _, _ = _input(test, spec, True, grp=spec.group(criteria))
    if solver == "newton":
        encoders = encoders_of(rows, numeric, categorical, CHOICE_FOLDS, MAX_WIDTH)
        models = fit_logistic(rows, encoders, [(s, f) for s in STRENGTHS for f in encoders.folds])
        strength = best_strength(rows, encoders, models, STRENGTHS)
        chosen = {(strength, EVERY): models[strength, EVERY]}
        scored = probabilities(unseen, encoders, chosen, ["id", "label", "grp"])
        return scored.select("id", "label", (F.col("p") > 0.5).alias("predicted"), F.col("p").alias("score"), "grp")
    if solver != "mllib":
        raise ValueError(f"unknown solver: {solver}")
    # the encoder's output is written once, since the search passes over it many times
    fitted = encoder(numeric, categorical, rows.count()).fit(rows)
    encoded = cut_lineage(fitted.transform(rows).select("features", "target", "fold"))
    model = choose_logistic(encoded)
    scored = model.transform(fitted.transform(unseen))
    return scored.select(
        "id",
        "label",
        (F.col("prediction") == 1.0).alias("predicted"),
        vector_to_array("probability")[1].alias("score"),
        "grp",
    )


def evaluate_by_group(predicted: DataFrame) -> DataFrame:
    """One row: accuracy and AUC over all rows, confusion counts per group."""
    predicted = cut_lineage(predicted)
    whole = accuracy_and_auc(predicted.withColumn("_all", F.lit(0)), ["_all"], "label", "predicted", "score")
    groups = wide_confusion(predicted.withColumn("_all", F.lit(0)), "grp", "label", "predicted", ["_all"], "nonpriv")
    return whole.drop("n").join(groups, "_all").drop("_all")


def train_and_evaluate(
    train: DataFrame, test: DataFrame, spec: AuditSpec, criteria: str, seed: int = 0, solver: str = "newton",
    fold: Column | None = None,
) -> DataFrame:
    """Train on one table, test on another: accuracy, AUC and the eight group counts."""
    return evaluate_by_group(predictions(train, test, spec, criteria, seed, solver, fold))


def before_and_after(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Evaluations on dirty and on cleaned data side by side, ready for ``causal_impact``.

    Without ``keys`` each side is a single evaluation; several raise.
    """
    name = lambda side, c: c if c in keys else f"{side}_{c}"
    orig = before.select(*[F.col(c).alias(name("orig", c)) for c in before.columns])
    clean = after.select(*[F.col(c).alias(name("clean", c)) for c in after.columns])
    if not keys:
        sides = [side.limit(2).collect() for side in (orig, clean)]
        if any(len(rows) > 1 for rows in sides):
            raise ValueError("name the keys that pair the evaluations")
        both = [(*a, *b) for a in sides[0] for b in sides[1]]
        return orig.sparkSession.createDataFrame(both, T.StructType([*orig.schema.fields, *clean.schema.fields]))
    return orig.join(clean, list(keys))


def impact_of_cleaning(
    dirty: DataFrame,
    cleaned: DataFrame,
    test: DataFrame,
    spec: AuditSpec,
    criteria: str,
    metric: str = "equal_opportunity",
    seed: int = 0,
    solver: str = "newton",
    fold: Column | None = None,
) -> DataFrame:
    """Train on dirty and on cleaned rows, test both on the same rows, and tell what cleaning did to fairness.

    One row: the eight group counts, accuracy and AUC of either side, and the outcome of ``causal_impact``.
    """
    sides = [train_and_evaluate(train, test, spec, criteria, seed, solver, fold) for train in (dirty, cleaned)]
    both = cut_lineage(before_and_after(*sides))
    judged = causal_impact(both, metric)
    one = F.lit(0)
    return both.withColumn("_run", one).join(judged.withColumn("_run", one), "_run").drop("_run")


def out_of_fold(
    df: DataFrame, spec: AuditSpec, folds: int = ISSUE_FOLDS, seed: int = 0, solver: str = "newton", fold: Column | None = None
) -> DataFrame:
    """``id, given, probs``: class probabilities from a model, and an encoder, that did not see the row."""
    fold = fold_of(F.col(spec.id_col), folds, seed) if fold is None else fold.cast("int")
    rows, numeric, categorical = _input(df, spec, False, fold=fold)
    given = F.col("target").cast("int").alias("given")
    if solver == "newton":
        encoders = encoders_of(rows, numeric, categorical, folds, MAX_WIDTH)
        models = fit_logistic(rows, encoders, [(STRENGTHS[0], f) for f in encoders.folds if f != EVERY])
        scored = probabilities(rows, encoders, models, ["id", "target"])
        return scored.select("id", given, F.array(1 - F.col("p"), F.col("p")).alias("probs"))
    if solver != "mllib":
        raise ValueError(f"unknown solver: {solver}")
    fitted = encoder(numeric, categorical, rows.count()).fit(rows)
    encoded = cut_lineage(fitted.transform(rows).select("id", "features", "target", "fold"))
    parts = []
    for held_out in range(folds):
        model = logistic().setRegParam(STRENGTHS[0]).fit(encoded.where(F.col("fold") != held_out))
        converged(model, MAX_ITERATIONS)
        scored = model.transform(encoded.where(F.col("fold") == held_out))
        parts.append(scored.select("id", given, vector_to_array("probability").alias("probs")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mislabelled_by_model(
    df: DataFrame, spec: AuditSpec, folds: int = ISSUE_FOLDS, solver: str = "newton", fold: Column | None = None
) -> DataFrame:
    """Rows whose label a cross-validated logistic model confidently contradicts."""
    return confident_issues(out_of_fold(df, spec, folds, solver=solver, fold=fold), 2)
