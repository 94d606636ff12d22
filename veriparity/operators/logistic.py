"""Ridge-penalised logistic models by distributed Newton steps.

A step needs the gradient and the Gram matrix weighted by p (1 - p), which are sums
over the rows.  A task multiplies its batches into one small matrix per model, and a
grouped sum adds the tasks; the driver solves systems as wide as the features are.  All
models of a search -- strengths times left-out folds -- take their steps in the same
pass.  The penalised mean loss has one minimum, so the result does not depend on
partitioning, and a step that overshoots is halved.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriparity.operators.fold_encoders import EVERY, Encoders

MAX_WIDTH = 512
MAX_PASSES = 60
TOLERANCE = 1e-8  # of a step, in units of the weights
SCORE_DECIMALS = 10  # equal rows have equal probabilities wherever they stand in a batch

Key = tuple[float, int]  # strength, left-out fold


def chances(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights
    small = np.exp(-np.abs(z))
    return np.where(z >= 0, 1, small) / (1 + small)


def partial_sums(rows: DataFrame, encoders: Encoders, tried: dict[Key, np.ndarray]) -> dict[Key, np.ndarray]:
    """Per model a matrix of ``width + 2`` rows: Gram matrix, gradient, and the loss with the number of rows."""
    keys, width = list(tried), encoders.width
    place = {fold: e for e, fold in enumerate(encoders.folds)}

    def run(batches):
        total = np.zeros((len(keys), width + 2, width))
        for batch in batches:
            read, y, fold = encoders.read(batch), batch["target"].to_numpy(), batch["fold"].to_numpy()
            for left_out in sorted({k[1] for k in keys}):
                mine = fold != left_out
                x, target = encoders.matrix(read, place[left_out])[mine], y[mine]
                for m, key in enumerate(keys):
                    if key[1] != left_out:
                        continue
                    z = x @ tried[key]
                    p = chances(x, tried[key])
                    total[m, :width] += (x * (p * (1 - p))[:, None]).T @ x
                    total[m, width] += x.T @ (p - target)
                    total[m, width + 1, 0] += (np.logaddexp(0, z) - target * z).sum()
        flat = total.reshape(-1, width)
        numbers = np.arange(len(flat), dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * width), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(numbers), lists], names=["row", "sums"])

    parts = rows.mapInArrow(run, "row int, sums array<double>").select("row", F.posexplode("sums").alias("at", "value"))
    summed = parts.groupBy("row", "at").agg(F.sum("value").alias("value")).toArrow()  # models times width squared
    out = np.zeros((len(keys) * (width + 2), width))
    out[summed["row"].to_numpy(), summed["at"].to_numpy()] = summed["value"].to_numpy()
    return dict(zip(keys, out.reshape(len(keys), width + 2, width), strict=True))


def fit_logistic(rows: DataFrame, encoders: Encoders, wanted: Sequence[Key], max_passes: int = MAX_PASSES) -> dict[Key, np.ndarray]:
    """Weights (intercept first, unpenalised) of the model of each strength on the rows outside each fold.

    ``rows`` come from ``feature_input`` with ``target`` (0 or 1) and ``fold``; they are passed over once per step,
    so they should be a written table.
    """
    width = encoders.width
    size = {key: int(encoders.rows[encoders.folds.index(key[1])]) for key in wanted}
    at = {key: np.zeros(width) for key in wanted}
    step: dict[Key, np.ndarray] = {}
    loss = dict.fromkeys(wanted, np.inf)
    tried, done = dict(at), {}
    for _ in range(max_passes):
        for key, sums in partial_sums(rows, encoders, tried).items():
            strength, n = key[0], size[key]
            w = tried[key]
            ridge = np.full(width, strength)
            ridge[0] = 0
            value = sums[width + 1, 0] / n + (ridge * w * w).sum() / 2
            if value > loss[key] + 1e-12 * abs(loss[key]):
                step[key] = step[key] / 2
                tried[key] = at[key] + step[key]
                continue
            at[key], loss[key] = w, value
            gradient = sums[width] / n + ridge * w
            # a category without training rows has neither gradient nor curvature but the ridge's
            curvature = sums[:width] / n + np.diag(ridge + 1e-12 * (ridge == 0))
            step[key] = -np.linalg.solve(curvature, gradient)
            tried[key] = w + step[key]
            if np.abs(step[key]).max() < TOLERANCE:  # the next one is of the order of its square
                done[key] = tried.pop(key)
        if not tried:
            return done
    raise RuntimeError(f"the fit has not converged in {max_passes} passes; allow more or a larger strength")


def probabilities(rows: DataFrame, encoders: Encoders, models: dict[Key, np.ndarray], keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` with ``strength`` and ``p``, per row and model: models of the row's own fold, and of ``EVERY``."""
    place = {fold: e for e, fold in enumerate(encoders.folds)}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)

    def run(batches):
        for batch in batches:
            read = encoders.read(batch)
            fold = batch["fold"].to_numpy() if "fold" in batch.schema.names else np.full(batch.num_rows, EVERY)
            kept = batch.select(list(keep))
            for (strength, left_out), w in models.items():
                mine = np.flatnonzero((fold == left_out) | (left_out == EVERY))
                p = np.round(chances(encoders.matrix(read, place[left_out])[mine], w), SCORE_DECIMALS)
                part = kept.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(mine), strength)), pa.array(p)], names=[*keep, "strength", "p"]
                )

    return rows.mapInArrow(run, f"{schema}, strength double, p double")


def best_strength(rows: DataFrame, encoders: Encoders, models: dict[Key, np.ndarray], strengths: Sequence[float]) -> float:
    """The strength with the best mean accuracy over the folds; of equal ones the first."""
    held_out = {key: w for key, w in models.items() if key[1] != EVERY}
    judged = probabilities(rows, encoders, held_out, ["target", "fold"])
    right = F.avg((F.col("target") == (F.col("p") > 0.5).cast("double")).cast("double")).alias("accuracy")
    found = judged.groupBy("strength", "fold").agg(right).collect()  # strengths times folds
    mean = {s: np.mean([r["accuracy"] for r in found if r["strength"] == s]) for s in strengths}
    return max(strengths, key=lambda s: round(mean[s], 12))
