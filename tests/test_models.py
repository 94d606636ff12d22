"""Encoders by fold, Newton fits and sparse forests against plain single-machine versions."""

import math
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veriparity.operators.features import encoded_cells, feature_input
from veriparity.operators.fold_encoders import EVERY, encode_by_fold, encoders_of
from veriparity.operators.forest import anomaly_scores, draw_samples, grow_tree, isolation_scores, node_draws, path_length
from veriparity.operators.logistic import best_strength, fit_logistic, probabilities
from veriparity.operators.models import out_of_fold, predictions
from veriparity.spec import AuditSpec, Equals, LabelIn

FOLDS = 3
SPEC = AuditSpec(
    name="t", label=LabelIn("y", (1,)), groups={"g": Equals("color", "red")}, numeric=("x", "z"), categorical=("color",), id_col="id"
)


def sample(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(100, 5, n), rng.normal(size=n)
    color = rng.choice(["red", "green", "blue"], n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x - 100) / 4 - (color == "red")))).astype(int)
    frame = pd.DataFrame({"id": range(n), "x": x, "z": z, "color": color, "y": y, "fold": np.arange(n) % FOLDS})
    frame.loc[::17, "x"] = None
    frame["z"] = frame["z"].where(frame.id % 23 != 0, np.nan)
    frame.loc[frame.id % 31 == 0, "color"] = None
    frame.loc[frame.id == 4, "color"] = "only here"
    return frame


SCHEMA = "id int, x double, z double, color string, y int, fold int"


def table_of(spark, frame):
    clean = [[None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in row] for row in frame.values.tolist()]
    return spark.createDataFrame(clean, SCHEMA)


def plain_features(frame, train):
    """Columns of ``frame`` encoded by ``train``, with the names of all categories there are."""
    out = [np.ones(len(frame))]
    for c in ("x", "z"):
        filled = train[c].astype(float).fillna(train[c].astype(float).mean())
        values = frame[c].astype(float).fillna(filled.mean())
        out.append((values - filled.mean()) / filled.std(ddof=0))
    known = set(train["color"].fillna("(missing)"))
    for v in ("(missing)", "blue", "green", "only here", "red"):
        out.append(((frame["color"].fillna("(missing)") == v) & (v in known)).astype(float))
    return np.column_stack(out)


def plain_fit(x, y, strength):
    """The minimum of the penalised loss by gradient steps with backtracking until nothing moves, then checked."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), strength)
    ridge[0] = 0
    loss = lambda w: (np.logaddexp(0, x @ w) - y * (x @ w)).mean() + (ridge * w * w).sum() / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge) + 1e-12 * np.eye(len(w))
        d, t = np.linalg.lstsq(h, -g, rcond=None)[0], 1.0
        while loss(w + t * d) > loss(w) and t > 1e-12:
            t /= 2
        w = w + t * d
    p = 1 / (1 + np.exp(-(x @ w)))
    assert np.abs(x.T @ (p - y) / len(y) + ridge * w).max() < 1e-10
    return w


@pytest.fixture(scope="module")
def prepared(spark):
    frame = sample()
    keep = {"id": F.col("id"), "target": F.col("y").cast("double"), "fold": F.col("fold")}
    rows = feature_input(table_of(spark, frame), ("x", "z"), ("color",), keep)
    return frame, rows, encoders_of(rows, ("x", "z"), ("color",), FOLDS, 50)


def test_encoders_of_every_fold(prepared):
    frame, rows, encoders = prepared
    assert encoders.folds == (EVERY, 0, 1, 2) and encoders.names == ("x", "z", "color=(missing)", "color=blue", "color=green", "color=only here", "color=red")
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    ordered = frame.set_index("id").loc[batch["id"].to_pylist()]
    for e, fold in enumerate(encoders.folds):
        train = frame[frame.fold != fold]
        assert encoders.rows[e] == len(train)
        assert encoders.matrix(encoders.read(batch), e) == pytest.approx(plain_features(ordered, train))


def test_long_form_of_the_fold_encoders(spark, prepared):
    frame, _, _ = prepared
    got = {}
    for r in encode_by_fold(table_of(spark, frame), "id", ["x", "z"], ["color"], F.col("fold"), FOLDS).collect():
        got.setdefault(r["id"], {})[r["feature"]] = r["value"]
    names = ("x", "z", "color=(missing)", "color=blue", "color=green", "color=only here", "color=red")
    for fold in range(FOLDS):
        part = frame[frame.fold == fold]
        for i, row in zip(part.id, plain_features(part, frame[frame.fold != fold])[:, 1:], strict=True):
            assert [got[i].get(n, 0.0) for n in names] == pytest.approx(row.tolist())
            assert set(got[i]) <= set(names)


def test_newton_steps_reach_the_minimum(spark, prepared):
    frame, rows, encoders = prepared
    wanted = [(s, f) for s in (0.0001, 0.1) for f in encoders.folds]
    models = fit_logistic(rows, encoders, wanted)
    again = fit_logistic(rows.repartition(7), encoders, wanted)
    for (strength, fold), w in models.items():
        train = frame[frame.fold != fold]
        want = plain_fit(plain_features(train, train), train.y.to_numpy(), strength)
        assert w == pytest.approx(want, abs=1e-6) and again[strength, fold] == pytest.approx(w, abs=1e-9)
    assert best_strength(rows, encoders, models, (0.0001, 0.1)) in (0.0001, 0.1)
    scored = {(r["id"], r["strength"]): r["p"] for r in probabilities(rows, encoders, {k: w for k, w in models.items() if k[1] != EVERY}, ["id"]).collect()}
    assert len(scored) == 2 * len(frame)
    for fold in range(FOLDS):
        part = frame[frame.fold == fold]
        p = 1 / (1 + np.exp(-(plain_features(part, frame[frame.fold != fold]) @ models[0.1, fold])))
        assert [scored[i, 0.1] for i in part.id] == pytest.approx(p.tolist(), abs=1e-9)


def test_separable_labels_and_limits(spark):
    rows = spark.range(60).select(
        F.col("id").cast("double").alias("num0"), F.lit(1.0).alias("num1"), F.col("id").cast("string").alias("cat0"),
        (F.col("id") >= 30).cast("double").alias("target"), (F.col("id") % 2).cast("int").alias("fold"),
    )
    encoders = encoders_of(rows.drop("cat0"), ("a", "b"), (), 2, 10)
    models = fit_logistic(rows, encoders, [(0.0001, EVERY)])  # steps from 0 overshoot here
    x = np.column_stack([np.ones(60), (np.arange(60) - 29.5) / np.arange(60).std(), np.zeros(60)])
    assert models[0.0001, EVERY] == pytest.approx(plain_fit(x, (np.arange(60) >= 30).astype(float), 0.0001), abs=1e-5)
    with pytest.raises(RuntimeError, match="converged"):
        fit_logistic(rows, encoders, [(0.0001, EVERY)], max_passes=2)
    with pytest.raises(ValueError, match="too many"):
        encoders_of(rows, ("a", "b"), ("c",), 2, 50)


def test_solvers_agree_in_what_they_find(spark):
    rows = table_of(spark, sample(600, 5))
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    hits = {}
    for solver in ("newton", "mllib"):
        found = predictions(train, test, SPEC, "g", solver=solver).collect()
        assert len(found) == 150
        hits[solver] = np.mean([r["label"] == r["predicted"] for r in found])
    assert abs(hits["newton"] - hits["mllib"]) < 0.05 and hits["newton"] > 0.65
    for solver in ("newton", "mllib"):
        assert out_of_fold(rows, SPEC, 3, solver=solver).count() == 600
    with pytest.raises(ValueError, match="solver"):
        predictions(train, test, SPEC, "g", solver="luck")


def plain_score(rows, samples, seed, scale_n):
    """Scores by a recursion per tree over dense rows (id -> {name: value})."""
    def walk(members, node, depth, row, tree, deepest):
        names = sorted({n for m in members for n in rows[m]})
        low = {n: min(rows[m].get(n, 0.0) for m in members) for n in names}
        high = {n: max(rows[m].get(n, 0.0) for m in members) for n in names}
        names = [n for n in names if high[n] > low[n]]
        if depth == deepest or len(members) <= 1 or not names:
            return depth + path_length(len(members))
        which, where = node_draws(seed, tree, node)
        name = names[int(which * len(names))]
        cut = low[name] + where * (high[name] - low[name])
        right = row.get(name, 0.0) > cut
        inside = [m for m in members if (rows[m].get(name, 0.0) > cut) == right]
        return walk(inside, 2 * node + right, depth + 1, row, tree, deepest)

    out = {}
    for i, row in rows.items():
        depth = sum(walk(members, 1, 0, row, tree, math.ceil(math.log2(max(len(members), 2)))) for tree, members in samples.items())
        out[i] = 2 ** (-depth / (len(samples) * path_length(scale_n)))
    return out


def test_forest_against_a_recursion(spark):
    frame = sample(90, 8)
    rows = encoded_cells(table_of(spark, frame), "id", ["x", "z"], ["color"])
    cells = {r["id"]: {c["feature"]: c["value"] for c in r["cells"]} for r in rows.collect()}
    samples = {}
    for r in draw_samples(rows, len(frame), 5, trees=12, sample=40).select("tree", "id").collect():
        samples.setdefault(r["tree"], []).append(r["id"])
    assert {len(v) for v in samples.values()} == {40}
    got = {r["id"]: r["score"] for r in isolation_scores(rows.repartition(3), 5, trees=12, sample=40).collect()}
    assert got == pytest.approx(plain_score(cells, samples, 5, 40), abs=1e-9)


def test_as_many_categories_as_rows(spark):
    """No vocabulary is made: a task holds the cells of its batch, whatever the number of categories."""
    n = 100_000
    rows = spark.range(n).select("id", (F.col("id") % 97).cast("double").alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("c"))
    found = isolation_scores(encoded_cells(rows, "id", ["x"], ["c"]), 1, trees=20).agg(F.count("score"), F.min("score"), F.max("score")).first()
    assert found[0] == n and 0 < found[1] <= found[2] <= 1


def test_trees_without_splits(spark):
    same = spark.createDataFrame([(i, [("a", 1.0)]) for i in range(5)], "id long, cells array<struct<feature string, value double>>")
    assert {round(r["score"], 9) for r in isolation_scores(same, 1, trees=3).collect()} == {0.5}
    empty = anomaly_scores(same.where("id < 0"), [(("a", None, None), (0.5, 0.0, 0.0), (1, -1, -1), (2, -1, -1), (0.0, 1.0, 2.0))], 8)
    assert empty.count() == 0
    grown = grow_tree(1)(pd.DataFrame({"tree": [0], "id": [1], "cells": [[{"feature": "a", "value": 1.0}]]}))
    assert list(grown["feature"][0]) == [None]


def test_entry_survives_missing_packages_of_the_corpus_operators():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"
    done = subprocess.run([sys.executable, "-W", "always", "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)
    n, corpus = done.stdout.split()
    assert int(n) > 70 and corpus == "False"
