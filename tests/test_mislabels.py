import numpy as np
import pytest
from pyspark.sql import functions as F

from veriparity.operators.configured import audit_cases, mislabel_audit, mislabel_cases, run_configurations
from veriparity.operators.features import encode_rows, encoder, feature_input
from veriparity.operators.forest import draw_samples, outliers_by_isolation
from veriparity.operators.mislabel import confident_issues
from veriparity.operators.models import (
    before_and_after,
    converged,
    impact_of_cleaning,
    logistic,
    mislabelled_by_model,
    train_and_evaluate,
)
from veriparity.operators.valuation import knn_shapley, mislabelled_by_value, nearest_shapley, stratified_holdout
from veriparity.spec import AuditSpec, Equals, LabelIn


def brute_shapley(train, train_y, test, test_y, k):
    n, out = len(train), np.zeros(len(train))
    for x, y in zip(test, test_y):
        order = np.lexsort((np.arange(n), np.sqrt(((train - x) ** 2).sum(axis=1))))
        agree = (train_y[order] == y).astype(float)
        s = np.zeros(n)
        s[-1] = agree[-1] / n
        for i in range(n - 2, -1, -1):
            s[i] = s[i + 1] + (agree[i] - agree[i + 1]) / k * min(k, i + 1) / (i + 1)
        out[order] += s / len(test)
    return out


@pytest.mark.parametrize("n, k", [(60, 5), (60, 1), (4, 10)])
def test_knn_shapley_matches_brute_force(spark, n, k):
    rng = np.random.default_rng(n + k)
    x, y = rng.integers(0, 4, (n, 3)).astype(float), rng.integers(0, 2, n).astype(bool)
    hx, hy = rng.integers(0, 4, (7, 3)).astype(float), rng.integers(0, 2, 7).astype(bool)
    make = lambda a, b: spark.createDataFrame(
        [(i, bool(l), [float(v) for v in f]) for i, (f, l) in enumerate(zip(a, b))], "id int, label boolean, features array<double>"
    )
    got = dict(map(tuple, knn_shapley(make(x, y), make(hx, hy), k).collect()))
    assert [got[i] for i in range(n)] == pytest.approx(list(brute_shapley(x, y, hx, hy, k)), abs=1e-12)


@pytest.mark.parametrize("n, k, nearest", [(80, 5, 12), (80, 1, 1), (20, 3, 40), (12, 3, 12), (300, 10, 25)])
def test_values_of_the_nearest_rows_are_within_their_bound(spark, n, k, nearest):
    rng = np.random.default_rng(n + nearest)
    x, y = rng.integers(0, 4, (n, 3)).astype(float), rng.integers(0, 2, n).astype(bool)
    hx, hy = rng.integers(0, 4, (7, 3)).astype(float), rng.integers(0, 2, 7).astype(bool)
    make = lambda a, b: spark.createDataFrame(
        [(f"r{i:04}", bool(l), [float(v) for v in f]) for i, (f, l) in enumerate(zip(a, b))], "id string, label boolean, features array<double>"
    )
    got = dict(map(tuple, nearest_shapley(make(x, y).repartition(4), make(hx, hy), nearest, k).collect()))
    exact = brute_shapley(x, y, hx, hy, k)
    errors = [abs(got.get(f"r{i:04}", 0.0) - exact[i]) for i in range(n)]
    assert max(errors) <= (1 / nearest if n > nearest else 1e-12) + 1e-12
    with pytest.raises(ValueError, match="neighbours"):
        nearest_shapley(make(x, y), make(hx, hy), k - 1, k)


def test_values_sum_to_neighbour_agreement(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame(
        [(i, bool(i % 2), [float(v) for v in rng.normal(size=2)]) for i in range(50)], "id int, label boolean, features array<double>"
    )
    point = spark.createDataFrame([(0, True, [0.0, 0.0])], "id int, label boolean, features array<double>")
    total = knn_shapley(rows, point, 10).agg(F.sum("value")).first()[0]
    nearest = sorted(rows.collect(), key=lambda r: sum(v * v for v in r.features))[:10]
    assert total == pytest.approx(sum(r.label for r in nearest) / 10)


def test_stratified_holdout_quota(spark):
    rows = spark.createDataFrame([(i, i % 7 == 0) for i in range(1000)], "id int, label boolean")
    held = stratified_holdout(rows, [F.xxhash64("id"), F.col("id")], 100)
    labels = [r.label for r in rows.join(held, "id", "left_semi").collect()]
    assert len(labels) == 100 and sum(labels) == 14


def brute_confident(given, probs):
    given, probs = np.array(given), np.array(probs)
    k = probs.shape[1]
    thresholds = np.array([probs[given == j, j].mean() for j in range(k)])
    joint = np.zeros((k, k))
    for g, p in zip(given, probs):
        ok = p >= thresholds - 1e-6
        if ok.any():
            joint[g, np.argmax(np.where(ok, p, -1))] += 1
    np.fill_diagonal(joint, np.maximum(joint.diagonal(), 1))
    sizes = np.bincount(given, minlength=k)
    noise = np.round(joint / joint.sum(axis=1, keepdims=True) * sizes[:, None]).astype(int)
    flagged = np.zeros(len(given), bool)
    for i in range(k):
        mine = given == i
        for j in range(k):
            if i != j and noise[i, j] > 0 and mine.any():
                margin = probs[:, j] - probs[:, i]
                flagged |= mine & (margin >= np.sort(margin[mine])[::-1][noise[i, j] - 1])
    return set(np.flatnonzero(flagged & (probs.argmax(axis=1) != given)))


@pytest.mark.parametrize("classes", [2, 3])
def test_confident_learning_matches_brute_force(spark, classes):
    rng = np.random.default_rng(classes)
    truth = rng.integers(0, classes, 300)
    given = np.where(rng.random(300) < 0.15, rng.integers(0, classes, 300), truth)
    probs = rng.dirichlet(np.ones(classes), 300) * 0.5
    probs[np.arange(300), truth] += 0.5
    rows = spark.createDataFrame(
        [(i, int(g), [float(v) for v in p]) for i, (g, p) in enumerate(zip(given, probs))], "id int, given int, probs array<double>"
    )
    got = confident_issues(rows, classes).collect()
    assert {r.id for r in got} == brute_confident(given, probs)
    assert all(r.suggested != r.given and r.margin > 0 for r in got)


def toy(spark, n=300):
    """Label follows x and colour, a few labels are wrong, one row lies far out."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        x, z, color = float(rng.normal()), float(rng.normal()), ["red", "blue", None][i % 3]
        y = int(x + (0.5 if color == "red" else 0) > 0)
        rows.append((i, x, z if i % 17 else None, color, ["m", "f"][i % 2], 1 - y if i % 29 == 0 and abs(x) > 0.5 else y))
    rows.append((n, 25.0, -30.0, "blue", "m", 1))
    return spark.createDataFrame(rows, "id int, x double, z double, color string, g string, y int")


SPEC = AuditSpec(
    name="toy", label=LabelIn("y", (1,)), groups={"g": Equals("g", "m")}, numeric=("x", "z"), categorical=("color",), id_col="id"
)


def test_encoded_rows(spark):
    rows = toy(spark)
    pdf = rows.toPandas()
    got = encode_rows(rows, "id", ["x", "z"], ["color"]).toPandas()
    filled = pdf.z.fillna(pdf.z.mean())
    want = ((filled - filled.mean()) / filled.std(ddof=0)).tolist()
    z = got[got.feature == "z"].sort_values("id").value.tolist()
    assert z == pytest.approx(want)
    assert set(got.feature) == {"x", "z", "color=red", "color=blue", "color=(missing)"}


def test_unseen_category_is_a_zero_block(spark):
    train = feature_input(toy(spark).where("color = 'red'"), (), ("color",), {"id": F.col("id")})
    other = feature_input(toy(spark).where("color = 'blue'"), (), ("color",), {"id": F.col("id")})
    model = encoder((), ("color",), train.count()).fit(train)
    assert {tuple(r.features.toArray()) for r in model.transform(other).collect()} == {(0.0,)}
    with pytest.raises(ValueError, match="too many categories"):
        feature_input(toy(spark), (), ("color",), {"id": F.col("id")}, max_categories=2)


def test_isolation_forest(spark):
    rows = toy(spark)
    first = {r.id: r.score for r in outliers_by_isolation(rows, SPEC, seed=1).collect()}
    again = {r.id: r.score for r in outliers_by_isolation(rows.repartition(7), SPEC, seed=1).collect()}
    assert first == again
    assert 300 in first and max(first, key=first.get) == 300
    assert 1 <= len(first) <= 4


def test_mislabel_detectors_find_flipped_labels(spark):
    rows = toy(spark)
    flipped = {r.id for r in rows.where("id % 29 = 0 AND abs(x) > 0.5 AND id < 300").collect()}
    by_model = {r.id for r in mislabelled_by_model(rows, SPEC).collect()}
    assert len(flipped & by_model) >= len(flipped) - 2 and len(by_model) < 40
    by_value = {r.id for r in mislabelled_by_value(rows, SPEC, seed=3).collect()}
    assert by_value and by_value <= {r.id for r in rows.collect()}
    with pytest.raises(ValueError, match="more than 100 rows"):
        mislabelled_by_value(rows.where("id < 90"), SPEC, seed=3)


def test_train_and_evaluate(spark):
    rows = toy(spark)
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    row = train_and_evaluate(train, test, SPEC, "g").first().asDict()
    counts = [row[f"{c}_{g}"] for c in ("tn", "fp", "fn", "tp") for g in ("priv", "nonpriv")]
    assert sum(counts) == test.count()
    assert 0.7 < row["accuracy"] <= 1 and 0.8 < row["auc"] <= 1
    assert row["accuracy"] == pytest.approx((row["tn_priv"] + row["tp_priv"] + row["tn_nonpriv"] + row["tp_nonpriv"]) / sum(counts))


def test_before_and_after_columns(spark):
    side = spark.createDataFrame([(1, 0.5, 3)], "run int, accuracy double, tp_priv int")
    assert before_and_after(side, side, ("run",)).columns == ["run", "orig_accuracy", "orig_tp_priv", "clean_accuracy", "clean_tp_priv"]
    assert before_and_after(side, side).count() == 1
    with pytest.raises(ValueError, match="keys"):
        before_and_after(side.union(side), side)


def test_encoder_divides_by_the_population_deviation(spark):
    rows = toy(spark)
    pdf = rows.toPandas()
    given = feature_input(rows, ("z",), (), {"id": F.col("id")})
    got = encoder(("z",), (), given.count()).fit(given).transform(given)
    filled = pdf.z.fillna(pdf.z.mean())
    want = dict(zip(pdf.id, (filled - filled.mean()) / filled.std(ddof=0)))
    assert {r.id: float(r.features[0]) for r in got.collect()} == pytest.approx(want)


def test_samples_of_a_forest_are_one_draw_at_all_sizes(spark):
    """The rows of a tree are those with its smallest hashes, whether or not a limit spares the sort."""
    cell = F.struct(F.lit("x").alias("feature"), F.col("id").cast("double").alias("value"))
    rows = spark.range(5000).select("id", F.array(cell).alias("cells"))
    few = draw_samples(rows, 5000, 3, trees=5, sample=40).select("tree", "id").collect()
    every = draw_samples(rows, 0, 3, trees=5, sample=40).select("tree", "id").collect()
    assert sorted(few) == sorted(every) and len(every) == 200


def test_cleaning_end_to_end(spark):
    rows = toy(spark)
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    row = impact_of_cleaning(train, train.where("id % 29 <> 0"), test, SPEC, "g").first().asDict()
    for side in ("orig", "clean"):
        assert sum(row[f"{side}_{c}_{g}"] for c in ("tn", "fp", "fn", "tp") for g in ("priv", "nonpriv")) == test.count()
    assert {"orig_gap", "clean_gap", "applicable", "unfair", "responsibility"} <= set(row)


def test_fits_that_run_out_of_iterations_raise(spark):
    rows = feature_input(toy(spark), ("x", "z"), (), {"target": F.col("y").cast("double")})
    encoded = encoder(("x", "z"), (), rows.count()).fit(rows).transform(rows)
    with pytest.raises(RuntimeError, match="converged"):
        converged(logistic(1).fit(encoded), 1)


def test_cases_make_one_report(spark):
    tables = {"a": (toy(spark), SPEC), "b": (toy(spark).where("id < 150"), SPEC)}
    report = audit_cases(tables, [("a", "g"), ("b", "g")]).collect()
    assert {(r.dataset, r.criteria, r.detector) for r in report} == {
        (d, "g", x) for d in "ab" for x in ("missing-values", "outliers-sd", "outliers-iqr")
    }
    polarity = mislabel_cases(tables, [("a", "g"), ("b", "g")]).collect()
    assert [r.dataset for r in polarity] == ["a", "b"]
    with pytest.raises(KeyError):
        audit_cases(tables, [("c", "g")])


def test_configurations_run_together(spark):
    configurations = [
        ("toy", "g", "missing-values", ("color", "z")),
        ("toy", "g", "outliers-sd", ("x",)),
        ("toy", "g", "outliers-if", ()),
        ("other", "g", "outliers-sd", ("x",)),
    ]
    got = {(r.detector, r.column): r for r in run_configurations(toy(spark), SPEC, configurations).collect()}
    assert set(got) == {("missing-values", "color"), ("missing-values", "z"), ("outliers-sd", "x"), ("outliers-if", "*")}
    assert got["missing-values", "color"].dirty_priv + got["missing-values", "color"].dirty_dis == 100
    with pytest.raises(ValueError):
        run_configurations(toy(spark), SPEC, [])


def test_mislabel_audit(spark):
    rows = toy(spark)
    row = mislabel_audit(rows, SPEC, "g").first()
    assert row.flagged_priv + row.flagged_dis == mislabelled_by_model(rows, SPEC).count()
    assert 0 <= row.positive_share_priv <= 1
    with pytest.raises(ValueError):
        mislabel_audit(rows, SPEC, "g", "luck")
