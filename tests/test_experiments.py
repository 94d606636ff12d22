import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veriparity.functions.fairness import fairness_gap, wide_counts
from veriparity.operators import experiments as ops
from veriparity.operators import impact as impact_ops
from veriparity.operators.confusion import accuracy_and_auc, causal_impact, causal_summary, group_confusion, wide_confusion
from veriparity.plans import impacts  # noqa: F401  (registers queries)
from veriparity.plans.registry import ORACLES, QUERIES

COUNTS = "tp_priv int, tn_priv int, fp_priv int, fn_priv int, tp_dis int, tn_dis int, fp_dis int, fn_dis int"


def test_gaps(spark):
    rows = spark.createDataFrame([(30, 40, 10, 20, 10, 0, 0, 30), (0, 1, 0, 0, 1, 1, 1, 1)], COUNTS)
    out = rows.select(
        fairness_gap("equal_opportunity", wide_counts()).alias("eo"),
        fairness_gap("equal_opportunity", wide_counts(), True).alias("eo_f"),
        fairness_gap("predictive_parity", wide_counts()).alias("pp"),
        fairness_gap("predictive_parity", wide_counts(), F.lit(True)).alias("pp_f"),
        fairness_gap("statistical_parity", wide_counts()).alias("sp"),
    ).collect()
    assert out[0].eo == pytest.approx(0.6 - 0.25)
    assert out[0].eo_f is None
    assert out[0].pp == pytest.approx(0.75 - 1.0)
    assert out[0].pp_f == pytest.approx(40 / 60 - 0.0)
    assert out[0].sp == pytest.approx(0.4 - 0.25)
    assert out[1].eo is None and out[1].pp is None
    with pytest.raises(ValueError):
        fairness_gap("luck", wide_counts())
    with pytest.raises(ValueError):
        fairness_gap("statistical_parity", wide_counts(), True)


def test_confusion_and_auc(spark):
    data = [("priv", True, True, 0.9), ("priv", False, True, 0.6), ("priv", True, False, 0.4), ("priv", False, False, 0.4),
            ("dis", True, True, 0.8), (None, True, True, 0.1)]
    rows = spark.createDataFrame(data, "grp string, y boolean, p boolean, s double")
    got = {r.grp: (r.tp, r.tn, r.fp, r.fn) for r in group_confusion(rows, "grp", "y", "p").collect()}
    assert got == {"priv": (1, 1, 1, 1), "dis": (1, 0, 0, 0)}
    wide = wide_confusion(rows, "grp", "y", "p").first()
    assert (wide.tp_priv, wide.fn_priv, wide.tp_dis, wide.tn_dis) == (1, 1, 1, 0)
    scored = {r.grp: r for r in accuracy_and_auc(rows.where("grp IS NOT NULL"), ["grp"], "y", "p", "s").collect()}
    assert scored["priv"].accuracy == 0.5 and scored["priv"].auc == pytest.approx((2 + 0.5) / 4)
    assert scored["dis"].auc is None


def causal_rows(spark):
    columns = [f"{s}_{c}_{g}" for s in ("orig", "clean") for g in ("priv", "nonpriv") for c in ("tp", "fp", "tn", "fn")]
    columns += ["orig_accuracy", "clean_accuracy", "orig_auc", "clean_auc"]
    rows = [
        (8, 2, 5, 2, 5, 2, 5, 5, 8, 2, 5, 2, 6, 2, 5, 4, 0.7, 0.75, 0.6, 0.7),  # gap falls
        (8, 2, 5, 2, 5, 2, 5, 5, 4, 2, 5, 6, 9, 2, 5, 1, 0.7, 0.6, 0.6, 0.5),  # gap turns negative: floor at 0
        (5, 2, 5, 5, 8, 2, 5, 2, 8, 2, 5, 2, 6, 2, 5, 4, 0.7, 0.75, 0.6, 0.7),  # not unfair to begin with
        (0, 2, 5, 0, 8, 2, 5, 2, 8, 2, 5, 2, 6, 2, 5, 4, 0.7, 0.75, 0.6, 0.7),  # no positives: no gap
    ]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], ["run", *columns])


def test_causal_impact(spark):
    out = {r.run: r for r in causal_impact(causal_rows(spark), "equal_opportunity", ["run"]).collect()}
    assert (out[0].applicable, out[0].unfair) == (True, True)
    assert out[0].responsibility == pytest.approx((0.3 - 0.2) / 0.3)
    assert out[0].accuracy_change == pytest.approx(0.05) and out[0].auc_change == pytest.approx(0.1)
    assert out[1].responsibility == pytest.approx(1.0)
    assert (out[2].applicable, out[2].unfair, out[2].responsibility) == (False, False, None)
    assert out[3].orig_gap is None and out[3].applicable is False
    total = causal_summary(causal_impact(causal_rows(spark), "equal_opportunity")).first()
    assert (total.n, total.n_unfair, total.n_applicable) == (4, 2, 2)


@pytest.mark.parametrize(
    "error, method, detection, repair",
    [
        ("outliers", "clean_SD_impute_mean_dummy", "SD", "impute__mean_dummy"),
        ("mislabel", "finder-flip", "finder", "flip"),
        ("missing_values", "impute_mean_dummy", "", "impute_mean_dummy"),
    ],
)
def test_method_names(spark, error, method, detection, repair):
    names = ops.split_method(F.lit(error), F.lit(method))
    row = spark.range(1).select(names["detection"].alias("d"), names["repair"].alias("r")).first()
    assert (row.d, row.r) == (detection, repair)


def document(runs, criteria="sex"):
    """Experiments from (error, train method, split, {prefix: (tp, fn of the privileged, accuracy)})."""
    out = []
    for pos, (error, train, split, by_prefix) in enumerate(runs):
        metrics = {}
        for prefix, (tp, fn, accuracy) in by_prefix.items():
            cells = {"priv__tp": tp, "priv__fn": fn, "priv__tn": 5, "priv__fp": 5,
                     "dis__tp": 5, "dis__fn": 5, "dis__tn": 5, "dis__fp": 5}
            metrics |= {f"{prefix}__{criteria}_{c}": float(v) for c, v in cells.items()}
            if accuracy is not None:
                metrics[f"{prefix}_test_acc"] = accuracy
        out.append(("adult", pos, f"adult/{split}/{error}/{train}/XGBoost/1", metrics))
    return out


SCHEMA = "dataset string, pos bigint, experiment string, metrics map<string,double>"
CASES = [("adult", "sex", False)]


def outlier_runs(n=8):
    runs = []
    for i in range(n):
        wobble = i % 2
        runs.append(("outliers", "dirty", i, {"dirty": (90 + wobble, 10 - wobble, 0.70 + 0.001 * i)}))
    for i in range(n):
        wobble = (i + 1) % 2
        own = {"dirty": (89 + wobble, 11 - wobble, 0.7), "clean_SD_impute_mean_dummy": (60 + wobble, 40 - wobble, 0.8 + 0.001 * i)}
        runs.append(("outliers", "clean_SD_impute_mean_dummy", i, own))
    return runs


@pytest.mark.parametrize("pairing", ["position", "seeds"])
def test_impact_table_outliers(spark, pairing):
    rows = spark.createDataFrame(document(outlier_runs()), SCHEMA)
    got = {r.metric: r for r in ops.impact_table(rows, CASES, pairing).collect()}
    assert set(got) == {"equal_opportunity", "predictive_parity"}
    row = got["equal_opportunity"]
    assert (row.detection, row.repair, row.test_repaired) == ("SD", "impute__mean_dummy", True)
    assert (row.fairness_impact, row.accuracy_impact) == ("positive", "positive")


def test_position_pairing_truncates(spark):
    runs = outlier_runs(5)
    del runs[3:5]
    rows = spark.createDataFrame(document(runs), SCHEMA)
    paired = ops.pair_with_baseline(ops.score_runs(ops.training_runs(rows), CASES), "position")
    moments = ops.moments_of(paired, ["test_method"], ["equal_opportunity"]).collect()
    assert {r.equal_opportunity_n for r in moments} == {3}
    with pytest.raises(ValueError):
        ops.pair_with_baseline(ops.score_runs(ops.training_runs(rows), CASES), "luck")


def test_missing_values_baseline_and_level(spark):
    runs = []
    for i in range(6):
        runs.append(("missing_values", "delete", i, {"impute_mean_dummy": (90 + i % 2, 10 - i % 2, 0.7 + 0.01 * i), "delete": (50, 50, 0.1)}))
        runs.append(("missing_values", "impute_mean_dummy", i, {"delete": (50, 50, 0.1), "impute_mean_dummy": (60, 40, 0.6)}))
    rows = spark.createDataFrame(document(runs), SCHEMA)
    judged = ops.judge_approaches(ops.pair_with_baseline(ops.score_runs(ops.training_runs(rows), CASES), "seeds"))
    assert {r.alpha for r in judged.collect()} == {0.025}
    table = ops.impact_table(rows, CASES, "seeds").where("metric = 'equal_opportunity'").collect()
    assert [(r.detection, r.repair, r.fairness_impact, r.accuracy_impact) for r in table] == [
        ("", "impute_mean_dummy", "positive", "negative")
    ]


def test_mislabel_retention(spark):
    runs = []
    for i in range(6):
        runs.append(("mislabel", "dirty", i, {"dirty": (90 + i % 2, 10 - i % 2, 0.7 + 0.01 * i)}))
        for method in ("finder-flip", "shapley-flip"):
            runs.append(("mislabel", method, i, {"clean": (60, 40, None), "dirty": (90, 10, 0.7 + 0.01 * i)}))
    rows = spark.createDataFrame(document(runs), SCHEMA)
    table = ops.impact_table(rows, CASES, "seeds").where("metric = 'equal_opportunity'").collect()
    assert [(r.detection, r.repair, r.test_repaired, r.fairness_impact, r.accuracy_impact) for r in table] == [
        ("finder", "flip", False, "positive", "insignificant")
    ]


def test_no_baseline_is_insignificant(spark):
    runs = [r for r in outlier_runs() if r[1] != "dirty"]
    rows = spark.createDataFrame(document(runs), SCHEMA)
    for pairing in ("position", "seeds"):
        table = ops.impact_table(rows, CASES, pairing).collect()
        assert {(r.fairness_impact, r.accuracy_impact) for r in table} == {("insignificant", "insignificant")}


def test_best_model_first_wins_and_modes_keep_ties(spark):
    data = [
        ("d", 0, "d/1/outliers/dirty/A/0", {"a_test_acc": 0.9, "b_test_acc": 0.5}),
        ("d", 1, "d/1/outliers/dirty/B/0", {"a_test_acc": 0.9, "other": 2.0}),
        ("d", 2, "d/2/outliers/dirty/B/0", {"a_test_acc": 0.4}),
        ("d", 3, "d/2/outliers/dirty/A/0", {"a_test_acc": 0.3, "b_test_acc": None}),
    ]
    best = ops.best_models(spark.createDataFrame(data, SCHEMA))
    assert {(r.split_seed, r.model, r.accuracy) for r in best.collect()} == {("1", "A", 0.9), ("2", "B", 0.4)}
    assert {(r.model, r.splits) for r in ops.best_model_modes(best).collect()} == {("A", 1), ("B", 1)}


def test_paired_changes_drop_pairs_without_baseline(spark):
    rows = spark.createDataFrame([(1, "base", 1.0), (1, "new", 1.5), (2, "new", 9.0)], "u int, m string, s double")
    got = ops.paired_changes(rows, ["u"], "m", "base", ["s"]).collect()
    assert [(r.u, r.m, r.s) for r in got] == [(1, "new", 0.5)]


def test_impact_questions(spark):
    data = [("e", "k1", "positive", "negative"), ("e", "k1", "negative", "positive"), ("e", "k2", "negative", "negative")]
    rows = spark.createDataFrame(data, "error string, k string, fairness_impact string, accuracy_impact string")
    matrix = {(r.fairness_impact, r.accuracy_impact): (r["count"], r.pct) for r in impact_ops.impact_matrix(rows).collect()}
    assert len(matrix) == 16
    assert matrix["negative", "all"] == (2, 66.7) and matrix["all", "all"] == (3, 100.0)
    assert matrix["insignificant", "insignificant"] == (0, 0.0)
    found = impact_ops.keys_with(rows, ["k"], impact_ops.fairness_is("positive"), "cleaning_found").collect()
    assert [tuple(r) for r in found] == [("k1", True)]


def test_null_keys_are_not_found(spark):
    rows = spark.createDataFrame([("a", "x", 1), (None, "x", 1), ("b", None, 1), ("c", "x", 0)], "k string, l string, v int")
    assert [tuple(r) for r in impact_ops.keys_with(rows, ["k", "l"], F.col("v") == 1).collect()] == [("a", "x")]


def test_repeated_seeds_of_a_baseline_raise(spark):
    rows = [(1, "base", 0.5), (1, "base", 0.9), (1, "other", 0.6)]
    runs = spark.createDataFrame(rows, "seed int, method string, score double")
    with pytest.raises(PySparkException, match="several baseline"):
        ops.paired_changes(runs, ["seed"], "method", "base", ["score"]).collect()
    once = ops.paired_changes(runs.where("score <> 0.9"), ["seed"], "method", "base", ["score"]).collect()
    assert [r.score for r in once] == [pytest.approx(0.1)]


def test_share_of_own_rows_is_the_default(spark):
    rows = spark.createDataFrame([("m", "positive")] * 3 + [("m", "negative")], "metric string, fairness_impact string")
    got = {r.fairness_impact: r.perc for r in impact_ops.metric_share(rows).collect()}
    assert got == {"positive": 0.75, "negative": 0.25}
    assert impact_ops.metric_share(rows, impact_ops.PUBLISHED_ROWS_PER_METRIC).first().perc < 0.01


def test_outcomes_of_both_endings(spark, tmp_path):
    """Types as in the TPC-H specification and types of one word: no ending leaves out the rows of the other."""
    parts = [(1, "PROMO PLATED STEEL"), (2, "PROMO"), (3, "PROMO PLATED TIN"), (4, "STEELY"), (5, None), (6, "STEEL"), (6, "O")]
    items = [(1, "A"), (1, "A"), (2, "N"), (3, "A"), (4, "A"), (5, "A"), (6, "R"), (7, "A"), (None, "A")]
    tables = {
        "part": spark.createDataFrame(parts, "p_partkey bigint, p_type string").withColumn("p_brand", F.lit("b")),
        "lineitem": spark.createDataFrame(items, "l_partkey bigint, l_returnflag string").select(
            "*", F.lit(1).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit("F").alias("l_linestatus"),
            F.lit(0.1).alias("l_discount"), F.lit(0.01).alias("l_tax"),
        ),
        "orders": spark.createDataFrame([], "o_orderkey int, o_custkey int, o_orderpriority string, o_orderstatus string"),
        "customer": spark.createDataFrame([], "c_custkey int, c_mktsegment string"),
    }
    duck = duckdb.connect()
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["impact_sql_outcomes"](spark, str(tmp_path)).collect()
    want = [(error, "positive", "negative", n) for error, n in (("A", 2), ("N", 1), ("R", 2))]
    assert sorted(tuple(r) for r in got) == want
    assert sorted(duck.execute(ORACLES["impact_sql_outcomes"]).fetchall()) == want
