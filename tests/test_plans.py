"""The shape of physical plans: scans, shuffles, pushed filters and columns read."""

import os
import re

import pytest
from pyspark.sql import functions as F

from veriparity.operators import impact as impact_ops
from veriparity.operators.audit import audit_dataset, audit_matrix, audit_rows
from veriparity.operators.detectors import IQR, MISSING, SD
from veriparity.operators.experiments import best_models
from veriparity.operators.valuation import knn_shapley, stratified_holdout
from veriparity.session import checkpoint_dir, cut_lineage, scratch
from veriparity.spec import AuditSpec, Equals, LabelIn


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def scans(df):
    return plan(df).count("FileScan")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "t")
    columns = [(F.col("id") % (7 + i)).cast("double").alias(f"x{i}") for i in range(6)]
    wide = spark.range(500).select(
        "id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.lit("long text").alias("text"), *columns
    )
    wide.write.parquet(path)
    return spark.read.parquet(path)


def spec_of(n):
    return AuditSpec(
        name="t", label=LabelIn("g", ("a",)), groups={"g": Equals("g", "a"), "x": Equals("x0", 1)},
        numeric=tuple(f"x{i}" for i in range(n)), id_col="id",
    )


def test_scans_do_not_grow_with_columns(stored):
    names = [f"x{i}" for i in range(6)]
    assert scans(audit_rows(stored, spec_of(6), "g", names, MISSING)) == 1
    assert scans(audit_rows(stored, spec_of(6), "g", names, SD)) == 2
    for columns in ({SD: names}, {IQR: names}, {MISSING: names, SD: names, IQR: names}):
        one = {d: c[:1] for d, c in columns.items()}
        assert scans(audit_matrix(stored, spec_of(6), ["g"], one)) == scans(
            audit_matrix(stored, spec_of(6), ["g", "x"], columns)
        )
    assert scans(audit_dataset(stored, spec_of(1), "g")) == scans(audit_dataset(stored, spec_of(6), "g"))


def test_only_needed_columns_are_read(stored):
    text = plan(audit_rows(stored, spec_of(2), "g", ["x0", "x1"], IQR))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert set(c.split(":")[0] for c in schema.split(",")) <= {"g", "x0", "x1"}


def test_questions_need_one_scan_and_no_join(stored):
    rows = stored.select(F.col("g").alias("model"), F.col("g").alias("fairness_impact"), F.lit("x").alias("accuracy_impact"))
    found = plan(impact_ops.keys_with(rows, ["model"], impact_ops.fairness_is("a")))
    assert found.count("FileScan") == 1 and "Join" not in found
    assert "EqualTo(g,a)" in found
    counted = plan(impact_ops.tally(rows, ["model"], impact_ops.fairness_is("a")))
    assert "partial_count" in counted and "EqualTo(g,a)" in counted


def test_holdout_drops_rows_before_the_shuffle(stored):
    rows = stored.select("id", (F.col("g") == "a").alias("label"))
    text = plan(stratified_holdout(rows, [F.xxhash64("id"), F.col("id")], 50))
    assert text.count("WindowGroupLimit") == 2


def test_best_model_is_an_aggregate_not_a_window(spark):
    rows = spark.createDataFrame([("d", 0, "d/1/outliers/dirty/A/0", {"a_test_acc": 0.9})],
                                 "dataset string, pos bigint, experiment string, metrics map<string,double>")
    assert "Window" not in plan(best_models(rows))


def test_matrix_scans_once(stored):
    rows = stored.select(F.col("g").alias("error"), F.lit("positive").alias("fairness_impact"), F.lit("all").alias("accuracy_impact"))
    found = plan(impact_ops.impact_matrix(rows))
    assert found.count("FileScan") == 1 and "Join" not in found


def test_scratch_deletes_what_was_written_inside(spark, stored):
    with scratch(spark):
        inside = cut_lineage(stored.select("id"))
        assert inside.count() == 500
        path = inside.inputFiles()[0]
    assert not os.path.exists(path.removeprefix("file://"))
    kept = cut_lineage(stored.select("id"))
    assert kept.count() == 500


def test_distances_are_computed_once(spark, stored):
    """Cutting into slices passes over its input twice; the distances are written before."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return float(x)

    rows = stored.select("id", (F.col("id") % 2 == 0).alias("label"), F.array(counted("x0")).alias("features"))
    held = stored.limit(3).select("id", F.lit(True).alias("label"), F.array("x1").alias("features"))
    knn_shapley(rows, held, 3).collect()
    assert calls.value == 500


def test_cut_rows_are_stored_in_the_named_folder(spark, stored):
    cut = cut_lineage(stored.withColumn("r", F.rand()))
    assert checkpoint_dir(spark) in cut.inputFiles()[0]
    assert sorted(cut.collect()) == sorted(cut.collect())
    assert cut_lineage(stored.where("id < 0")).count() == 0
