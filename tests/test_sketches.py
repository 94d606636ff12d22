"""Sketches of columns: their rank error, merging, missing values, and one scan for all columns."""

import random

import pytest
from pyspark.sql import functions as F

from veriparity.operators.audit import audit_criteria, listed_columns
from veriparity.operators.configured import audit_cases, mislabel_cases
from veriparity.operators.sketches import RANK_ERROR, column_sketches, merged_sketches, sketch_quantiles
from veriparity.spec import AuditSpec, Equals, LabelIn

PROBS = (0.01, 0.25, 0.5, 0.9)


def test_merged_sketches_are_within_their_bound(spark):
    rng = random.Random(2)
    rows = [("a" if i % 3 else "b", rng.lognormvariate(0, 2), float(i % 50)) for i in range(30_000)]
    rows += [("a", None, float("nan")), ("c", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, z double").repartition(6)
    parts = [column_sketches(df.where(F.xxhash64("x", "z") % 3 == k), ["x", "z"], ["g"]) for k in (-2, -1, 0, 1, 2)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    found = {(r["g"], r["column"]): r for r in sketch_quantiles(merged_sketches(whole, ["g"]), PROBS).collect()}
    for g in "ab":
        for i, c in enumerate(("x", "z")):
            values = sorted(r[1 + i] for r in rows if r[0] == g and r[1 + i] is not None and r[1 + i] == r[1 + i])
            r = found[g, c]
            assert r["n"] == len(values) and r["n_missing"] == (1 if g == "a" else 0)
            for j, p in enumerate(PROBS):
                below, upto = (sum(v < r[f"q{j}"] for v in values), sum(v <= r[f"q{j}"] for v in values))
                assert below / len(values) <= p + RANK_ERROR and upto / len(values) >= p - RANK_ERROR
    assert found["c", "x"]["n"] == 0 and found["c", "x"]["q2"] is None


def test_one_scan(spark, tmp_path):
    spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"), F.rand(1).alias("z")).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = lambda df: df._jdf.queryExecution().explainString(mode)
    assert plan(column_sketches(stored, ["x", "z"], ["g"])).count("FileScan") == 1
    spec = AuditSpec(
        name="t", label=LabelIn("g", (1,)), groups={f"g{i}": Equals("g", i) for i in range(3)}, numeric=("x", "z"), id_col="x"
    )
    one, all_three = (audit_cases({"t": (stored, spec)}, [("t", f"g{i}") for i in range(n)]) for n in (1, 3))
    assert plan(one).count("FileScan") == plan(all_three).count("FileScan")
    assert {(r["dataset"], r["criteria"]) for r in all_three.collect()} == {("t", f"g{i}") for i in range(3)}


def test_criteria_together_are_those_alone(spark):
    rows = spark.range(300).select(
        "id", (F.col("id") % 2).alias("y"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.0).alias("x")
    )
    spec = AuditSpec(name="t", label=LabelIn("y", (1,)), groups={"g": Equals("g", 1), "y": Equals("y", 1)}, numeric=("x",), id_col="id")
    both = audit_criteria(rows, spec, ["g", "y"], listed_columns(spec), nulls="skip")
    for c in ("g", "y"):
        alone = audit_criteria(rows, spec, [c], listed_columns(spec), nulls="skip")
        assert sorted(map(tuple, both.where(F.col("criteria") == c).collect())) == sorted(map(tuple, alone.collect()))
    with pytest.raises(KeyError):
        audit_cases({"t": (rows, spec)}, [("u", "g")])
    with pytest.raises(ValueError, match="no cases"):
        mislabel_cases({"t": (rows, spec)}, [])
