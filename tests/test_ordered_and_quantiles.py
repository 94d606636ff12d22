import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veriparity.operators.ordered import SLICE, ranked, running_sums, slice_by
from veriparity.operators.quantiles import exact_percentiles, order_statistics


def skewed(spark, n=3000):
    """A third of the rows in one group and, within it, most at one value."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        group = "hot" if hot else rng.choice(["a", "b", None])
        value = 5.0 if hot and i % 2 else rng.uniform(-100, 100)
        rows.append((i, group, value))
    return spark.createDataFrame(rows, "id int, g string, v double")


def test_ranks_match_a_window(spark):
    rows = skewed(spark)
    plain = rows.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    got = ranked(rows, ["g"], ["v", "id"]).join(plain.select("id", "want"), "id")
    assert got.count() == rows.count()
    assert got.where(F.col("rn") != F.col("want")).count() == 0


def test_hot_group_spans_slices(spark):
    sliced = slice_by(skewed(spark), ["g"], ["v", "id"])
    assert sliced.where("g = 'hot'").select(SLICE).distinct().count() > 1


def test_running_sums_both_ways(spark):
    rows = skewed(spark)
    sliced = slice_by(rows, ["g"], ["v", "id"])
    up = running_sums(sliced, ["g"], ["v", "id"], {"up": F.col("id")}).select("id", "up")
    down = running_sums(sliced, ["g"], ["v", "id"], {"down": F.col("id")}, backward=True).select("id", "down")
    total = rows.groupBy("g").agg(F.sum("id").alias("total"))
    joined = rows.join(up, "id").join(down, "id").join(total, F.col("total").isNotNull() & rows.g.eqNullSafe(total.g))
    assert joined.count() == rows.count()
    assert joined.where(F.col("up") + F.col("down") - F.col("id") != F.col("total")).count() == 0


@pytest.mark.parametrize("case", ["mixed", "whole", "constant", "tiny", "far", "one"])
def test_percentiles_match_numpy(spark, case):
    rng = np.random.default_rng(3)
    data = {
        "mixed": np.concatenate([rng.normal(0, 1, 2000), np.zeros(1000), [1e9, -1e9, 1e300]]),
        "whole": rng.integers(-50, 50, 1000).astype(float),
        "constant": np.full(100, 7.25),
        "tiny": rng.uniform(0, 1e-12, 500),
        "far": 1.7e15 + rng.uniform(0, 1000, 2000),
        "one": np.array([3.5]),
    }[case]
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    rows = spark.createDataFrame([("x", float(v)) for v in data] + [("x", None), ("x", float("nan"))], "c string, v double")
    got = exact_percentiles(rows, ["c"], "v", probs).first()
    want = list(np.quantile(data, probs))
    assert [got[f"q{i}"] for i in range(len(probs))] == pytest.approx(want, rel=1e-12)
    assert [got[f"q{i}"] for i in (0, 2, 3, 4, 6)] == [want[i] for i in (0, 2, 3, 4, 6)]


def test_percentiles_per_group(spark):
    rows = skewed(spark).where("g IS NOT NULL")
    got = {r.g: (r.q0, r.q1) for r in exact_percentiles(rows, ["g"], "v", (0.25, 0.75)).collect()}
    pdf = rows.toPandas()
    for g, part in pdf.groupby("g"):
        assert got[g] == tuple(np.percentile(part.v, [25, 75]))


def test_crowded_values_stay_in_bounded_cells(spark):
    """Two million values near each other and one far off: no scan hands on more than its cells."""
    rows = spark.range(2_000_000).select(F.lit("c").alias("c"), (1.5e9 + F.col("id") * 1e-6).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("c", 1.51e9)], "c string, v double"))
    got = exact_percentiles(rows, ["c"], "v", (0.25, 0.75))
    row = got.first()
    assert row.q0 == pytest.approx(1.5e9 + 0.5, abs=1e-6) and row.q1 == pytest.approx(1.5e9 + 1.5, abs=1e-6)
    plan = got._jdf.queryExecution().executedPlan()
    widest = max(most_rows(plan, "Window"))
    assert widest <= 4 * (1 << 16)  # cells of a scan for each of the four wanted ranks


def most_rows(plan, name):
    """Rows that came out of the operators below each node of that name, as far as they are counted."""
    found, work = [0], [plan]
    while work:
        node = work.pop()
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            work.append(node.executedPlan())
            continue
        if "QueryStage" in kind:
            work.append(node.plan())
            continue
        children = node.children()
        for i in range(children.size()):
            work.append(children.apply(i))
        if kind == "Sort":  # below a window lies its sort, below that the exchange with the cells
            below = node
            while below.children().size() == 1 and not below.metrics().contains("numOutputRows"):
                below = below.children().apply(0)
                if "QueryStage" in below.nodeName():
                    below = below.plan()
                if below.metrics().contains("shuffleRecordsWritten"):
                    found.append(below.metrics().apply("shuffleRecordsWritten").value())
                    break
    return found


@pytest.mark.parametrize("values", [
    [1e-300, 2e-300, 1e-5, 3.0, -1e-310, 5e-324, 0.0, -0.0], [float("inf"), float("-inf"), 1.0, 2.0, 3.0],
    [1.0 + i * 2**-52 for i in range(40)], [-(2.0**k) for k in range(-60, 60)], [7.0] * 9,
])
def test_ranks_of_awkward_values(spark, values):
    rows = spark.createDataFrame([("g", v) for v in values], "g string, v double")

    def every(cells):
        return cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(values) - 1))).alias("target")).select(
            "*", F.col("target").cast("bigint").alias("rank")
        )

    for few in (True, False):
        got = order_statistics(rows, ["g"], "v", every, few_groups=few).orderBy("target").collect()
        assert [r.value for r in got] == sorted(values)
