import math

import pytest
from pyspark.sql import functions as F

from veriparity.functions.significance import (
    erfc,
    g_disparate,
    g_or_null,
    g_p_value,
    impact_verdict,
    log_erfc,
    one_sided,
    paired_log_p,
    paired_p,
    paired_t,
    t_two_sided,
)

# dirty privileged / disadvantaged of 810 / 190, G, p, verdict
GOLDEN_G = [
    (155, 28, 1.776562, 0.182572, False),
    (142, 12, 16.518036, 0.000048, True),
    (266, 39, 11.042591, 0.000890, True),
    (10, 4, 0.309531, 0.577968, False),
    (55, 15, 0.140810, 0.707477, False),
    (21, 4, 0.016885, 0.896612, False),
    (59, 13, 0.003161, 0.955167, False),
    (7, 0, 0.802146, 0.370452, False),
    (23, 0, 6.424568, 0.011255, True),
    (6, 0, 0.539306, 0.462720, False),
    (149, 6, 34.131895, 0.0, True),
    (41, 7, 0.390951, 0.531800, False),
    (245, 27, 21.228490, 0.000004, True),
]


def test_g_test_golden_values(spark):
    rows = spark.createDataFrame([(810, a, 190, b) for a, b, *_ in GOLDEN_G], "np int, dp int, nd int, dd int")
    counts = [F.col(c) for c in ("np", "dp", "nd", "dd")]
    out = rows.withColumn("g", g_or_null(*counts)).select("dp", "dd", "g", g_p_value(F.col("g")).alias("p"), g_disparate(F.col("g")).alias("d"))
    got = {(r.dp, r.dd): r for r in out.collect()}
    for a, b, g, p, disparate in GOLDEN_G:
        assert got[a, b].g == pytest.approx(g, abs=1e-6)
        assert got[a, b].p == pytest.approx(p, abs=1e-6)
        assert got[a, b].d is disparate


def test_g_test_guard(spark):
    rows = spark.createDataFrame([(10, 0, 10, 0), (10, 10, 10, 3), (0, 0, 10, 3), (10, 3, 0, 0)], "a int, b int, c int, d int")
    g = g_or_null(*[F.col(c) for c in "abcd"])
    for r in rows.select(g.alias("g"), g_disparate(g).alias("d"), g_p_value(g).alias("p")).collect():
        assert r.g is None and r.p is None and r.d is False


def test_erfc_against_library(spark):
    rows = spark.createDataFrame([(i / 4,) for i in range(60)], "x double")
    for r in rows.select("x", erfc(F.col("x")).alias("e")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-12, abs=1e-300)


def test_erfc_falls_throughout(spark):
    """Tails far out keep their order: a stronger effect never has the larger p."""
    rows = spark.createDataFrame([(i / 50,) for i in range(1300)], "x double").select("x", erfc(F.col("x")).alias("e"))
    values = [r.e for r in rows.orderBy("x").collect()]
    assert all(a > b > 0 for a, b in zip(values, values[1:], strict=False))


def t_tail_by_sum(t, dof):
    """Finite trigonometric series for whole degrees of freedom (exact rational steps, long sums)."""
    theta = math.atan(abs(t) / math.sqrt(dof))
    c2 = math.cos(theta) ** 2
    if dof % 2:
        total, term = 0.0, math.cos(theta)
        for k in range(2, (dof - 1) // 2 + 2):
            total += term
            term *= c2 * (2 * k - 2) / (2 * k - 1)
        area = 2 / math.pi * (theta + (math.sin(theta) * total if dof > 1 else 0.0))
    else:
        total, term = 0.0, 1.0
        for k in range(2, dof // 2 + 2):
            total += term
            term *= c2 * (2 * k - 3) / (2 * k - 2)
        area = math.sin(theta) * total
    return 1 - area


def test_t_tail_is_one_formula_for_all_sizes(spark):
    cases = [(t, d) for d in (1, 2, 3, 7, 30, 199, 200, 201, 202, 1000, 5001) for t in (0.0, 1e-6, 0.3, 1.0, 2.0, 3.5, 5.0)]
    rows = spark.createDataFrame(cases, "t double, d int").select("t", "d", t_two_sided(F.col("t"), F.col("d")).alias("p"))
    for r in rows.collect():
        assert r.p == pytest.approx(t_tail_by_sum(r.t, r.d), rel=1e-7, abs=2e-13), (r.t, r.d)
    many = spark.createDataFrame([(2.0, 10**9), (30.0, 10**9), (30.0, 5)], "t double, d long")
    many = many.select(t_two_sided(F.col("t"), F.col("d")).alias("p")).collect()
    assert many[0].p == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-7)
    assert math.log(many[1].p) == pytest.approx(math.log(math.erfc(30 / math.sqrt(2))), rel=1e-6)
    assert many[2].p == pytest.approx(7.7e-7, rel=0.02)


def test_t_p_values(spark):
    at_level = [(2.262157, 9), (2.570582, 5), (2.228139, 10), (2.776445, 4), (12.7062, 1), (-2.228139, 10)]
    rows = spark.createDataFrame(at_level, "t double, dof int")
    for r in rows.select(t_two_sided(F.col("t"), F.col("dof")).alias("p")).collect():
        assert r.p == pytest.approx(0.05, abs=1e-6)


def test_t_series_and_expansion_agree_at_the_switch(spark):
    rows = spark.range(1, 60).select((F.col("id") / 10).alias("t"))
    near = rows.select("t", t_two_sided(F.col("t"), F.lit(200)).alias("a"), t_two_sided(F.col("t"), F.lit(201)).alias("b"))
    for r in near.collect():
        assert 0 <= r.a - r.b < 3e-4 * max(r.t, 1) * 0.01 + 1e-4


def test_many_degrees_of_freedom_stay_cheap(spark):
    row = spark.range(1).select(t_two_sided(F.lit(1.959963984540054), F.lit(10**12)).alias("p")).first()
    assert row.p == pytest.approx(0.05, abs=1e-9)


@pytest.mark.parametrize(
    "differences, t, p",
    [
        ([0.0, 0.0, 0.0], 0.0, 1.0),
        ([0.5, 0.5, 0.5, 0.5], math.inf, 0.0),
        ([-0.5, -0.5, -0.5], -math.inf, 0.0),
        ([0.7], 0.0, 1.0),
        ([], 0.0, 1.0),
        ([1.0, 2.0, 3.0], 3.4641016, 0.0741799),
    ],
)
def test_paired_t_edges(spark, differences, t, p):
    rows = spark.createDataFrame([(d,) for d in differences], "d double")
    m = rows.agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    m = m.withColumn("t", paired_t(F.col("n"), F.col("m"), F.col("s")))
    got = m.select("t", paired_p(F.col("n"), F.col("t")).alias("p")).first()
    assert got.t == pytest.approx(t) and got.p == pytest.approx(p, abs=1e-6)


def test_one_sided_and_verdicts(spark):
    rows = spark.createDataFrame([(-3.0, 0.004), (3.0, 0.004), (3.0, 0.02), (0.0, 1.0)], "t double, p double")
    t, p, alpha = F.col("t"), F.col("p"), F.lit(0.01)
    got = rows.select(
        one_sided(t, p, "positive").alias("up"),
        one_sided(t, p, "negative").alias("down"),
        impact_verdict(t, p, alpha, True).alias("fair"),
        impact_verdict(t, p, alpha, False).alias("acc"),
    ).collect()
    assert [(r.fair, r.acc) for r in got] == [
        ("positive", "negative"),
        ("negative", "positive"),
        ("insignificant", "insignificant"),
        ("insignificant", "insignificant"),
    ]
    assert got[0].down == pytest.approx(0.002) and got[0].up == pytest.approx(0.998)
    assert got[3].up == pytest.approx(0.5) and got[3].down == pytest.approx(0.5)
    with pytest.raises(ValueError):
        one_sided(t, p, "sideways")


def test_logarithms_of_tails(spark):
    """Equal to the logarithm of p where p is a number, and in order where it is 0."""
    xs = [0.0, 1e-6, 0.3, 1.0, 1.9999, 2.0001, 3.5, 6.0, 20.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", log_erfc(F.col("x")).alias("v")).collect()
    for r in rows:
        assert r["v"] == pytest.approx(math.log(math.erfc(r["x"])) if r["x"] < 26 and math.erfc(r["x"]) > 0 else r["v"], rel=1e-10, abs=1e-12)
    far = [r["v"] for r in spark.createDataFrame([(float(x),) for x in (30, 100, 1000)], "x double").select(log_erfc(F.col("x")).alias("v")).collect()]
    for x, v in zip((30, 100, 1000), far, strict=True):
        assert v == pytest.approx(-x * x - math.log(x * math.sqrt(math.pi)) - 1 / (2 * x * x), rel=1e-9)
    cases = [(2, 0.5), (2, 1e6), (30, 2.0), (30, -60.0), (1000, 5.0), (10**6, 100.0), (10**6, 1e4), (5, 0.0), (1, 3.0)]
    got = spark.createDataFrame(cases, "n long, t double").select(
        "n", "t", paired_p(F.col("n"), F.col("t")).alias("p"), paired_log_p(F.col("n"), F.col("t")).alias("log_p")
    ).collect()
    for r in got:
        assert math.isfinite(r["log_p"]) and r["log_p"] <= 0
        if r["p"] > 1e-300:
            assert r["log_p"] == pytest.approx(math.log(r["p"]), rel=1e-9, abs=1e-12)
    by = {(r["n"], r["t"]): r["log_p"] for r in got}
    assert by[10**6, 1e4] < by[10**6, 100.0] < by[30, -60.0]
    assert spark.range(1).select(paired_log_p(F.lit(5), F.lit(float("inf")))).first()[0] == float("-inf")
