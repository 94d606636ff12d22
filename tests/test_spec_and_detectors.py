import pytest
from pyspark.sql import functions as F

from veriparity.functions.values import nan_to_null
from veriparity.operators.audit import COUNTS, audit_dataset, audit_marked, audit_matrix, audit_rows, disparate_report, mislabel_polarity
from veriparity.operators.detectors import IQR, MISSING, SD, dirty_rows, outlier_bounds, with_flags
from veriparity.spec import Above, AuditSpec, Equals, LabelAtLeast, LabelIn, LabelNot


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_null_group_membership(spark):
    rows = spark.createDataFrame([(1, "W", 31), (2, "B", 30), (3, None, None)], "id int, race string, age int").orderBy("id")
    assert values(rows, Equals("race", "W").group()) == ["priv", "dis", "dis"]
    assert values(rows, Above("age", 30).group()) == ["priv", "dis", None]


def test_null_labels(spark):
    rows = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "id int, y int").orderBy("id")
    assert values(rows, LabelIn("y", (1,)).label()) == [True, False, False]
    assert values(rows, LabelAtLeast("y", 1).label()) == [True, False, False]
    assert values(rows, LabelNot("y", 1).label()) == [False, True, True]


def test_nan_groups_and_labels(spark):
    rows = spark.createDataFrame([(1, 40.0), (2, float("nan"))], "id int, x double").orderBy("id")
    assert values(rows, Above("x", 30).group()) == ["priv", None]
    assert values(rows, Equals("x", 40).group()) == ["priv", "dis"]
    assert values(rows, LabelAtLeast("x", 30).label()) == [True, False]
    assert values(rows, LabelNot("x", 40).label()) == [False, True]


def spec_of(**extra):
    return AuditSpec(
        name="toy", label=LabelIn("y", (1,)), groups={"g": Equals("g", "a"), "age": Above("x", 3)},
        numeric=("x",), categorical=("g",), not_for_prediction=("g",), id_col="id", **extra,
    )


def test_unknown_criterion_is_refused():
    with pytest.raises(ValueError, match="Unsupported: planet"):
        spec_of().group("planet")
    assert spec_of().categorical_for_prediction == ()
    assert spec_of().demographic_criteria == ("g", "age")


def test_hyphenated_columns(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, None)], "`row-id` int, `hours-per-week` double")
    _, flags = with_flags(rows, {MISSING: ["hours-per-week"]})
    assert values(rows.orderBy("`row-id`"), flags[MISSING]["hours-per-week"]) == [False, True]
    with pytest.raises(ValueError):
        with_flags(rows, {"luck": ["hours-per-week"]})


def test_nan_is_missing_and_never_an_outlier(spark):
    data = [(i, float(i % 5)) for i in range(50)] + [(50, float("nan")), (51, 1000.0)]
    rows = spark.createDataFrame(data, "id int, x double")
    assert values(dirty_rows(rows, ["x"], SD), "id") == [51]
    assert values(dirty_rows(rows, ["x"], MISSING), "id") == [50]
    assert values(dirty_rows(nan_to_null(rows), ["x"], MISSING), "id") == [50]


def test_iqr_null_policy(spark):
    data = [(i, float(i % 5)) for i in range(50)] + [(50, None), (51, 1000.0)]
    rows = spark.createDataFrame(data, "id int, x double")
    assert values(dirty_rows(rows, ["x"], IQR), "id") == []
    assert values(dirty_rows(rows, ["x"], IQR, nulls="skip"), "id") == [51]
    assert values(dirty_rows(rows, ["x"], IQR, nulls="skip", exact=False), "id") == [51]
    with pytest.raises(ValueError):
        dirty_rows(rows, ["x"], IQR, nulls="guess")


def test_infinite_values_flag_nothing_by_deviation(spark):
    rows = spark.createDataFrame([(i, float(i % 5)) for i in range(20)] + [(20, float("inf"))], "id int, x double")
    assert values(dirty_rows(rows, ["x"], SD), "id") == []
    assert values(dirty_rows(rows, ["x"], IQR), "id") == [20]


def test_limits(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "x double")
    got = {r.detector: (r.lo, r.hi) for r in outlier_bounds(rows, ["x"]).collect()}
    assert got[IQR] == pytest.approx((2 - 1.5 * 2, 4 + 1.5 * 2))
    assert got[SD] == pytest.approx((4 - 3 * 10**0.5, 4 + 3 * 10**0.5))


def test_limits_are_strict(spark):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 1, 1, 2, 2, 3, 3, 6])], "id int, x double")
    limits = outlier_bounds(rows, ["x"], [IQR]).first()
    assert limits.hi == 6.0
    assert values(dirty_rows(rows, ["x"], IQR), "id") == []


def test_matrix_equals_single_audits(spark):
    data = [(i, "a" if i % 3 else None, float(i % 7) if i % 11 else None, 1) for i in range(200)] + [(200, "a", 99.0, 0)]
    rows = spark.createDataFrame(data, "id int, g string, x double, y int")
    spec = spec_of()
    columns = {MISSING: ("g", "x"), SD: ("x",), IQR: ("x",)}
    matrix = audit_matrix(rows, spec, ["g", "age"], columns, nulls="skip")
    got = {(r.criteria, r.detector, r.column): tuple(r[c] for c in COUNTS) for r in matrix.collect()}
    assert len(got) == 8
    for (criteria, detector, column), counts in got.items():
        options = {} if detector == MISSING else {"nulls": "skip"}
        single = audit_rows(rows, spec, criteria, [column], detector, **options).first()
        assert counts == tuple(single[c] for c in COUNTS)


def test_dataset_audit_counts_every_detector(spark):
    data = [(i, "a" if i % 3 else None, float(i % 7) if i % 11 else None, 1) for i in range(200)] + [(200, "a", 99.0, 0)]
    rows = spark.createDataFrame(data, "id int, g string, x double, y int")
    got = {r.detector: r.dirty_priv + r.dirty_dis for r in audit_dataset(rows, spec_of(), "g", nulls="skip").collect()}
    missing = sum(g is None or x is None for _, g, x, _ in data)
    assert got == {MISSING: missing, SD: 1, IQR: 1}


def test_column_without_values(spark):
    rows = spark.createDataFrame([(i, "a", None, 1) for i in range(9)], "id int, g string, x double, y int")
    for r in audit_matrix(rows, spec_of(), ["g"], {SD: ("x",), IQR: ("x",)}, nulls="skip").collect():
        assert (r.n_priv, r.dirty_priv) == (9, 0)


def test_any_column_equals_union_of_slices(spark):
    data = [(i, 1.0 if i % 5 else None, 2.0 if i % 3 else None) for i in range(60)]
    rows = spark.createDataFrame(data, "id int, x double, z double")
    parts = dirty_rows(rows, ["x"], MISSING).union(dirty_rows(rows, ["z"], MISSING)).dropDuplicates(["id"])
    assert sorted(values(parts, "id")) == sorted(values(dirty_rows(rows, ["x", "z"], MISSING), "id"))


def test_marked_rows_and_report(spark):
    rows = spark.createDataFrame([(i, "a" if i < 500 else "b", 1.0, 1) for i in range(1000)], "id int, g string, x double, y int")
    marked = rows.where((F.col("id") % 10 == 0) & (F.col("id") < 500)).select("id")
    judged = audit_marked(rows, spec_of(), "g", marked)
    row = judged.first()
    assert (row.n_priv, row.dirty_priv, row.n_dis, row.dirty_dis) == (500, 50, 500, 0)
    assert row.disparate and row.pct_priv == 10.0
    assert disparate_report(judged).first().priv == "10.0% (50)"
    assert disparate_report(audit_marked(rows, spec_of(), "g", rows.limit(0).select("id"))).count() == 0


def test_polarity(spark):
    data = [("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 1)] * 5 + [("b", None)] * 25
    rows = spark.createDataFrame([(i, g, 0.0, y) for i, (g, y) in enumerate(data)], "id int, g string, x double, y int")
    row = mislabel_polarity(rows, spec_of(), "g").first()
    assert (row.flagged_priv, row.positive_priv, row.flagged_dis, row.positive_dis) == (40, 30, 30, 5)
    assert row.priv_higher and row.disparate
    assert row.negative_share_dis == pytest.approx(25 / 30)
    empty = mislabel_polarity(rows.limit(0), spec_of(), "g").first()
    assert empty.positive_share_priv is None and empty.disparate is False
