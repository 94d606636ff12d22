"""Queries: missing values, outliers, group partitions, labels and disparity."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriparity.functions.significance import g_log_p, g_or_null
from veriparity.operators.audit import (
    COUNTS,
    audit_dataset,
    audit_detectors,
    audit_flag,
    audit_matrix,
    audit_rows,
    count_groups,
    disparate_report,
    judge,
)
from veriparity.operators.configured import audit_cases, run_configurations
from veriparity.operators.detectors import IQR, MISSING, SD, dirty_rows, is_missing, long_numbers
from veriparity.operators.sketches import RANK_ERROR, column_sketches, merged_sketches, sketch_quantiles
from veriparity.plans.check_sql import audit_sql, counts_sql, g_sql, log_erfc_sql
from veriparity.plans.registry import query, r, rounded, table
from veriparity.plans.standins import DOC_SPEC, DOC_SQL, EVENT_NA, EVENT_SPEC, EVENT_SQL, doc_audit, event_audit
from veriparity.sources.delimited import normalise
from veriparity.spec import DIS, PRIV, Above, Equals, LabelAtLeast, LabelIn, LabelNot


def events_with_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the property number, two of whose values count as missing."""
    normal = normalise(event_audit(spark, sf_dir), EVENT_NA, ["k_text"])
    return normal.withColumn("k", F.col("k_text").cast("int"))


def _limits_sql(view: str, columns: list[str], detector: str) -> str:
    """One-row SQL table ``lim`` with limits ``{c}_lo, {c}_hi``; IQR limits need a column without gaps."""
    parts = []
    for c in columns:
        if detector == SD:
            lo, hi = f"avg({c}) - 3 * stddev_pop({c})", f"avg({c}) + 3 * stddev_pop({c})"
        else:
            q1, q3 = f"quantile_cont({c}::DOUBLE, 0.25)", f"quantile_cont({c}::DOUBLE, 0.75)"
            whole = f"count({c}) = count(*)"
            lo = f"CASE WHEN {whole} THEN {q1} - 1.5 * ({q3} - {q1}) END"
            hi = f"CASE WHEN {whole} THEN {q3} + 1.5 * ({q3} - {q1}) END"
        parts.append(f"{lo} AS {c}_lo, {hi} AS {c}_hi")
    return f"(SELECT {', '.join(parts)} FROM {view}) lim"


def _outside_sql(columns: list[str]) -> str:
    return " OR ".join(f"coalesce({c} > {c}_hi OR {c} < {c}_lo, FALSE)" for c in columns)


def _outlier_audit_sql(with_sql: str, view: str, grp: str, columns: list[str], detector: str) -> str:
    counts = (
        f"SELECT {counts_sql(grp, '(' + _outside_sql(columns) + ')')} "
        f"FROM {view}, {_limits_sql(view, columns, detector)}"
    )
    return f"WITH {with_sql} {audit_sql(counts)}"


@query("missing_by_group", f"WITH {DOC_SQL} " + audit_sql(f"SELECT {counts_sql('grp', 'quality IS NULL')} FROM doc_audit"))
def missing_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_audit(spark, sf_dir)
    return rounded(audit_flag(docs, DOC_SPEC, "lang", is_missing(docs, "quality")))


@query("outliers_sd_by_group", _outlier_audit_sql(DOC_SQL, "doc_audit", "grp", ["n_chars"], SD))
def outliers_sd_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit_rows(doc_audit(spark, sf_dir), DOC_SPEC, "lang", ["n_chars"], SD))


@query("outliers_iqr_by_group", _outlier_audit_sql(DOC_SQL, "doc_audit", "grp", ["n_chars"], IQR))
def outliers_iqr_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit_rows(doc_audit(spark, sf_dir), DOC_SPEC, "lang", ["n_chars"], IQR))


@query(
    "missing_any_by_group",
    f"WITH {EVENT_SQL} "
    + audit_sql(f"SELECT {counts_sql('by_type', '(k IS NULL OR value IS NULL OR event_type IS NULL)')} FROM event_audit"),
)
def missing_any_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_with_k(spark, sf_dir)
    return rounded(audit_rows(events, EVENT_SPEC, "purchase", ["event_type", "value", "k"], MISSING))


_NUMBERS = ["value", "k", "user_id"]


def _any_sql(detector: str, limits: str) -> str:
    counts = counts_sql("by_user", "(" + _outside_sql(_NUMBERS) + ")")
    return f"SELECT '{detector}' AS detector, {counts} FROM event_audit, {limits}"


_ANY_SQL = [_any_sql(d, _limits_sql("event_audit", _NUMBERS, d)) for d in (SD, IQR)]
_SKIP_SQL = _any_sql(IQR, _limits_sql("event_audit", _NUMBERS, IQR).replace("count(k) = count(*)", "TRUE"))
_ANY_MISSING_SQL = (
    f"SELECT '{MISSING}' AS detector, "
    + counts_sql("by_user", "(event_type IS NULL OR value IS NULL OR k IS NULL OR user_id IS NULL)")
    + " FROM event_audit"
)


@query("outliers_any_by_group", f"WITH {EVENT_SQL} " + audit_sql(" UNION ALL ".join(_ANY_SQL), "detector"))
def outliers_any_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any numeric column outside its limits; a missing ``k`` leaves that column without quartiles."""
    return rounded(audit_detectors(events_with_k(spark, sf_dir), EVENT_SPEC, "user", {SD: _NUMBERS, IQR: _NUMBERS}))


@query("outliers_any_nulls_skipped", f"WITH {EVENT_SQL} " + audit_sql(_SKIP_SQL, "detector"))
def outliers_any_nulls_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with quartiles of the values that are present."""
    events = events_with_k(spark, sf_dir)
    return rounded(audit_detectors(events, EVENT_SPEC, "user", {IQR: _NUMBERS}, nulls="skip"))


@query("audit_dataset", f"WITH {EVENT_SQL} " + audit_sql(" UNION ALL ".join([*_ANY_SQL, _ANY_MISSING_SQL]), "detector"))
def audit_dataset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All column errors of a dataset in one audit."""
    return rounded(audit_dataset(events_with_k(spark, sf_dir), EVENT_SPEC, "user"))


@query(
    "outlier_rows",
    f"WITH {EVENT_SQL} SELECT event_id, user_id, value, k FROM event_audit, "
    f"{_limits_sql('event_audit', ['value', 'k'], SD)} WHERE {_outside_sql(['value', 'k'])}",
)
def outlier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagged rows themselves, each once."""
    return dirty_rows(events_with_k(spark, sf_dir), ["value", "k"], SD).select("event_id", "user_id", "value", "k")


@query(
    "gtest_missing",
    f"WITH {DOC_SQL} "
    + audit_sql(f"SELECT source, {counts_sql('grp', 'quality IS NULL')} FROM doc_audit GROUP BY source", "source"),
)
def gtest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One G-test per source."""
    docs = doc_audit(spark, sf_dir)
    counts = docs.groupBy("source").agg(*count_groups(DOC_SPEC.group("lang"), is_missing(docs, "quality")))
    return rounded(judge(counts))


@query(
    "gtest_log_p",
    f"""WITH {DOC_SQL} SELECT source, {r('g')} AS g, {r('CASE WHEN g IS NOT NULL THEN ' + log_erfc_sql('sqrt(greatest(g, 0) / 2)') + ' END')} AS log_p
        FROM (SELECT *, {g_sql('n_priv', 'dirty_priv', 'n_dis', 'dirty_dis')} AS g FROM (
            SELECT lang AS source, {counts_sql("(CASE WHEN n_chars > 1500 THEN 'priv' ELSE 'dis' END)", 'quality IS NULL')} FROM doc_audit GROUP BY lang
            UNION ALL SELECT 'lengths', {counts_sql("(CASE WHEN lang = 'en' THEN 'priv' ELSE 'dis' END)", 'n_chars > 1500')} FROM doc_audit
            UNION ALL SELECT 'itself', {counts_sql("(CASE WHEN n_chars > 1500 THEN 'priv' ELSE 'dis' END)", "n_chars > 1400 AND source <> 'src0'")} FROM doc_audit))""",
)
def gtest_log_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-tests from clearly insignificant to one whose p is 0 to any printed digits, told apart by log p."""
    docs = doc_audit(spark, sf_dir)
    long = F.when(F.col("n_chars") > 1500, PRIV).otherwise(DIS)
    counts = docs.groupBy(F.col("lang").alias("source")).agg(*count_groups(long, F.col("quality").isNull()))
    whole = docs.agg(*count_groups(F.when(F.col("lang") == "en", PRIV).otherwise(DIS), F.col("n_chars") > 1500))
    same = docs.agg(*count_groups(long, (F.col("n_chars") > 1400) & (F.col("source") != "src0")))
    for name, more in (("lengths", whole), ("itself", same)):
        counts = counts.unionByName(more.withColumn("source", F.lit(name)))
    g = g_or_null(*[F.col(c) for c in COUNTS])
    return rounded(counts.select("source", g.alias("g")).withColumn("log_p", g_log_p(F.col("g"))))


_SKETCHED = ("l_quantity", "l_extendedprice")
_SKETCH_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query(
    "quantile_sketches",
    " UNION ALL ".join(
        f"""SELECT l_returnflag, '{c}' AS "column", count({c}) AS n, TRUE AS within FROM lineitem GROUP BY l_returnflag"""
        for c in _SKETCHED
    ),
)
def quantile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of two arrivals of rows, merged: whether each quantile's rank among all rows is within its bound."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *_SKETCHED)
    arrivals = [column_sketches(items.where(F.col("l_orderkey") % 2 == half), _SKETCHED, ["l_returnflag"]) for half in (0, 1)]
    found = sketch_quantiles(merged_sketches(arrivals[0].unionAll(arrivals[1]), ["l_returnflag"]), _SKETCH_PROBS)
    # one row per group and column
    cells = long_numbers(items, _SKETCHED, ["l_returnflag"]).join(F.broadcast(found), ["l_returnflag", "column"])
    ranks = [(F.count_if(F.col("value") < F.col(f"q{i}")), F.count_if(F.col("value") <= F.col(f"q{i}"))) for i in range(len(_SKETCH_PROBS))]
    close = [
        (below / F.first("n") <= p + RANK_ERROR) & (upto / F.first("n") >= p - RANK_ERROR)
        for p, (below, upto) in zip(_SKETCH_PROBS, ranks, strict=True)
    ]
    return cells.groupBy("l_returnflag", "column").agg(F.first("n").alias("n"), reduce(and_, close).alias("within"))


_MATRIX_COLUMNS = {MISSING: ("value", "k", "event_type"), SD: ("value", "k", "user_id"), IQR: ("value", "k", "user_id")}


def _matrix_sql() -> str:
    parts = []
    for criteria, grp in (("purchase", "by_type"), ("user", "by_user")):
        for detector, columns in _MATRIX_COLUMNS.items():
            for c in columns:
                if detector == MISSING:
                    dirty, source = f"{c} IS NULL", "event_audit"
                else:
                    dirty, source = _outside_sql([c]), f"event_audit, {_limits_sql('event_audit', [c], detector)}"
                parts.append(
                    f"SELECT '{criteria}' AS criteria, '{detector}' AS detector, '{c}' AS \"column\", "
                    f"{counts_sql(grp, dirty)} FROM {source}"
                )
    return " UNION ALL ".join(parts)


@query("audit_matrix", f"WITH {EVENT_SQL} " + audit_sql(_matrix_sql(), 'criteria, detector, "column"'))
def audit_matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column under every detector and criterion."""
    return rounded(audit_matrix(events_with_k(spark, sf_dir), EVENT_SPEC, ["purchase", "user"], _MATRIX_COLUMNS))


def _doc_matrix_sql() -> str:
    parts = []
    for detector, c in ((MISSING, "quality"), (MISSING, "toxic"), (SD, "n_chars"), (IQR, "n_chars")):
        for criteria, grp in (
            ("lang", "grp"),
            ("quality", "CASE WHEN quality IS NOT DISTINCT FROM 1 THEN 'priv' ELSE 'dis' END"),
        ):
            if detector == MISSING:
                dirty, source = f"{c} IS NULL", "doc_audit"
            else:
                dirty, source = _outside_sql([c]), f"doc_audit, {_limits_sql('doc_audit', [c], detector)}"
            parts.append(
                f"SELECT '{criteria}' AS criteria, '{detector}' AS detector, '{c}' AS \"column\", "
                f"{counts_sql(grp, dirty)} FROM {source}"
            )
    return " UNION ALL ".join(parts)


@query(
    "disparate_report",
    f"WITH {DOC_SQL} SELECT criteria, detector, \"column\", "
    "format('{:.1f}% ({})', round(100.0 * dirty_priv / n_priv, 1), dirty_priv) AS priv, "
    "format('{:.1f}% ({})', round(100.0 * dirty_dis / n_dis, 1), dirty_dis) AS dis FROM ("
    + audit_sql(_doc_matrix_sql(), 'criteria, detector, "column"')
    + ") WHERE disparate",
)
def disparate_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the significant differences, as report cells."""
    columns = {MISSING: ("quality", "toxic"), SD: ("n_chars",), IQR: ("n_chars",)}
    matrix = audit_matrix(doc_audit(spark, sf_dir), DOC_SPEC, ["lang", "quality"], columns)
    return disparate_report(matrix).select("criteria", "detector", "column", "priv", "dis")


@query(
    "na_normalise",
    f"""WITH {EVENT_SQL} SELECT event_type, count(*) AS n, count(k) AS n_present,
        count(*) - count(k) AS n_missing, CAST(sum(k) AS BIGINT) AS sum_k FROM event_audit GROUP BY event_type""",
)
def na_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_with_k(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("k").alias("n_present"),
        F.count_if(F.col("k").isNull()).alias("n_missing"),
        F.sum("k").alias("sum_k"),
    )


_LABELS_SQL = (
    ("is_one", "coalesce(quality = 1, FALSE)"),
    ("in_list", "coalesce(lang IN ('de', 'fr'), FALSE)"),
    ("at_least", "coalesce(n_chars >= 1000, FALSE)"),
    ("toxic_at_least", "coalesce(toxic >= 1, FALSE)"),
    ("is_not_one", "quality IS DISTINCT FROM 1"),
)


@query(
    "label_rate_by_group",
    f"WITH {DOC_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS rule, grp, count(*) AS n, count(*) FILTER (WHERE {rule}) AS n_true, "
        f"{r(f'avg(CASE WHEN {rule} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS rate FROM doc_audit GROUP BY grp"
        for name, rule in _LABELS_SQL
    ),
)
def label_rate_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label rule on a column with missing values, in one pass."""
    rules = {
        "is_one": LabelIn("quality", (1,)),
        "in_list": LabelIn("lang", ("de", "fr")),
        "at_least": LabelAtLeast("n_chars", 1000),
        "toxic_at_least": LabelAtLeast("toxic", 1),
        "is_not_one": LabelNot("quality", 1),
    }
    docs = DOC_SPEC.partition_by(doc_audit(spark, sf_dir), "lang")
    counts = [F.count_if(rule.label()).alias(name) for name, rule in rules.items()]
    counted = docs.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *counts)
    per_rule = [F.struct(F.lit(name).alias("rule"), F.col(name).alias("n_true")) for name in rules]
    spread = counted.select("grp", "n", F.inline(F.array(*per_rule)))
    return rounded(spread.select("rule", "grp", "n", "n_true", (F.col("n_true") / F.col("n")).alias("rate")))


@query(
    "group_partition_eq",
    f"""WITH {DOC_SQL} SELECT grp, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (
        SELECT n_chars, CASE WHEN quality IS NOT DISTINCT FROM 1 THEN 'priv' ELSE 'dis' END AS grp FROM doc_audit)
        GROUP BY grp""",
)
def group_partition_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing value is disadvantaged."""
    rows = doc_audit(spark, sf_dir).withColumn("grp", Equals("quality", 1).group())
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "group_partition_range",
    f"""WITH {DOC_SQL} SELECT grp, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (
        SELECT n_chars, CASE WHEN quality > 0 THEN 'priv' WHEN quality <= 0 THEN 'dis' END AS grp FROM doc_audit)
        GROUP BY grp""",
)
def group_partition_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing value is in neither group."""
    rows = doc_audit(spark, sf_dir).withColumn("grp", Above("quality", 0).group())
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


# --- several datasets in one report --------------------------------------------------------------------

_CASES = (("documents", "lang"), ("documents", "toxicity"), ("events", "user"), ("events", "purchase"))
_CASE_GROUP_SQL = {
    ("documents", "lang"): "grp",
    ("documents", "toxicity"): "CASE WHEN toxic > 0 THEN 'priv' WHEN toxic <= 0 THEN 'dis' END",
    ("events", "user"): "by_user",
    ("events", "purchase"): "by_type",
}
_CASE_SQL = {
    "documents": ("doc_audit", ["n_chars"], "(lang IS NULL OR source IS NULL OR n_chars IS NULL)"),
    "events": ("event_audit", _NUMBERS, "(event_type IS NULL OR value IS NULL OR k IS NULL OR user_id IS NULL)"),
}


def _cases_sql() -> str:
    parts = []
    for case in _CASES:
        view, numbers, missing = _CASE_SQL[case[0]]
        for detector in (MISSING, SD, IQR):
            limits = "" if detector == MISSING else f", {_limits_sql(view, numbers, detector)}"
            dirty = missing if detector == MISSING else f"({_outside_sql(numbers)})"
            counts = counts_sql(f"({_CASE_GROUP_SQL[case]})", dirty)
            named = f"'{case[0]}' AS dataset, '{case[1]}' AS criteria, '{detector}' AS detector"
            parts.append(f"SELECT {named}, {counts} FROM {view}{limits}")
    return f"WITH {DOC_SQL}, {EVENT_SQL} " + audit_sql(" UNION ALL ".join(parts), "dataset, criteria, detector")


@query("audit_cases", _cases_sql())
def audit_cases_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main report over two datasets with two criteria each."""
    tables = {"documents": (doc_audit(spark, sf_dir), DOC_SPEC), "events": (events_with_k(spark, sf_dir), EVENT_SPEC)}
    return rounded(audit_cases(tables, _CASES))


_LISTED = (
    ("events", "user", MISSING, ("event_type", "k")),
    ("events", "purchase", SD, ("value", "k")),
    ("events", "user", IQR, ("value", "user_id")),
    ("documents", "lang", SD, ("n_chars",)),
)


def _listed_sql() -> str:
    parts = []
    for name, criteria, detector, columns in _LISTED:
        for c in columns if name == "events" else ():
            limits = "" if detector == MISSING else f", {_limits_sql('event_audit', [c], detector)}"
            dirty = f"({c} IS NULL)" if detector == MISSING else f"({_outside_sql([c])})"
            named = f"""'{criteria}' AS criteria, '{detector}' AS detector, '{c}' AS "column" """
            parts.append(f"SELECT {named}, {counts_sql(_CASE_GROUP_SQL[name, criteria], dirty)} FROM event_audit{limits}")
    return f"WITH {EVENT_SQL} " + audit_sql(" UNION ALL ".join(parts), 'criteria, detector, "column"')


@query("audit_configurations", _listed_sql())
def audit_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed audits of one dataset."""
    return rounded(run_configurations(events_with_k(spark, sf_dir), EVENT_SPEC, _LISTED))
