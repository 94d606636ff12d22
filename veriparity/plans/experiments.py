"""Queries: from experiment results to the impact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriparity.functions.significance import ALPHA, impact_verdict, one_sided, paired_log_p
from veriparity.operators import experiments as ops
from veriparity.plans.check_sql import paired_p_sql, t_log_p_sql, t_sql
from veriparity.plans.registry import query, r, rounded
from veriparity.plans.standins import (
    EXPERIMENT_CRITERIA,
    EXPERIMENTS_SQL,
    RUNS_SQL,
    experiments,
    runs,
)
from veriparity.sources.results import TEXT_METRICS, metric_rows, numeric_metrics, parse_documents


def parsed_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in experiments after a round trip through JSON text."""
    text = experiments(spark, sf_dir)
    return text.withColumn("metrics", numeric_metrics(F.from_json("metrics", TEXT_METRICS)))


def _metric_names_sql() -> str:
    """One SELECT per metric name over ``experiments``."""
    parts = []
    for dataset, criteria, by in EXPERIMENT_CRITERIA:
        for side in ("priv", "dis"):
            for cell in ("tp", "tn", "fp", "fn"):
                parts.append(
                    f"SELECT *, prefix || '__{criteria}_{side}__{cell}' AS metric_name, "
                    f"{by}_{side}__{cell}::DOUBLE AS value FROM experiments WHERE dataset = '{dataset}'"
                )
    parts.append("SELECT *, prefix || '_test_acc' AS metric_name, hits::DOUBLE / rows AS value FROM experiments")
    return " UNION ALL ".join(parts)


@query(
    "experiment_facts",
    f"""WITH {EXPERIMENTS_SQL} SELECT dataset, error, model, split_seed::VARCHAR AS split_seed, train_method,
        retrain_seed::VARCHAR AS retrain_seed, metric_name, {r('value')} AS value FROM ({_metric_names_sql()})""",
)
def experiment_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result text to one typed row per experiment and metric."""
    parsed = ops.with_models(ops.parse_keys(parsed_experiments(spark, sf_dir)))
    columns = ["dataset", "error", "model", "split_seed", "train_method", "retrain_seed", "metric_name", "value"]
    return rounded(metric_rows(parsed).select(*columns))


@query(
    "method_parse",
    f"""WITH {EXPERIMENTS_SQL} SELECT error, train_method,
        CASE error WHEN 'missing_values' THEN '' WHEN 'mislabel' THEN split_part(train_method, '-', 1)
            ELSE replace(split_part(train_method, '_impute', 1), 'clean_', '') END AS detection,
        CASE error WHEN 'missing_values' THEN train_method WHEN 'mislabel' THEN split_part(train_method, '-', 2)
            ELSE 'impute_' || split_part(train_method, '_impute', 2) END AS repair,
        count(DISTINCT (dataset, model, split_seed, retrain_seed)) AS runs
        FROM experiments WHERE train_method NOT IN ('dirty', 'delete') GROUP BY ALL""",
)
def method_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = ops.training_runs(parsed_experiments(spark, sf_dir)).where(~F.col("is_baseline"))
    counted = cleaned.groupBy("error", "train_method").agg(F.count(F.lit(1)).alias("runs"))
    names = ops.split_method(F.col("error"), F.col("train_method"))
    return counted.select("error", "train_method", *[c.alias(n) for n, c in names.items()], "runs")


_PAIRS_SQL = """pairs AS (
    SELECT t.method, t.user_id, t.score - b.score AS score, t.accuracy - b.accuracy AS accuracy
    FROM runs t JOIN runs b ON b.user_id = t.user_id AND b.method = 'view' WHERE t.method <> 'view')"""


def _tested_sql(measure: str) -> str:
    moments = (
        f"SELECT method, count({measure}) AS n, avg({measure}) AS mean, stddev_samp({measure}) AS sd "
        "FROM pairs GROUP BY method"
    )
    return (
        f"SELECT *, {paired_p_sql('n', 't')} AS p FROM (SELECT *, {t_sql('n', 'mean', 'sd')} AS t FROM ({moments}))"
    )


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.paired_changes(runs(spark, sf_dir), ["user_id"], "method", "view", ["score", "accuracy"])


@query(
    "paired_ttest",
    f"""WITH {RUNS_SQL}, {_PAIRS_SQL} SELECT method, n, {r('t')} AS t, {r('p')} AS p_two,
        {r('CASE WHEN t > 0 THEN p / 2 ELSE 1 - p / 2 END')} AS p_positive,
        {r('CASE WHEN t < 0 THEN p / 2 ELSE 1 - p / 2 END')} AS p_negative FROM ({_tested_sql('score')})""",
)
def paired_ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method against the baseline, user by user."""
    tested = ops.paired_tests(user_changes(spark, sf_dir), ["method"], ["score"])
    t, p = F.col("score_t"), F.col("score_p")
    return rounded(
        tested.select(
            "method",
            F.col("score_n").alias("n"),
            t.alias("t"),
            p.alias("p_two"),
            one_sided(t, p, "positive").alias("p_positive"),
            one_sided(t, p, "negative").alias("p_negative"),
        )
    )


@query(
    "paired_log_p",
    f"""WITH {RUNS_SQL}, {_PAIRS_SQL} SELECT method, n, {r('t')} AS t,
        {r("CASE WHEN n < 2 OR t = 0 THEN 0 ELSE " + t_log_p_sql('t', '(n - 1)') + " END")} AS log_p FROM ({_tested_sql('score')})""",
)
def paired_log_p_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method against the baseline, with the logarithm of p."""
    tested = ops.paired_tests(user_changes(spark, sf_dir), ["method"], ["score"])
    n, t = F.col("score_n"), F.col("score_t")
    return rounded(tested.select("method", n.alias("n"), t.alias("t"), paired_log_p(n, t).alias("log_p")))


def _verdict_sql(t: str, p: str, alpha: str, fell: str, rose: str) -> str:
    return (
        f"CASE WHEN {p} < {alpha} AND {t} < 0 THEN '{fell}' WHEN {p} < {alpha} AND {t} > 0 THEN '{rose}' "
        "ELSE 'insignificant' END"
    )


@query(
    "impact_verdict",
    f"""WITH {RUNS_SQL}, {_PAIRS_SQL}, tests AS (
        SELECT s.method, s.t AS st, s.p AS sp, a.t AS acc_t, a.p AS acc_p, 0.05 / count(*) OVER () AS alpha
        FROM ({_tested_sql('score')}) s JOIN ({_tested_sql('accuracy')}) a USING (method))
        SELECT method, {r('alpha')} AS alpha,
            {_verdict_sql('st', 'sp', 'alpha', 'positive', 'negative')} AS fairness_impact,
            {_verdict_sql('acc_t', 'acc_p', 'alpha', 'negative', 'positive')} AS accuracy_impact FROM tests""",
)
def impact_verdict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts at a level shared among all methods."""
    tested = ops.paired_tests(user_changes(spark, sf_dir), ["method"], ["score", "accuracy"])
    # a window over one row per method
    tested = tested.withColumn("alpha", F.lit(ALPHA) / F.count(F.lit(1)).over(Window.partitionBy()))
    return rounded(
        tested.select(
            "method",
            "alpha",
            impact_verdict(F.col("score_t"), F.col("score_p"), F.col("alpha"), True).alias("fairness_impact"),
            impact_verdict(F.col("accuracy_t"), F.col("accuracy_p"), F.col("alpha"), False).alias("accuracy_impact"),
        )
    )


def _rate_gap_sql(alias: str, by: str, hit: str, miss: str) -> str:
    def rate(group: str) -> str:
        hits, misses = f"{alias}.{by}_{group}__{hit}", f"{alias}.{by}_{group}__{miss}"
        return f"{hits}::DOUBLE / nullif({hits} + {misses}, 0)"

    return f"({rate('priv')} - {rate('dis')})"


def _impact_sql(pairing: str) -> str:
    """Score lists, their pairing, the tests and the table, straight from the counts."""
    paired = "b.rn = t.rn" if pairing == "position" else "b.split_seed = t.split_seed AND b.retrain_seed = t.retrain_seed"

    def gap(alias: str) -> str:
        branches = []
        for metric, straight, flipped in (
            ("equal_opportunity", ("tp", "fn"), ("tn", "fp")),
            ("predictive_parity", ("tp", "fp"), ("tn", "fn")),
        ):
            for by in ("flag", "status"):
                for is_flipped, cells in ((False, straight), (True, flipped)):
                    branches.append(
                        f"WHEN c.metric = '{metric}' AND c.looks_at = '{by}' AND c.flipped = {is_flipped} "
                        f"THEN {_rate_gap_sql(alias, by, *cells)}"
                    )
        return f"CASE {' '.join(branches)} END"

    return f"""WITH {EXPERIMENTS_SQL},
        cases AS (SELECT l.dataset, l.criteria, l.looks_at, l.dataset IN ('credit', 'german') AS flipped, m.metric
            FROM listed l, (VALUES ('equal_opportunity'), ('predictive_parity')) m(metric)),
        runs AS (SELECT *, CASE WHEN error = 'missing_values' THEN 'delete' ELSE 'dirty' END AS base
            FROM train_methods),
        sides AS (
            SELECT error, train_method, base AS test_method, TRUE AS is_base, base FROM runs WHERE train_method = base
            UNION ALL SELECT error, train_method, base, FALSE, base FROM runs WHERE train_method <> base
            UNION ALL SELECT error, train_method, train_method, FALSE, base FROM runs WHERE train_method <> base),
        wanted AS (SELECT *,
            CASE WHEN is_base AND error = 'missing_values' THEN 'impute_mean_dummy' WHEN is_base THEN base
                WHEN error = 'mislabel' THEN 'clean' ELSE test_method END AS score_by,
            CASE WHEN is_base AND error = 'missing_values' THEN 'impute_mean_dummy' WHEN test_method = base THEN base
                WHEN error <> 'mislabel' THEN train_method END AS acc_by FROM sides),
        scored AS (SELECT s.*, w.test_method, w.is_base, a.hits::DOUBLE / a.rows AS acc,
            row_number() OVER (PARTITION BY s.dataset, s.error, s.model, s.train_method, w.test_method
                ORDER BY s.pos) AS rn
            FROM wanted w JOIN experiments s ON s.error = w.error AND s.train_method = w.train_method
                AND s.prefix = w.score_by
            LEFT JOIN experiments a ON a.dataset = s.dataset AND a.pos = s.pos AND a.prefix = w.acc_by),
        changes AS (SELECT t.dataset, c.criteria, c.metric, t.model, t.error, t.train_method, t.test_method,
            {gap('t')} - {gap('b')} AS score, t.acc - b.acc AS accuracy
            FROM scored t LEFT JOIN scored b ON b.is_base AND b.dataset = t.dataset AND b.error = t.error
                AND b.model = t.model AND {paired}
            JOIN cases c ON c.dataset = t.dataset WHERE NOT t.is_base),
        moments AS (SELECT dataset, criteria, metric, model, error, train_method, test_method,
            count(score) AS sn, avg(score) AS sm, stddev_samp(score) AS ss,
            count(accuracy) AS an, avg(accuracy) AS am, stddev_samp(accuracy) AS asd FROM changes GROUP BY ALL),
        ts AS (SELECT *, 0.05 / count(*) OVER (PARTITION BY dataset, criteria, metric, model, error) AS alpha, {t_sql('sn', 'sm', 'ss')} AS st, {t_sql('an', 'am', 'asd')} AS acc_t FROM moments),
        tests AS (SELECT *, {paired_p_sql('sn', 'st')} AS sp, {paired_p_sql('an', 'acc_t')} AS acc_p FROM ts),
        named AS (SELECT *, train_method = test_method AS test_repaired,
            CASE error WHEN 'missing_values' THEN '' WHEN 'mislabel' THEN split_part(train_method, '-', 1)
                ELSE replace(split_part(train_method, '_impute', 1), 'clean_', '') END AS detection,
            CASE error WHEN 'missing_values' THEN train_method WHEN 'mislabel' THEN split_part(train_method, '-', 2)
                ELSE 'impute_' || split_part(train_method, '_impute', 2) END AS repair FROM tests)
        SELECT dataset, criteria, metric, model, error, detection, repair, test_repaired,
            {_verdict_sql('st', 'sp', 'alpha', 'positive', 'negative')} AS fairness_impact,
            {_verdict_sql('acc_t', 'acc_p', 'alpha', 'negative', 'positive')} AS accuracy_impact
        FROM named WHERE CASE WHEN error = 'mislabel' THEN NOT test_repaired AND detection <> 'shapley'
            ELSE test_repaired END"""


@query("impact_table", _impact_sql("position"))
def impact_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline, pairing runs by their position as in the result documents."""
    return ops.impact_table(parsed_experiments(spark, sf_dir), pairing="position")


@query("impact_table_by_seeds", _impact_sql("seeds"))
def impact_table_by_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table with runs paired by their seeds."""
    return ops.impact_table(parsed_experiments(spark, sf_dir), pairing="seeds")


_BEST_SQL = f"""WITH {EXPERIMENTS_SQL}, best AS (
    SELECT dataset, error, split_seed, hits::DOUBLE / rows AS accuracy, model,
        row_number() OVER (PARTITION BY dataset, error, split_seed ORDER BY hits::DOUBLE / rows DESC, pos) AS rn
    FROM experiments)"""


@query(
    "best_model_per_split",
    f"{_BEST_SQL} SELECT dataset, error, split_seed::VARCHAR AS split_seed, {r('accuracy')} AS accuracy, model "
    "FROM best WHERE rn = 1",
)
def best_model_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.best_models(parsed_experiments(spark, sf_dir)))


@query(
    "best_model_mode",
    f"""{_BEST_SQL}, wins AS (SELECT dataset, error, model, count(*) AS splits FROM best WHERE rn = 1 GROUP BY ALL)
        SELECT dataset, error, model, splits FROM (
            SELECT *, rank() OVER (PARTITION BY dataset, error ORDER BY splits DESC) AS place FROM wins) WHERE place = 1""",
)
def best_model_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.best_model_modes(ops.best_models(parsed_experiments(spark, sf_dir)))


@query(
    "experiment_documents",
    f"""WITH {EXPERIMENTS_SQL},
        names AS ({_metric_names_sql()}),
        whole AS (SELECT dataset, split_seed, pos, error, train_method, model, retrain_seed,
            count(*) AS metrics, sum(value) AS total FROM names GROUP BY ALL)
        SELECT dataset || '/' || split_seed AS dataset,
            row_number() OVER (PARTITION BY dataset, split_seed ORDER BY pos) - 1 AS pos,
            concat_ws('/', dataset, split_seed, error, train_method, model, retrain_seed) AS experiment,
            metrics, {r('total')} AS total FROM whole""",
)
def experiment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, one JSON object per dataset and split, parsed back into experiments in key order."""
    rows = experiments(spark, sf_dir).withColumn("split", F.split("experiment", "/").getItem(1))
    entry = F.concat(F.lit('"'), F.col("experiment"), F.lit('": '), F.col("metrics"))
    # a document holds the runs of one split
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", entry.alias("entry")))), lambda x: x["entry"])
    documents = rows.groupBy("dataset", "split").agg(F.concat(F.lit("{"), F.concat_ws(", ", parts), F.lit("}")).alias("value"))
    parsed = parse_documents(documents.select(F.concat_ws("/", "dataset", "split").alias("dataset"), "value"))
    values = F.map_values("metrics")
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return rounded(parsed.select("dataset", "pos", "experiment", F.size(values).cast("bigint").alias("metrics"), total.alias("total")))
