"""Views that give the operators real work on the given tables.

Each view exists twice: as a DataFrame and as the SQL the check statements use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriparity.operators.experiments import CASES, MODELS
from veriparity.plans.registry import table
from veriparity.spec import Above, AuditSpec, Equals, LabelIn

# --- documents with their labels: a third to two thirds have none -------------------------------

DOC_SPEC = AuditSpec(
    name="documents",
    label=LabelIn("quality", (1,)),
    groups={"lang": Equals("lang", "en"), "quality": Equals("quality", 1), "toxicity": Above("toxic", 0)},
    numeric=("n_chars",),
    categorical=("lang", "source"),
    not_for_prediction=("lang",),
    listed_criteria=("lang",),
    id_col="doc_id",
)

DOC_SQL = """doc_audit AS (
    SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic,
        CASE WHEN d.lang IS NOT DISTINCT FROM 'en' THEN 'priv' ELSE 'dis' END AS grp
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def doc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(labels, "doc_id", "left")


# --- events with the number in their properties ---------------------------------------------------

EVENT_SPEC = AuditSpec(
    name="events",
    label=LabelIn("event_type", ("purchase",)),
    groups={"purchase": Equals("event_type", "purchase"), "user": Above("user_id", 75)},
    numeric=("value", "k", "user_id"),
    categorical=("event_type",),
    id_col="event_id",
)
EVENT_NA = ("65", "24")

EVENT_SQL = """event_audit AS (
    SELECT event_id, user_id, event_type, value, k_text,
        CASE WHEN k_text IN ('65', '24') THEN NULL ELSE k_text::INT END AS k,
        CASE WHEN event_type IS NOT DISTINCT FROM 'purchase' THEN 'priv' ELSE 'dis' END AS by_type,
        CASE WHEN user_id > 75 THEN 'priv' WHEN user_id <= 75 THEN 'dis' END AS by_user
    FROM (SELECT *, json_extract_string(props, '$.k') AS k_text FROM events))"""


def event_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k_text")
    )


# --- line items as rows of an impact table --------------------------------------------------------

IMPACT_SQL = """impact AS (
    SELECT c.c_mktsegment AS dataset, o.o_orderpriority AS criteria, l.l_linestatus AS metric,
        o.o_orderstatus AS model, l.l_returnflag AS error, p.p_type AS detection, p.p_brand AS repair,
        l.l_partkey AS scenario, l.l_linenumber % 2 = 0 AS test_repaired,
        CASE WHEN l.l_discount < 0.025 THEN 'negative' WHEN l.l_discount < 0.075 THEN 'insignificant'
            ELSE 'positive' END AS fairness_impact,
        CASE WHEN l.l_tax < 0.025 THEN 'negative' WHEN l.l_tax < 0.055 THEN 'insignificant'
            ELSE 'positive' END AS accuracy_impact
    FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
        LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""


def _grade(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, "negative").when(value < high, "insignificant").otherwise("positive")


def impact(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """One row per line item with the wanted columns.

    A lookup table joins in only when a wanted column comes from it: the lookups
    are outer joins on unique keys, so leaving one out changes no row.
    """
    own = {
        "metric": F.col("l_linestatus"),
        "error": F.col("l_returnflag"),
        "scenario": F.col("l_partkey"),
        "test_repaired": F.col("l_linenumber") % 2 == 0,
        "fairness_impact": _grade(F.col("l_discount"), 0.025, 0.075),
        "accuracy_impact": _grade(F.col("l_tax"), 0.025, 0.055),
    }
    from_orders = {"criteria": "o_orderpriority", "model": "o_orderstatus"}
    from_customer = {"dataset": "c_mktsegment"}
    from_part = {"detection": "p_type", "repair": "p_brand"}
    rows = table(spark, sf_dir, "lineitem")
    if any(c in from_customer or c in from_orders for c in columns):
        orders = table(spark, sf_dir, "orders")
        if any(c in from_customer for c in columns):
            customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if any(c in from_part for c in columns):
        part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    looked_up = {**from_orders, **from_customer, **from_part}
    return rows.select(*[(own[c] if c in own else F.col(looked_up[c])).alias(c) for c in columns])


# --- predictions: long documents are taken for good ones ------------------------------------------

PRED_SQL = """pred_audit AS (
    SELECT d.doc_id, d.source, d.n_chars, l.quality = 1 AS truth, d.n_chars > 500 AS predicted,
        CASE WHEN d.lang IS NOT DISTINCT FROM 'en' THEN 'priv' ELSE 'dis' END AS grp
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def pred_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(labels, "doc_id").select(
        "doc_id",
        "source",
        "n_chars",
        (F.col("quality") == 1).alias("truth"),
        (F.col("n_chars") > 500).alias("predicted"),
        DOC_SPEC.group("lang").alias("grp"),
    )


# --- one run per user and event type ---------------------------------------------------------------

RUNS_SQL = """
    plain AS (SELECT user_id, event_type AS method, avg(value) AS score, stddev_pop(value) AS accuracy
        FROM events GROUP BY user_id, event_type),
    runs AS (SELECT * FROM plain
        UNION ALL SELECT user_id, 'click_down', score * 0.8, accuracy * 0.8 FROM plain WHERE method = 'click'
        UNION ALL SELECT user_id, 'click_up', score * 1.25, accuracy * 1.25 FROM plain WHERE method = 'click')"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per user and method; the clicks also appear shrunk and stretched."""
    plain = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.col("event_type").alias("method"))
        .agg(F.avg("value").alias("score"), F.stddev_pop("value").alias("accuracy"))
    )
    versions = F.when(
        F.col("method") == "click",
        F.array(
            *[
                F.struct(F.lit(name).alias("method"), F.lit(factor).alias("factor"))
                for name, factor in (("click", 1.0), ("click_down", 0.8), ("click_up", 1.25))
            ]
        ),
    ).otherwise(F.array(F.struct(F.col("method"), F.lit(1.0).alias("factor"))))
    spread = plain.select("user_id", "score", "accuracy", F.inline(versions))
    return spread.select(
        "user_id",
        "method",
        (F.col("score") * F.col("factor")).alias("score"),
        (F.col("accuracy") * F.col("factor")).alias("accuracy"),
    )


# --- line items as test rows of cleaning experiments ------------------------------------------------

# error, training method, tested as, score from which the privileged / the others are predicted
# positive.  Some methods narrow the gap between the groups, some widen it, one changes nothing.
EXPERIMENT_RUNS = (
    ("outliers", "dirty", "dirty", 40, 50),
    ("outliers", "clean_SD_impute_mean_dummy", "dirty", 41, 49),
    ("outliers", "clean_SD_impute_mean_dummy", "clean_SD_impute_mean_dummy", 45, 45),
    ("outliers", "clean_IQR_impute_median_dummy", "dirty", 40, 50),
    ("outliers", "clean_IQR_impute_median_dummy", "clean_IQR_impute_median_dummy", 36, 54),
    ("outliers", "clean_IF_impute_mode_dummy", "dirty", 40, 50),
    ("outliers", "clean_IF_impute_mode_dummy", "clean_IF_impute_mode_dummy", 40, 50),
    ("missing_values", "delete", "delete", 41, 49),
    ("missing_values", "delete", "impute_mean_dummy", 42, 48),
    ("missing_values", "impute_mean_dummy", "delete", 42, 47),
    ("missing_values", "impute_mean_dummy", "impute_mean_dummy", 45, 46),
    ("missing_values", "impute_median_mode", "delete", 42, 48),
    ("missing_values", "impute_median_mode", "impute_median_mode", 37, 52),
    ("mislabel", "dirty", "dirty", 40, 50),
    ("mislabel", "confident-flip", "dirty", 40, 50),
    ("mislabel", "confident-flip", "clean", 43, 47),
    ("mislabel", "shapley-flip", "dirty", 40, 50),
    ("mislabel", "shapley-flip", "clean", 44, 44),
)
# a criterion is looked at on the return flag or, for these, on the line status
_BY_STATUS = {("adult", "race"), ("folktables", "rac1p"), ("heart", "gender")}
EXPERIMENT_CRITERIA = tuple((d, c, "status" if (d, c) in _BY_STATUS else "flag") for d, c, _ in CASES)
EXPERIMENT_DATASETS = tuple(dict.fromkeys(d for d, _, _ in CASES))
EXPERIMENT_MODELS = MODELS


def _values(rows: Sequence[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


EXPERIMENTS_SQL = f"""
    methods(run_no, error, train_method, prefix, from_priv, from_dis) AS (
        VALUES {_values([(i, *run) for i, run in enumerate(EXPERIMENT_RUNS)])}),
    train_methods AS (SELECT error, train_method, min(run_no) AS run_no FROM methods GROUP BY ALL),
    listed(dataset, criteria, looks_at) AS (VALUES {_values(EXPERIMENT_CRITERIA)}),
    items AS (
        SELECT l_suppkey AS split_seed, l_linenumber AS retrain_seed,
            {list(EXPERIMENT_DATASETS)}[1 + l_suppkey % 5] AS dataset,
            {list(EXPERIMENT_MODELS)}[1 + l_linenumber % 3] AS model,
            l_returnflag = 'A' AS flag, l_linestatus = 'F' AS status,
            l_quantity + 2 * round(l_tax * 100) > 33 AS truth,
            l_quantity + 3 * round(l_discount * 100) AS score
        FROM lineitem),
    judged AS (
        SELECT i.*, m.*, i.score >= CASE WHEN i.flag THEN m.from_priv ELSE m.from_dis END AS predicted
        FROM items i, methods m),
    cells AS (
        SELECT dataset, model, split_seed, retrain_seed, error, train_method, prefix,
            count(*) AS rows, count(*) FILTER (WHERE predicted = truth) AS hits,
            {", ".join(
                f"count(*) FILTER (WHERE {'' if side else 'NOT '}{by} AND {'' if truth else 'NOT '}truth AND "
                f"{'' if predicted else 'NOT '}predicted) AS {by}_{'priv' if side else 'dis'}__{cell}"
                for by in ("flag", "status")
                for side in (True, False)
                for cell, truth, predicted in (
                    ("tp", True, True), ("tn", False, False), ("fp", False, True), ("fn", True, False)
                )
            )}
        FROM judged GROUP BY ALL),
    experiments AS (
        SELECT c.*, t.run_no, (split_seed * 10 + retrain_seed) * 20 + t.run_no AS pos
        FROM cells c JOIN train_methods t USING (error, train_method))"""


def _lookup(words: Sequence[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), position.cast("int") + 1)


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment results ``dataset, pos, experiment, metrics`` with JSON text as ``metrics``.

    Line items of one supplier and line number are the test rows of one split and
    retraining.  They are first counted per distinct outcome-relevant value, which
    leaves few rows per split however many line items it has; the methods are
    applied to those counts.
    """
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("split_seed"),
        F.col("l_linenumber").alias("retrain_seed"),
        (F.col("l_returnflag") == "A").alias("flag"),
        (F.col("l_linestatus") == "F").alias("status"),
        (F.col("l_quantity") + 2 * F.round(F.col("l_tax") * 100) > 33).alias("truth"),
        (F.col("l_quantity") + 3 * F.round(F.col("l_discount") * 100)).alias("score"),
    )
    split = ["split_seed", "retrain_seed"]
    distinct = items.groupBy(*split, "flag", "status", "truth", "score").agg(F.count(F.lit(1)).alias("n"))
    distinct = distinct.repartition(*split)

    first = {}
    for i, (error, train, *_) in enumerate(EXPERIMENT_RUNS):
        first.setdefault((error, train), i)
    listed = [(first[run[:2]], *run) for run in EXPERIMENT_RUNS]
    columns = ("run_no", "error", "train_method", "prefix", "from_priv", "from_dis")
    structs = ", ".join(
        "struct(" + ", ".join(f"{v!r} AS {c}" for v, c in zip(run, columns)) + ")" for run in listed
    )
    judged = distinct.select("*", F.expr(f"inline(array({structs}))")).withColumn(
        "predicted", F.expr("score >= IF(flag, from_priv, from_dis)")
    )
    outcome = {
        "tp": "truth AND predicted",
        "tn": "NOT truth AND NOT predicted",
        "fp": "NOT truth AND predicted",
        "fn": "truth AND NOT predicted",
    }
    counts = {
        f"{by}_{side}__{cell}": f"{member} AND {hit}"
        for by in ("flag", "status")
        for side, member in (("priv", by), ("dis", f"NOT {by}"))
        for cell, hit in outcome.items()
    }
    cells = judged.groupBy(*split, "run_no", "error", "train_method", "prefix").agg(
        F.sum("n").alias("rows"),
        F.expr("sum(IF(predicted = truth, n, 0)) AS hits"),
        *[F.expr(f"sum(IF({hit}, n, 0)) AS {name}") for name, hit in counts.items()],
    )
    cells = cells.withColumn("dataset", _lookup(EXPERIMENT_DATASETS, F.col("split_seed") % 5))
    cells = cells.withColumn("model", _lookup(EXPERIMENT_MODELS, F.col("retrain_seed") % 3))

    def entries_of(dataset: str) -> str:
        found = [
            f"struct(concat(prefix, '__{criteria}_{side}__{cell}') AS key, double({by}_{side}__{cell}) AS value)"
            for owner, criteria, by in EXPERIMENT_CRITERIA
            if owner == dataset
            for side in ("priv", "dis")
            for cell in outcome
        ]
        found.append("struct(concat(prefix, '_test_acc') AS key, hits / rows AS value)")
        return f"array({', '.join(found)})"

    branches = " ".join(f"WHEN '{d}' THEN {entries_of(d)}" for d in EXPERIMENT_DATASETS)
    entries = F.expr(f"CASE dataset {branches} END")
    keys = ["dataset", "model", *split, "run_no", "error", "train_method"]
    # at most a few dozen metrics per experiment
    collected = cells.groupBy(*keys).agg(F.flatten(F.collect_list(entries)).alias("entries"))
    experiment = F.concat_ws("/", "dataset", "split_seed", "error", "train_method", "model", "retrain_seed")
    pos = (F.col("split_seed") * 10 + F.col("retrain_seed")) * 20 + F.col("run_no")
    return collected.select(
        "dataset",
        pos.alias("pos"),
        experiment.alias("experiment"),
        F.to_json(F.map_from_entries("entries")).alias("metrics"),
    )


# --- embeddings ---------------------------------------------------------------------------------------

EMB_SQL = """emb_audit AS (SELECT vec_id AS id, label < 5 AS label, embedding::DOUBLE[] AS features FROM embeddings)"""


def emb_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("label") < 5).alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )
