"""Queries: confusion counts, fairness gaps, AUC and causal impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriparity.functions.fairness import fairness_gap, wide_counts
from veriparity.functions.values import ratio
from veriparity.operators.confusion import (
    accuracy_and_auc,
    causal_impact,
    causal_summary,
    confusion_counts,
    group_confusion,
    wide_confusion,
)
from veriparity.plans.registry import query, r, rounded, table
from veriparity.plans.standins import PRED_SQL, pred_audit

_CELLS_SQL = {
    "tn": "NOT truth AND NOT predicted",
    "fp": "NOT truth AND predicted",
    "fn": "truth AND NOT predicted",
    "tp": "truth AND predicted",
}


def _wide_sql(by: str) -> str:
    cells = ", ".join(
        f"count(*) FILTER (WHERE grp = '{g}' AND {rule}) AS {cell}_{g}"
        for g in ("priv", "dis")
        for cell, rule in _CELLS_SQL.items()
    )
    return f"SELECT {by}, {cells} FROM pred_audit GROUP BY {by}"


def _gap_sql(hit: str, whole: str) -> str:
    side = lambda g: f"({hit.format(g=g)})::DOUBLE / nullif({whole.format(g=g)}, 0)"
    return f"{side('priv')} - {side('dis')}"


_GAPS = {
    "fairness_eo": ("equal_opportunity", False, _gap_sql("tp_{g}", "tp_{g} + fn_{g}")),
    "fairness_eo_flipped": ("equal_opportunity", True, _gap_sql("tn_{g}", "tn_{g} + fp_{g}")),
    "fairness_pp": ("predictive_parity", False, _gap_sql("tp_{g}", "tp_{g} + fp_{g}")),
    "fairness_pp_flipped": ("predictive_parity", True, _gap_sql("tn_{g}", "tn_{g} + fn_{g}")),
    "fairness_sp": (
        "statistical_parity",
        False,
        _gap_sql("tp_{g} + fp_{g}", "tp_{g} + fp_{g} + tn_{g} + fn_{g}"),
    ),
}


def _register_gap(name: str, metric: str, flipped: bool, sql: str) -> None:
    @query(name, f"WITH {PRED_SQL} SELECT source, {r(sql)} AS gap FROM ({_wide_sql('source')})")
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = wide_confusion(pred_audit(spark, sf_dir), "grp", "truth", "predicted", ["source"])
        return rounded(counts.select("source", fairness_gap(metric, wide_counts(), flipped).alias("gap")))


for _name, (_metric, _flipped, _sql) in _GAPS.items():
    _register_gap(_name, _metric, _flipped, _sql)


@query(
    "group_confusion",
    f"WITH {PRED_SQL} SELECT source, grp, "
    + ", ".join(f"count(*) FILTER (WHERE {rule}) AS {cell}" for cell, rule in _CELLS_SQL.items())
    + " FROM pred_audit GROUP BY source, grp",
)
def group_confusion_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_confusion(pred_audit(spark, sf_dir), "grp", "truth", "predicted", ["source"])


@query(
    "group_auc",
    f"""WITH {PRED_SQL}, placed AS (
        SELECT grp, truth, predicted, rank() OVER (PARTITION BY grp ORDER BY n_chars)
            + (count(*) OVER (PARTITION BY grp, n_chars) - 1) / 2.0 AS place FROM pred_audit),
        summed AS (SELECT grp, count(*) AS n, avg(CASE WHEN truth = predicted THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
            count(*) FILTER (WHERE truth) AS pos, count(*) FILTER (WHERE NOT truth) AS neg,
            sum(place::DOUBLE) FILTER (WHERE truth) AS places FROM placed GROUP BY grp)
        SELECT grp, n, {r('accuracy')} AS accuracy,
            {r('(places - pos * (pos + 1) / 2.0) / nullif(pos * neg, 0)')} AS auc FROM summed""",
)
def group_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, and the chance that a good document is longer than a bad one."""
    return rounded(accuracy_and_auc(pred_audit(spark, sf_dir), ["grp"], "truth", "predicted", "n_chars"))


# score from which a line item is predicted positive: originally lower for the privileged, then equal
_ORIG, _CLEAN = (40, 46), (43, 43)
_CAUSAL_SIDES = (("orig", *_ORIG), ("clean", *_CLEAN))


def causal_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One experiment per supplier: confusion counts, accuracy and AUC before and after.

    The AUC of a yes/no score is the mean of the two class rates.
    """
    items = table(spark, sf_dir, "lineitem")
    priv = F.col("l_returnflag") == "A"
    score = F.col("l_quantity") + 3 * F.round(F.col("l_discount") * 100)
    truth = F.col("l_quantity") + 2 * F.round(F.col("l_tax") * 100) > 33
    rows = items.select(
        F.col("l_suppkey").alias("run"),
        priv.alias("priv"),
        truth.alias("truth"),
        *[(score >= F.when(priv, p).otherwise(d)).alias(side) for side, p, d in _CAUSAL_SIDES],
    )
    aggregates = []
    for side, _, _ in _CAUSAL_SIDES:
        for group, member in (("priv", F.col("priv")), ("nonpriv", ~F.col("priv"))):
            for count in confusion_counts(F.col("truth"), F.col(side), member):
                aggregates.append((side, group, count))
    names = [f"{side}_{cell}_{group}" for side, _, _ in _CAUSAL_SIDES for group in ("priv", "nonpriv")
             for cell in ("tn", "fp", "fn", "tp")]
    frame = rows.groupBy("run").agg(*[count.alias(name) for name, (_, _, count) in zip(names, aggregates)])
    scores = {}
    for side, _, _ in _CAUSAL_SIDES:
        cell = lambda c: F.col(f"{side}_{c}_priv") + F.col(f"{side}_{c}_nonpriv")  # noqa: B023, E731
        tp, tn, fp, fn = cell("tp"), cell("tn"), cell("fp"), cell("fn")
        scores[f"{side}_accuracy"] = ratio(tp + tn, tp + tn + fp + fn)
        scores[f"{side}_auc"] = (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2
    return frame.withColumns(scores)


def _causal_frame_sql() -> str:
    truth = "l_quantity + 2 * round(l_tax * 100) > 33"
    cells, scores = [], []
    for side, p, d in _CAUSAL_SIDES:
        predicted = f"l_quantity + 3 * round(l_discount * 100) >= CASE WHEN l_returnflag = 'A' THEN {p} ELSE {d} END"
        for group, member in (("priv", "l_returnflag = 'A'"), ("nonpriv", "l_returnflag <> 'A'")):
            for cell, rule in _CELLS_SQL.items():
                rule = rule.replace("truth", f"({truth})").replace("predicted", f"({predicted})")
                cells.append(f"count(*) FILTER (WHERE {member} AND {rule}) AS {side}_{cell}_{group}")
        tp, tn, fp, fn = (f"({side}_{c}_priv + {side}_{c}_nonpriv)" for c in ("tp", "tn", "fp", "fn"))
        scores.append(f"({tp} + {tn})::DOUBLE / ({tp} + {tn} + {fp} + {fn}) AS {side}_accuracy")
        scores.append(f"({tp}::DOUBLE / ({tp} + {fn}) + {tn}::DOUBLE / ({tn} + {fp})) / 2 AS {side}_auc")
    return (
        f"causal_cells AS (SELECT l_suppkey AS run, {', '.join(cells)} FROM lineitem GROUP BY l_suppkey), "
        f"causal_frame AS (SELECT *, {', '.join(scores)} FROM causal_cells)"
    )


def _causal_rate(metric: str, side: str, group: str) -> str:
    tp, fp, tn, fn = (f"{side}_{c}_{group}" for c in ("tp", "fp", "tn", "fn"))
    hit, whole = {
        "statistical_parity": (f"{tp} + {fp}", f"{tp} + {fp} + {tn} + {fn}"),
        "predictive_parity": (tp, f"{tp} + {fp}"),
        "equal_opportunity": (tp, f"{tp} + {fn}"),
    }[metric]
    return f"({hit})::DOUBLE / nullif({whole}, 0)"


def _causal_sql(metric: str) -> str:
    gap = lambda side: f"{_causal_rate(metric, side, 'priv')} - {_causal_rate(metric, side, 'nonpriv')}"
    return f"""SELECT run, orig_gap, clean_gap, coalesce(orig_gap > 0, FALSE) AS applicable,
            coalesce(orig_gap > 0 AND orig_gap > clean_gap, FALSE) AS unfair,
            CASE WHEN orig_gap > 0 AND orig_gap > clean_gap
                THEN (orig_gap - greatest(clean_gap, 0)) / orig_gap END AS responsibility,
            CASE WHEN orig_gap > 0 AND orig_gap > clean_gap
                THEN clean_accuracy - orig_accuracy END AS accuracy_change,
            CASE WHEN orig_gap > 0 AND orig_gap > clean_gap THEN clean_auc - orig_auc END AS auc_change
        FROM (SELECT *, {gap('orig')} AS orig_gap, {gap('clean')} AS clean_gap FROM causal_frame)"""


_CAUSAL_METRICS = {
    "causal_sp": "statistical_parity",
    "causal_pp": "predictive_parity",
    "causal_eo": "equal_opportunity",
}
_CAUSAL_VALUES = ("orig_gap", "clean_gap", "responsibility", "accuracy_change", "auc_change")


def _register_causal(name: str, metric: str) -> None:
    values = ", ".join(f"{r(c)} AS {c}" for c in _CAUSAL_VALUES)

    @query(name, f"WITH {_causal_frame_sql()} SELECT run, applicable, unfair, {values} FROM ({_causal_sql(metric)})")
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(causal_impact(causal_frame(spark, sf_dir), metric, ["run"]))


for _name, _metric in _CAUSAL_METRICS.items():
    _register_causal(_name, _metric)


@query(
    "causal_summary",
    f"WITH {_causal_frame_sql()} SELECT metric, count(*) AS n, count(*) FILTER (WHERE unfair) AS n_unfair, "
    f"count(*) FILTER (WHERE applicable) AS n_applicable, {r('avg(responsibility)')} AS mean_responsibility, "
    f"{r('avg(accuracy_change)')} AS mean_accuracy_change, {r('avg(auc_change)')} AS mean_auc_change FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, * FROM ({_causal_sql(m)})" for m in _CAUSAL_METRICS.values())
    + ") GROUP BY metric",
)
def causal_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the three metrics."""
    frame = causal_frame(spark, sf_dir)
    parts = [
        causal_summary(causal_impact(frame, m)).select(F.lit(m).alias("metric"), "*") for m in _CAUSAL_METRICS.values()
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))
