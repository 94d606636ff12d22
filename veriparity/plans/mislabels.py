"""Queries: feature encoding, data valuation, confident learning and model-based detectors."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriparity.functions.values import ratio
from veriparity.operators.audit import mislabel_polarity
from veriparity.operators.configured import mislabel_cases
from veriparity.operators.features import encode_rows, feature_input
from veriparity.operators.fold_encoders import encode_by_fold, encoders_of
from veriparity.operators.forest import DRAWS, SAMPLE, TREES, anomaly_scores, beyond_percentile, outliers_by_isolation, path_length
from veriparity.operators.logistic import MAX_WIDTH, fit_logistic
from veriparity.operators.mislabel import confident_issues
from veriparity.operators.models import STRENGTHS, impact_of_cleaning, mislabelled_by_model, train_and_evaluate
from veriparity.operators.valuation import knn_shapley, mislabelled_by_value, nearest_shapley, stratified_holdout, suspicious
from veriparity.plans.check_sql import g_p_sql, g_sql
from veriparity.plans.forest_sql import forest_sql
from veriparity.plans.model_sql import encoded_sql, evaluation_sql, measures_sql, newton_sql
from veriparity.plans.registry import query, r, rounded, table
from veriparity.plans.standins import DOC_SPEC, DOC_SQL, EMB_SQL, doc_audit, emb_audit
from veriparity.session import cut_lineage

# --- feature encoding -------------------------------------------------------------------------------


@query(
    "feature_encode_sql",
    f"""WITH {DOC_SQL}, stats AS (SELECT
            avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(toxic) AS m2,
            sqrt((sum(toxic * toxic) - count(toxic) * avg(toxic) * avg(toxic)) / count(*)) AS s2 FROM doc_audit)
        SELECT doc_id AS id, 'n_chars' AS feature, {r('(n_chars - m1) / s1')} AS value FROM doc_audit, stats
        UNION ALL SELECT doc_id, 'toxic', {r('(coalesce(toxic, m2) - m2) / s2')} FROM doc_audit, stats
        UNION ALL SELECT doc_id, 'lang=' || lang, 1.0::DOUBLE FROM doc_audit
        UNION ALL SELECT doc_id, 'quality=' || coalesce(quality::VARCHAR, '(missing)'), 1.0::DOUBLE FROM doc_audit""",
)
def feature_encode_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-imputed z-scores and one-hot categories in long form."""
    return rounded(encode_rows(doc_audit(spark, sf_dir), "doc_id", ["n_chars", "toxic"], ["lang", "quality"]))


# --- data valuation ----------------------------------------------------------------------------------

_HOLDOUT_SQL = f"""{EMB_SQL}, sizes AS (
        SELECT label, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM emb_audit GROUP BY label),
    quotas AS (SELECT label, floor(share)
        + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, label) <= 100 - sum(floor(share)) OVER ()
            THEN 1 ELSE 0 END AS quota FROM sizes),
    held AS (SELECT id FROM (
        SELECT e.id, q.quota, row_number() OVER (PARTITION BY e.label ORDER BY e.id) AS place
        FROM emb_audit e JOIN quotas q USING (label)) WHERE place <= quota)"""


@query("stratified_holdout", f"WITH {_HOLDOUT_SQL} SELECT id, label FROM emb_audit WHERE id IN (SELECT id FROM held)")
def stratified_holdout_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = emb_audit(spark, sf_dir).select("id", "label")
    return rows.join(F.broadcast(stratified_holdout(rows, [F.col("id")])), "id", "left_semi")


_SHAPLEY_SQL = f"""{_HOLDOUT_SQL},
    dists AS (
        SELECT h.id AS point, t.id, (h.label = t.label)::INT AS a,
            round(sqrt(list_sum(list_transform(list_zip(h.features, t.features),
                lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS dist
        FROM (SELECT * FROM emb_audit WHERE id IN (SELECT id FROM held)) h,
            (SELECT * FROM emb_audit WHERE id NOT IN (SELECT id FROM held)) t),
    placed AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY point) AS n,
        lead(a) OVER w AS next_a FROM dists WINDOW w AS (PARTITION BY point ORDER BY dist, id)),
    steps AS (SELECT *, CASE WHEN i = n THEN a::DOUBLE / n ELSE (a - next_a) / 10.0::DOUBLE * least(10, i) / i END AS step
        FROM placed),
    contributions AS (SELECT id, sum(step) OVER (PARTITION BY point ORDER BY i
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM steps),
    valued AS (SELECT id, avg(value) AS value FROM contributions GROUP BY id)"""


def embedding_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = emb_audit(spark, sf_dir)
    ids = F.broadcast(stratified_holdout(rows.select("id", "label"), [F.col("id")]))
    return knn_shapley(rows.join(ids, "id", "left_anti"), rows.join(ids, "id", "left_semi"), decimals=6)


@query("knn_shapley_values", f"WITH {_SHAPLEY_SQL} SELECT id, {r('value')} AS value FROM valued")
def knn_shapley_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of every row outside the holdout."""
    return rounded(embedding_values(spark, sf_dir))


_NEAREST = 40
_NEAREST_SQL = (
    _SHAPLEY_SQL.replace("placed AS (SELECT *", "placed AS (SELECT * FROM (SELECT *")
    .replace("WINDOW w AS (PARTITION BY point ORDER BY dist, id))", f"WINDOW w AS (PARTITION BY point ORDER BY dist, id)) WHERE i <= {_NEAREST})")
    .replace("CASE WHEN i = n THEN a::DOUBLE / n ELSE", f"CASE WHEN i = n THEN a::DOUBLE / n WHEN i >= {_NEAREST} THEN 0 ELSE")
    .replace("avg(value) AS value", "sum(value) / 100 AS value")
)


@query("knn_shapley_nearest", f"WITH {_NEAREST_SQL} SELECT id, {r('value')} AS value FROM valued")
def knn_shapley_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by the nearest rows of each held-out row alone, at most 1 / 40 from the exact ones."""
    rows = emb_audit(spark, sf_dir)
    ids = F.broadcast(stratified_holdout(rows.select("id", "label"), [F.col("id")]))
    found = nearest_shapley(rows.join(ids, "id", "left_anti"), rows.join(ids, "id", "left_semi"), _NEAREST, decimals=6)
    return rounded(found)


@query("mislabel_knn_shapley", f"WITH {_SHAPLEY_SQL} SELECT id, {r('value')} AS value FROM valued WHERE value < -1e-12")
def mislabel_knn_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(suspicious(embedding_values(spark, sf_dir)))


# --- confident learning -------------------------------------------------------------------------------

# from held-out probabilities ``probs`` (id, given, p0, p1) to ``issues``
_CONFIDENT_SQL = """thresholds AS (SELECT avg(p0) FILTER (WHERE given = 0) AS t0, avg(p1) FILTER (WHERE given = 1) AS t1 FROM probs),
    confident AS (SELECT given, CASE
            WHEN p0 >= t0 - 1e-6 AND p1 >= t1 - 1e-6 THEN CASE WHEN p0 >= p1 THEN 0 ELSE 1 END
            WHEN p0 >= t0 - 1e-6 THEN 0 WHEN p1 >= t1 - 1e-6 THEN 1 END AS other FROM probs, thresholds),
    joint AS (SELECT given, count(*) AS size,
            greatest(count(*) FILTER (WHERE other = given), 1) AS same,
            count(*) FILTER (WHERE other = 1 - given) AS changed FROM confident GROUP BY given),
    prune AS (SELECT given, CAST(round_even(changed::DOUBLE * size / (same + changed), 0) AS BIGINT) AS n
        FROM joint WHERE size > 1),
    leads AS (SELECT *, CASE given WHEN 0 THEN p1 - p0 ELSE p0 - p1 END AS margin FROM probs),
    placed AS (SELECT *, row_number() OVER (PARTITION BY given ORDER BY margin DESC) AS place FROM leads),
    cuts AS (SELECT p.given, min(p.margin) AS cut FROM placed p JOIN prune x ON x.given = p.given AND p.place <= x.n
        GROUP BY p.given),
    issues AS (SELECT l.id, l.given, 1 - l.given AS suggested, l.margin FROM leads l JOIN cuts c ON c.given = l.given
        WHERE l.margin >= c.cut AND (CASE l.given WHEN 0 THEN l.p1 > l.p0 ELSE l.p0 >= l.p1 END))"""

_PROBS_SQL = f"""{DOC_SQL},
    cells AS (SELECT doc_id AS id, quality AS given, grp, lang, doc_id % 5 AS fold,
        CASE WHEN n_chars < 200 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 4000 THEN 2 ELSE 3 END AS bucket
        FROM doc_audit WHERE quality IS NOT NULL),
    folds AS (SELECT lang, bucket, fold, sum(given) AS y, count(*) AS n FROM cells GROUP BY ALL),
    wholes AS (SELECT lang, bucket, sum(y) AS y, sum(n) AS n FROM folds GROUP BY ALL),
    probs AS (SELECT c.id, c.given, c.grp,
            round((w.y - f.y + 1)::DOUBLE / (w.n - f.n + 2), 6) AS p1,
            round(1 - round((w.y - f.y + 1)::DOUBLE / (w.n - f.n + 2), 6), 6) AS p0
        FROM cells c JOIN folds f USING (lang, bucket, fold) JOIN wholes w USING (lang, bucket)),
    {_CONFIDENT_SQL}"""

def held_out_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, given, probs``: smoothed label rate of similar documents in the other folds."""
    bucket = F.when(F.col("n_chars") < 200, 0).when(F.col("n_chars") < 1000, 1).when(F.col("n_chars") < 4000, 2)
    cells = doc_audit(spark, sf_dir).where(F.col("quality").isNotNull()).select(
        F.col("doc_id").alias("id"),
        F.col("quality").alias("given"),
        "lang",
        bucket.otherwise(3).alias("bucket"),
        (F.col("doc_id") % 5).alias("fold"),
    )
    folds = cells.groupBy("lang", "bucket", "fold").agg(F.sum("given").alias("y"), F.count(F.lit(1)).alias("n"))
    wholes = folds.groupBy("lang", "bucket").agg(F.sum("y").alias("all_y"), F.sum("n").alias("all_n"))
    rates = folds.join(wholes, ["lang", "bucket"]).select(
        "lang",
        "bucket",
        "fold",
        F.round(ratio(F.col("all_y") - F.col("y") + 1, F.col("all_n") - F.col("n") + 2), 6).alias("p1"),
    )
    probs = F.array(F.round(1 - F.col("p1"), 6), F.col("p1"))
    return cells.join(rates, ["lang", "bucket", "fold"]).select("id", "given", probs.alias("probs"))


@query("mislabel_confident", f"WITH {_PROBS_SQL} SELECT id, given, suggested, {r('margin')} AS margin FROM issues")
def mislabel_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(confident_issues(held_out_rates(spark, sf_dir)))


@query(
    "mislabel_polarity",
    f"""WITH {_PROBS_SQL},
        flagged AS (SELECT grp, coalesce(quality = 1, FALSE) AS label FROM doc_audit
            WHERE toxic = 1 OR doc_id IN (SELECT id FROM issues)),
        counted AS (SELECT count(*) FILTER (WHERE grp = 'priv') AS n_priv,
            count(*) FILTER (WHERE grp = 'priv' AND label) AS dirty_priv,
            count(*) FILTER (WHERE grp = 'dis') AS n_dis,
            count(*) FILTER (WHERE grp = 'dis' AND label) AS dirty_dis FROM flagged),
        tested AS (SELECT *, {g_sql('n_priv', 'dirty_priv', 'n_dis', 'dirty_dis')} AS g,
            dirty_priv::DOUBLE / nullif(n_priv, 0) AS sp, dirty_dis::DOUBLE / nullif(n_dis, 0) AS sd FROM counted)
        SELECT n_priv AS flagged_priv, dirty_priv AS positive_priv, n_dis AS flagged_dis, dirty_dis AS positive_dis,
            {r('sp')} AS positive_share_priv, {r('sd')} AS positive_share_dis, {r('1 - sp')} AS negative_share_priv,
            {r('1 - sd')} AS negative_share_dis, coalesce(sp > sd, FALSE) AS priv_higher, {r('g')} AS g,
            {r(g_p_sql('g'))} AS p_value, coalesce(g > 3.841458820694124, FALSE) AS disparate FROM tested""",
)
def mislabel_polarity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label polarity of the flagged documents; toxic ones count as flagged too, so both labels occur."""
    docs = doc_audit(spark, sf_dir)
    issues = confident_issues(held_out_rates(spark, sf_dir)).select(F.col("id").alias("doc_id"), "suggested")
    marked = docs.join(issues, "doc_id", "left").where(F.col("suggested").isNotNull() | (F.col("toxic") == 1))
    return rounded(mislabel_polarity(marked, DOC_SPEC, "lang"))


# --- models -----------------------------------------------------------------------------------------


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_audit(spark, sf_dir).where(F.col("quality").isNotNull())


_LABELLED_SQL = f"""{DOC_SQL},
    labelled AS (SELECT doc_id AS id, (quality = 1)::INT AS y, grp, n_chars, lang, source FROM doc_audit WHERE quality IS NOT NULL)"""
_FOLDS = 3
_ISSUE_FOLDS = 5
_SPLIT_SQL = f"""{_LABELLED_SQL},
    test AS (SELECT * FROM labelled WHERE id % 4 = 0),
    train AS (SELECT *, id % {_FOLDS} AS fold FROM labelled WHERE id % 4 <> 0)"""


@query(
    "fold_encoders",
    f"""WITH {_LABELLED_SQL}, dealt AS (SELECT *, id % {_FOLDS} AS fold FROM labelled),
        parts AS (SELECT unnest(range({_FOLDS})) AS f),
        stats AS (SELECT f, avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM parts JOIN dealt ON fold <> f GROUP BY f),
        cells AS (SELECT id, fold, 'lang=' || lang AS feature FROM dealt UNION ALL SELECT id, fold, 'source=' || source FROM dealt),
        seen AS (SELECT DISTINCT f, feature FROM parts JOIN cells ON fold <> f)
        SELECT id, fold, 'n_chars' AS feature, {r('coalesce((n_chars - m) / nullif(s, 0), 0)')} AS value
        FROM dealt JOIN stats ON f = fold
        UNION ALL SELECT id, fold, feature, 1.0::DOUBLE FROM cells SEMI JOIN seen ON seen.f = cells.fold AND seen.feature = cells.feature""",
)
def fold_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document under the encoder that has not seen its fold."""
    fold = F.col("doc_id") % _FOLDS
    return rounded(encode_by_fold(labelled_documents(spark, sf_dir), "doc_id", ["n_chars"], ["lang", "source"], fold, _FOLDS))


@query(
    "logistic_weights",
    f"""WITH {_SPLIT_SQL}, {encoded_sql("train", ["n_chars"], ["source"], [-1, *range(_FOLDS)])},{newton_sql(STRENGTHS)},
        names AS (SELECT ['(intercept)', 'n_chars'] || list_transform(v0, lambda c: 'source=' || c) AS names FROM vocab)
        SELECT s AS strength, f::INT AS left_out, feature, {r('weight')} AS weight FROM (
            SELECT s, f, unnest(names) AS feature, unnest(w) AS weight FROM w, names)""",
)
def logistic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the models of a search: every strength, without each fold and on all training rows."""
    train = labelled_documents(spark, sf_dir).where(F.col("doc_id") % 4 != 0)
    keep = {"target": DOC_SPEC.label_column().cast("double"), "fold": (F.col("doc_id") % _FOLDS).cast("int")}
    rows = feature_input(train, ["n_chars"], ["source"], keep)
    encoders = encoders_of(rows, ["n_chars"], ["source"], _FOLDS, MAX_WIDTH)
    models = fit_logistic(rows, encoders, [(s, f) for s in STRENGTHS for f in encoders.folds])
    names = ("(intercept)", *encoders.names)
    cells = [(s, f, name, float(v)) for (s, f), w in models.items() for name, v in zip(names, w, strict=True)]
    return rounded(spark.createDataFrame(cells, "strength double, left_out int, feature string, weight double"))


@query(
    "mislabel_cl_lr",
    f"""WITH {_LABELLED_SQL}, dealt AS (SELECT *, id % {_ISSUE_FOLDS} AS fold FROM labelled),
        {encoded_sql("dealt", ["n_chars"], ["lang", "source"], range(_ISSUE_FOLDS))},{newton_sql(STRENGTHS[:1])},
        probs AS (SELECT id, given, p1, 1 - p1 AS p0 FROM (
            SELECT id, y AS given, round(1 / (1 + exp(-list_dot_product(x, w))), 10) AS p1
            FROM w m JOIN xs r ON r.f = m.f AND r.fold = m.f)),
        {_CONFIDENT_SQL} SELECT id, given, suggested, {r('margin')} AS margin FROM issues""",
)
def mislabel_cl_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose quality label a cross-validated model confidently contradicts."""
    labelled = labelled_documents(spark, sf_dir)
    return rounded(mislabelled_by_model(labelled, DOC_SPEC, _ISSUE_FOLDS, fold=F.col("doc_id") % _ISSUE_FOLDS))


def _split_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = labelled_documents(spark, sf_dir)
    test = F.col("doc_id") % 4 == 0
    return train_and_evaluate(labelled.where(~test), labelled.where(test), DOC_SPEC, "lang", fold=F.col("doc_id") % _FOLDS)


@query(
    "train_eval_groups",
    f"""WITH {_SPLIT_SQL}, {evaluation_sql("train", "test", ["n_chars"], ["source"], STRENGTHS, _FOLDS)}
        SELECT {r('accuracy')} AS accuracy, {r('auc')} AS auc, * EXCLUDE (accuracy, auc) FROM {measures_sql()}""",
)
def train_eval_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, fit and evaluation on held-out documents: accuracy, AUC and confusion counts by group."""
    return rounded(_split_predictions(spark, sf_dir))


_EVAL_SQL = f"""WITH {DOC_SQL}, test AS (
        SELECT grp, quality = 1 AS label FROM doc_audit WHERE quality IS NOT NULL AND doc_id % 4 = 0)
    SELECT count(*) FILTER (WHERE grp = 'priv') AS rows_priv, count(*) FILTER (WHERE grp = 'dis') AS rows_nonpriv,
        count(*) FILTER (WHERE grp = 'priv' AND label) AS positives_priv,
        count(*) FILTER (WHERE grp = 'dis' AND label) AS positives_nonpriv, TRUE AS accuracy_of_cells"""
_EVERY, _SIDES = ("tp", "tn", "fp", "fn"), ("priv", "nonpriv")


def _cell(side: str, names: tuple[str, ...], when: str = "") -> Column:
    return sum((F.col(f"{when}{c}_{side}") for c in names), F.lit(0)).cast("bigint")


def _accuracy_of_cells(when: str = "") -> Column:
    accuracy = ratio(sum(_cell(s, ("tp", "tn"), when) for s in _SIDES), sum(_cell(s, _EVERY, when) for s in _SIDES))
    return F.abs(F.col(f"{when}accuracy") - accuracy) < 1e-9


@query("train_eval_totals", f"{_EVAL_SQL} FROM test")
def train_eval_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and labels of an evaluation by group, and that its accuracy is that of the cells."""
    return _split_predictions(spark, sf_dir).select(
        *[_cell(s, _EVERY).alias(f"rows_{s}") for s in _SIDES],
        *[_cell(s, ("tp", "fn")).alias(f"positives_{s}") for s in _SIDES],
        _accuracy_of_cells().alias("accuracy_of_cells"),
    )


def _cleaned_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training before and after cleaning (lengths capped), tested on the same rows, end to end."""
    labelled = labelled_documents(spark, sf_dir)
    test = labelled.where(F.col("doc_id") % 4 == 0)
    dirty = labelled.where(F.col("doc_id") % 4 != 0)
    cleaned = dirty.withColumn("n_chars", F.least("n_chars", F.lit(8000)))
    return impact_of_cleaning(dirty, cleaned, test, DOC_SPEC, "lang", "predictive_parity", fold=F.col("doc_id") % _FOLDS)


@query("cleaning_impact_totals", f"{_EVAL_SQL}, count(*) FILTER (WHERE label) AS positives_after FROM test")
def cleaning_impact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides test the same rows and labels, and the accuracy of each is that of its cells."""
    both = _cleaned_impact(spark, sf_dir)
    same = [_cell(s, names, "orig_") == _cell(s, names, "clean_") for s in _SIDES for names in (_EVERY, ("tp", "fn"))]
    return both.select(
        *[_cell(s, _EVERY, "orig_").alias(f"rows_{s}") for s in _SIDES],
        *[_cell(s, ("tp", "fn"), "orig_").alias(f"positives_{s}") for s in _SIDES],
        reduce(and_, [*same, _accuracy_of_cells("orig_"), _accuracy_of_cells("clean_")]).alias("accuracy_of_cells"),
        sum(_cell(s, ("tp", "fn"), "clean_") for s in _SIDES).alias("positives_after"),
    )


_PRECISION = "{0}tp_{1}::DOUBLE / nullif({0}tp_{1} + {0}fp_{1}, 0)"
_GAPS = ", ".join(f"{_PRECISION.format(when, 'priv')} - {_PRECISION.format(when, 'nonpriv')} AS {when}gap" for when in ("orig_", "clean_"))
_SCORES = ("orig_accuracy", "orig_auc", "clean_accuracy", "clean_auc", "orig_gap", "clean_gap")


@query(
    "cleaning_impact",
    f"""WITH {_SPLIT_SQL}, cleaned AS (SELECT * REPLACE (least(n_chars, 8000) AS n_chars) FROM train),
        {evaluation_sql("train", "test", ["n_chars"], ["source"], STRENGTHS, _FOLDS, "o")},
        {evaluation_sql("cleaned", "test", ["n_chars"], ["source"], STRENGTHS, _FOLDS, "c")},
        both_sides AS (SELECT *, {_GAPS} FROM {measures_sql("o", "orig_")}, {measures_sql("c", "clean_")}),
        told AS (SELECT *, coalesce(orig_gap > 0, FALSE) AS applicable,
            coalesce(orig_gap > 0 AND orig_gap > clean_gap, FALSE) AS unfair FROM both_sides)
        SELECT * EXCLUDE ({", ".join(_SCORES)}), {", ".join(f"{r(c)} AS {c}" for c in _SCORES)},
            {r("CASE WHEN unfair THEN (orig_gap - greatest(clean_gap, 0)) / orig_gap END")} AS responsibility,
            {r("CASE WHEN unfair THEN clean_accuracy - orig_accuracy END")} AS accuracy_change,
            {r("CASE WHEN unfair THEN clean_auc - orig_auc END")} AS auc_change FROM told""",
)
def cleaning_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What capping lengths in the training rows does to the precision gap of the fitted model."""
    return rounded(_cleaned_impact(spark, sf_dir))


_CASES = ("lang", "toxicity")


@query(
    "mislabel_cases",
    f"""WITH {_LABELLED_SQL}, dealt AS (SELECT *, id % {_ISSUE_FOLDS} AS fold FROM labelled),
        {encoded_sql("dealt", ["n_chars"], ["lang", "source"], range(_ISSUE_FOLDS))},{newton_sql(STRENGTHS[:1])},
        probs AS (SELECT id, given, p1, 1 - p1 AS p0 FROM (
            SELECT id, y AS given, round(1 / (1 + exp(-list_dot_product(x, w))), 10) AS p1
            FROM w m JOIN xs r ON r.f = m.f AND r.fold = m.f)),
        {_CONFIDENT_SQL},
        sided AS (SELECT c.criteria, quality = 1 AS label, CASE c.criteria WHEN 'lang' THEN d.grp
                ELSE CASE WHEN toxic > 0 THEN 'priv' WHEN toxic <= 0 THEN 'dis' END END AS side
            FROM doc_audit d SEMI JOIN issues ON issues.id = d.doc_id, (SELECT unnest({list(_CASES)}) AS criteria) c),
        counted AS (SELECT criteria, count(*) FILTER (WHERE side = 'priv') AS n_priv,
            count(*) FILTER (WHERE side = 'priv' AND label) AS dirty_priv,
            count(*) FILTER (WHERE side = 'dis') AS n_dis,
            count(*) FILTER (WHERE side = 'dis' AND label) AS dirty_dis FROM sided GROUP BY criteria),
        tested AS (SELECT *, {g_sql('n_priv', 'dirty_priv', 'n_dis', 'dirty_dis')} AS g,
            dirty_priv::DOUBLE / nullif(n_priv, 0) AS sp, dirty_dis::DOUBLE / nullif(n_dis, 0) AS sd FROM counted)
        SELECT 'documents' AS dataset, criteria, n_priv AS flagged_priv, dirty_priv AS positive_priv, n_dis AS flagged_dis,
            dirty_dis AS positive_dis,
            {r('sp')} AS positive_share_priv, {r('sd')} AS positive_share_dis, {r('1 - sp')} AS negative_share_priv,
            {r('1 - sd')} AS negative_share_dis, coalesce(sp > sd, FALSE) AS priv_higher, {r('g')} AS g,
            {r(g_p_sql('g'))} AS p_value, coalesce(g > 3.841458820694124, FALSE) AS disparate FROM tested""",
)
def mislabel_cases_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over all cases: which way the labels that a model contradicts lean in the groups of each criterion."""
    tables = {"documents": (labelled_documents(spark, sf_dir), DOC_SPEC)}
    cases = [("documents", criteria) for criteria in _CASES]
    return rounded(mislabel_cases(tables, cases, fold=F.col("doc_id") % _ISSUE_FOLDS))


_ENCODED_SQL = f"""{DOC_SQL},
    emb_audit AS (SELECT doc_id AS id, coalesce(quality = 1, FALSE) AS label, n_chars, lang, source FROM doc_audit),
    {_HOLDOUT_SQL.removeprefix(EMB_SQL + ", ")},
    part AS (SELECT *, id IN (SELECT id FROM held) AS is_held FROM emb_audit),
    stats AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s, count(*) AS n FROM part WHERE NOT is_held),
    names AS (SELECT id, 'lang=' || lang AS feature FROM part UNION ALL SELECT id, 'source=' || source FROM part),
    counts AS (SELECT feature, count(*) AS c FROM names JOIN part USING (id) WHERE NOT is_held GROUP BY feature),
    cells AS (SELECT id, 'n_chars' AS feature, (n_chars - m) / s AS value FROM part, stats
        UNION ALL SELECT id, feature, 1 / sqrt(c::DOUBLE / n * (1 - c::DOUBLE / n) * n / (n - 1)) FROM names JOIN counts USING (feature), stats
            WHERE c < n),
    sizes2 AS (SELECT id, any_value(label) AS label, any_value(is_held) AS is_held, sum(value * value) AS square
        FROM part JOIN cells USING (id) GROUP BY id),
    products AS (SELECT h.id AS point, t.id, sum((h.value - t.value) * (h.value - t.value) - h.value * h.value - t.value * t.value) AS common
        FROM cells h JOIN cells t USING (feature) JOIN held ON held.id = h.id ANTI JOIN held e ON e.id = t.id GROUP BY h.id, t.id),
    dists AS (SELECT h.id AS point, t.id, (h.label = t.label)::INT AS a,
            round(sqrt(greatest(0, h.square + t.square + coalesce(common, 0))), 6) AS dist
        FROM sizes2 h JOIN sizes2 t ON h.is_held AND NOT t.is_held LEFT JOIN products p ON p.point = h.id AND p.id = t.id),
    {_SHAPLEY_SQL[_SHAPLEY_SQL.index("placed AS"):]}"""


@query("mislabel_shapley_encoded", f"WITH {_ENCODED_SQL} SELECT id, {r('value')} AS value FROM valued WHERE value < -1e-12")
def mislabel_shapley_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valuation on encoded features; a document without label counts as not good."""
    return rounded(mislabelled_by_value(doc_audit(spark, sf_dir), DOC_SPEC, order=[F.col("id")]))


_SEED = 42

# --- isolation forest ---------------------------------------------------------------------------------


@query(
    "outliers_iforest",
    f"""WITH {DOC_SQL}, ids AS (SELECT doc_id AS id, n_chars, lang, source FROM doc_audit),
        cells AS (SELECT id, 'n_chars' AS feature, (n_chars - m) / s AS value
            FROM ids, (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM ids)
            UNION ALL SELECT id, 'lang=' || lang, 1 FROM ids UNION ALL SELECT id, 'source=' || source, 1 FROM ids),
        {forest_sql("cells", "ids", _SEED, TREES, SAMPLE, math.ceil(math.log2(SAMPLE)), DRAWS)}
        SELECT id, {r('score')} AS score FROM scored, (SELECT quantile_cont(-score, 0.01) AS cut FROM scored) WHERE -score < cut""",
)
def outliers_iforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most isolated documents under a forest whose samples and splits are hashes."""
    return rounded(outliers_by_isolation(doc_audit(spark, sf_dir), DOC_SPEC, seed=_SEED))


# feature, threshold, left, right, path length: three small trees over length and id
_GIVEN_TREES = (
    (("n", "n", None, None, None), (1000.0, 5000.0, 0.0, 0.0, 0.0), (2, 3, -1, -1, -1), (1, 4, -1, -1, -1), (0.0, 0.0, 9.0, 5.0, 2.5)),
    (("place", None, None), (6.0, 0.0, 0.0), (1, -1, -1), (2, -1, -1), (0.0, 1.5, 8.0)),
    (("n", "place", None, None, None), (300.0, 500.0, 0.0, 0.0, 0.0), (1, 3, -1, -1, -1), (2, 4, -1, -1, -1), (0.0, 0.0, 7.0, 4.5, 6.5)),
)
_GIVEN_SAMPLE = 256


@query(
    "outliers_given_forest",
    f"""WITH depths AS (SELECT doc_id AS id,
            CASE WHEN n_chars <= 1000 THEN 9.0 WHEN n_chars <= 5000 THEN 5.0 ELSE 2.5 END
            + CASE WHEN doc_id % 1000 <= 6 THEN 1.5 ELSE 8.0 END
            + CASE WHEN n_chars > 300 THEN 7.0 WHEN doc_id % 1000 <= 500 THEN 4.5 ELSE 6.5 END AS depth FROM documents),
        scored AS (SELECT id, pow(2.0::DOUBLE, -depth::DOUBLE / (3 * {path_length(_GIVEN_SAMPLE)!r})) AS score FROM depths)
        SELECT id, {r('score')} AS score FROM scored, (SELECT quantile_cont(-score, 0.01) AS cut FROM scored)
        WHERE -score < cut""",
)
def outliers_given_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring and the one percent cut of the isolation forest, with trees that are given instead of grown."""
    cells = [("n", F.col("n_chars").cast("double")), ("place", (F.col("doc_id") % 1000).cast("double"))]
    named = F.array(*[F.struct(F.lit(name).alias("feature"), value.alias("value")) for name, value in cells])
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), named.alias("cells"))
    return rounded(beyond_percentile(cut_lineage(anomaly_scores(rows, _GIVEN_TREES, _GIVEN_SAMPLE))))
