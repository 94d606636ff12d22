"""Label errors by confident learning (Northcutt et al., JAIR 2021).

Input rows have an id, the given class ``0 .. k-1`` and out-of-sample class
probabilities.  Everything but the flags themselves is a table of at most k*k
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriparity.functions.values import ratio
from veriparity.operators.quantiles import order_statistics
from veriparity.session import cut_lineage

# Fixed value: how far below the threshold a probability still counts as confident.
THRESHOLD_SLACK = 1e-6


def _best(probs: Column, allowed: Column) -> Column:
    """First class of the largest allowed probability, NULL when none is allowed."""
    masked = F.zip_with(probs, allowed, lambda p, ok: F.when(ok, p))
    top = F.array_max(masked)
    return F.when(top.isNotNull(), F.array_position(masked, top).cast("int") - 1)


def class_thresholds(rows: DataFrame, classes: int) -> DataFrame:
    """One row: ``thresholds``, the mean probability of each class among rows given it."""
    means = [F.avg(F.when(F.col("given") == j, F.get("probs", F.lit(j)))) for j in range(classes)]
    return rows.agg(F.array(*means).alias("thresholds"))


def confident_class(classes: int) -> Column:
    """Most probable class among those whose threshold the row reaches."""
    reached = F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda j: F.coalesce(F.get("probs", j) >= F.get("thresholds", j) - THRESHOLD_SLACK, F.lit(False)),
    )
    return _best(F.col("probs"), reached)


def noise_counts(rows: DataFrame, classes: int) -> DataFrame:
    """``given, other, n``: rows of each given class that belong to another one.

    The counts of confidently classified rows, calibrated so that each given
    class sums to its number of rows.
    """
    thresholds = class_thresholds(rows, classes).scalar()
    confident = rows.select("given", "probs", thresholds.alias("thresholds")).select(
        "given", confident_class(classes).alias("other")
    )
    # k rows, one column per class
    seen = [F.count_if(F.col("other") == j) for j in range(classes)]
    joint = confident.groupBy("given").agg(F.count(F.lit(1)).alias("size"), F.array(*seen).alias("seen"))
    at_least_one = F.transform("seen", lambda n, j: F.when((j == F.col("given")) & (n < 1), 1).otherwise(n))
    joint = joint.select("given", "size", F.posexplode(at_least_one).alias("other", "seen"), at_least_one.alias("row"))
    total = F.aggregate("row", F.lit(0).cast("bigint"), lambda a, n: a + n)
    calibrated = F.bround(ratio(F.col("seen") * F.col("size"), total), 0).cast("bigint")
    return joint.where((F.col("other") != F.col("given")) & (F.col("size") > 1)).select(
        "given", "other", calibrated.alias("n")
    )


def confident_issues(df: DataFrame, classes: int = 2) -> DataFrame:
    """``id, given, suggested, margin`` of the rows whose label looks wrong.

    ``df`` has ``id``, ``given`` and ``probs``.  Of the rows given a class, as
    many as the noise count says are flagged per other class: those where the
    other class leads by the largest margin (all rows at the cut, as they cannot
    be told apart).  A row whose given class is its most probable one is never
    flagged.  The cut is an order statistic, not a sort.
    """
    rows = cut_lineage(df.select("id", F.col("given").cast("int").alias("given"), "probs"))
    counts = noise_counts(rows, classes).where(F.col("n") > 0)
    numbers = F.sequence(F.lit(0), F.lit(classes - 1))
    lead = lambda j: F.get("probs", j) - F.get("probs", F.col("given"))
    others = F.filter(numbers, lambda j: j != F.col("given"))
    margins = rows.select(
        "given", F.inline(F.transform(others, lambda j: F.struct(j.alias("other"), lead(j).alias("margin"))))
    )

    def targets(cells: DataFrame) -> DataFrame:
        wanted = cells.join(F.broadcast(counts), ["given", "other"])
        return wanted.select(*cells.columns, F.lit(0).alias("target"), (F.col("total") - F.col("n")).alias("rank"))

    cuts = order_statistics(margins, ["given", "other"], "margin", targets)
    keyed = F.struct((F.col("given") * classes + F.col("other")).alias("key"), F.col("value"))
    cut_map = cuts.agg(F.map_from_entries(F.collect_list(keyed)).alias("cuts")).scalar()

    def beyond(j: Column) -> Column:
        cut = F.try_element_at("cuts", F.col("given") * classes + j)
        return F.coalesce((j != F.col("given")) & (lead(j) >= cut), F.lit(False))

    everywhere = F.transform("probs", lambda _: F.lit(True))
    judged = rows.select("*", cut_map.alias("cuts")).select(
        "id",
        "given",
        _best(F.col("probs"), everywhere).alias("suggested"),
        F.exists(numbers, beyond).alias("flagged"),
        "probs",
    )
    flagged = judged.where(F.col("flagged") & (F.col("suggested") != F.col("given")))
    return flagged.select("id", "given", "suggested", (F.array_max("probs") - F.get("probs", "given")).alias("margin"))
