"""Value of each training row for a nearest-neighbour model (KNN-Shapley).

Jia et al., "Efficient task-specific data valuation for nearest neighbor
algorithms", VLDB 2019.  A row that lowers the score of its neighbours is
suspected of carrying a wrong label.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veriparity.functions.values import ratio
from veriparity.operators.detectors import number
from veriparity.operators.features import category
from veriparity.operators.ordered import SLICE, running_sums, slice_by
from veriparity.session import cut_lineage
from veriparity.spec import AuditSpec

# Rows held out for scoring and neighbours per scored row.
HOLDOUT = 100
NEIGHBOURS = 10


def stratified_holdout(rows: DataFrame, order: Sequence[Column], size: int = HOLDOUT) -> DataFrame:
    """Ids of exactly ``size`` rows, each label represented by its share.

    ``rows`` has ``id`` and ``label``; the first rows of each label in ``order``
    are taken.  Shares are rounded by largest remainder.
    """
    counted = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    exact = F.col("n") * size / F.sum("n").over(whole)
    # one row per label from here to the quotas
    quotas = counted.select("label", F.floor(exact).alias("base"), (exact - F.floor(exact)).alias("rest"))
    quotas = quotas.select(
        "label",
        "base",
        F.row_number().over(Window.orderBy(F.desc("rest"), "label")).alias("turn"),
        (F.lit(size) - F.sum("base").over(whole)).alias("left"),
    )
    quotas = quotas.select("label", (F.col("base") + (F.col("turn") <= F.col("left")).cast("int")).alias("quota"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    # the constant limit lets every task drop all but its first rows before the shuffle
    first = rows.withColumn("_place", place).where(F.col("_place") <= size)
    return first.join(F.broadcast(quotas), "label").where(F.col("_place") <= F.col("quota")).select("id")


def distances_to(points: np.ndarray, decimals: int | None = None) -> Callable[[Column], Column]:
    """Euclidean distances from a feature array column to each of a few fixed points."""

    @F.pandas_udf("array<double>")
    def distances(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype=object)
                continue
            rows = np.stack(batch.to_numpy()).astype(np.float64)
            found = np.empty((len(rows), len(points)))
            for j, point in enumerate(points):
                found[:, j] = np.sqrt(np.square(rows - point).sum(axis=1))
            yield pd.Series(list(found if decimals is None else np.round(found, decimals)))

    return distances


def neighbour_weight(place: Column, n: Column, k: int) -> Column:
    """Weight of the row at ``place`` (1 = nearest) of ``n`` in the recursion."""
    return F.when(place == n, 1.0 / n).otherwise(F.least(F.lit(k).cast("double"), place) / (F.lit(float(k)) * place))


def knn_shapley(
    train: DataFrame,
    held: DataFrame,
    k: int = NEIGHBOURS,
    decimals: int | None = None,
    holdout: int = HOLDOUT,
) -> DataFrame:
    """``id, value`` for every training row, averaged over the held-out rows.

    Both inputs have ``id, label, features`` (array of numbers).  ``held`` has at
    most ``holdout`` rows, which are collected.  With ``a_i`` telling whether the
    i-th nearest row agrees with the held-out label and ``w_i`` its weight, the
    recursion sums to ``s_i = a_i w_i + sum over j > i of a_j (w_j - w_{j-1})``:
    a rank and a running sum per held-out row, both taken over slices of the rows
    sorted by distance, so no held-out row needs all training rows in one task.
    The sum from the far end is the total less the sum from the near end, so both
    use one order.
    """
    points = held.orderBy("id").select("features", "label").limit(holdout + 1).collect()
    if not points or len(points) > holdout:
        raise ValueError(f"the holdout must have 1 to {holdout} rows")
    to_points = distances_to(np.array([p["features"] for p in points], dtype=np.float64), decimals)
    return values_by_distance(train, to_points(F.col("features")), [p["label"] for p in points], k)


def values_by_distance(rows: DataFrame, dists: Column, point_labels: Sequence[object], k: int) -> DataFrame:
    """``id, value`` of rows of ``id, label``, whose ``dists`` has one distance per held-out row."""
    labels = F.array(*[F.lit(x) for x in point_labels])
    seen = rows.select("id", "label", F.posexplode(dists).alias("point", "dist"))
    agrees = (F.col("label") == F.get(labels, F.col("point"))).cast("int")
    # written, as cutting into slices passes over its input twice
    seen = cut_lineage(seen.select("point", "dist", "id", agrees.alias("a")))
    by, order = ["point"], ["dist", "id"]
    sliced = slice_by(seen, by, order)
    # one row per held-out row
    sizes = sliced.groupBy("point").agg(F.count(F.lit(1)).cast("double").alias("n"))
    placed = running_sums(sliced, by, order, {"place": F.lit(1).cast("bigint")}).join(F.broadcast(sizes), "point")
    here = neighbour_weight(F.col("place"), F.col("n"), k)
    nearer = neighbour_weight(F.col("place") - 1, F.col("n"), k)
    step = F.when(F.col("place") == 1, F.lit(0.0)).otherwise(F.col("a") * (here - nearer))
    placed = placed.select("point", "dist", "id", SLICE, (F.col("a") * here).alias("own"), step.alias("step"))
    totals = placed.groupBy("point").agg(F.sum("step").alias("total"))
    summed = running_sums(placed, by, order, {"upto": F.col("step")}).join(F.broadcast(totals), "point")
    value = F.sum(F.col("own") + F.col("total") - F.col("upto")) / len(point_labels)
    return summed.groupBy("id").agg(value.alias("value"))


def nearest_rows(train: DataFrame, points: np.ndarray, most: int, decimals: int | None = None) -> DataFrame:
    """``point, dist, id, label, place`` of the ``most`` rows nearest to each point, equal distances in the order of ids.

    A task keeps the nearest rows it has met for each point and gives no more than those.
    """
    kind = {c: train.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple]] = [[] for _ in points]
        farthest = np.full(len(points), np.inf)
        for batch in batches:
            rows = np.array(batch["features"].to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
            ids, labels = batch["id"].to_pylist(), batch["label"].to_pylist()
            for j, point in enumerate(points):
                dist = np.sqrt(np.square(rows - point).sum(axis=1))
                dist = dist if decimals is None else np.round(dist, decimals)
                near = np.flatnonzero(dist <= farthest[j])
                kept[j] += [(d, ids[i], labels[i]) for d, i in zip(dist[near].tolist(), near.tolist(), strict=True)]
                if len(kept[j]) > 2 * most:
                    kept[j] = heapq.nsmallest(most, kept[j], key=lambda x: x[:2])
                    farthest[j] = kept[j][-1][0]
        for j, rows in enumerate(kept):
            rows = heapq.nsmallest(most, rows, key=lambda x: x[:2])
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([j] * len(rows), pa.int32()), pa.array(columns[0], pa.float64()),
                 pa.array(columns[1], batch_type["id"]), pa.array(columns[2], batch_type["label"])],
                names=["point", "dist", "id", "label"],
            )

    batch_type = {c: to_arrow_type(train.schema[c].dataType) for c in ("id", "label")}
    found = train.select("id", "label", "features").mapInArrow(run, f"point int, dist double, id {kind['id']}, label {kind['label']}")
    place = F.row_number().over(Window.partitionBy("point").orderBy("dist", "id"))
    return found.withColumn("place", place).where(F.col("place") <= most)


def nearest_shapley(
    train: DataFrame, held: DataFrame, nearest: int, k: int = NEIGHBOURS, decimals: int | None = None, holdout: int = HOLDOUT
) -> DataFrame:
    """``id, value`` of the rows among the ``nearest`` ones of some held-out row; all other rows count as 0.

    Values differ from those of ``knn_shapley`` by at most ``1 / nearest``, as what the recursion carries in from
    farther rows is at most that (Jia et al., theorem 2).  Nothing is written per row and held-out row: a task
    gives ``nearest`` rows for each of them.  With no more rows than ``nearest`` values are exact.
    """
    if nearest < k:
        raise ValueError(f"at least the {k} neighbours of the model are needed")
    points = held.orderBy("id").select("features", "label").limit(holdout + 1).collect()
    if not points or len(points) > holdout:
        raise ValueError(f"the holdout must have 1 to {holdout} rows")
    labels = F.array(*[F.lit(p["label"]) for p in points])
    found = nearest_rows(train, np.array([p["features"] for p in points], dtype=np.float64), nearest + 1, decimals)
    agrees = (F.col("label") == F.get(labels, F.col("point"))).cast("double")
    # windows over at most ``nearest`` + 1 rows
    one, place = Window.partitionBy("point"), F.col("place")
    found = found.select("point", "id", "place", agrees.alias("a"), F.count(F.lit(1)).over(one).alias("n"))
    following = F.lead("a").over(one.orderBy("place"))
    step = F.when((F.col("n") <= nearest) & (place == F.col("n")), F.col("a") / F.col("n")).when(
        place < nearest, (F.col("a") - following) / k * F.least(F.lit(k), place) / place
    )
    summed = found.withColumn("step", F.coalesce(step, F.lit(0.0))).where(place <= nearest).select(
        "id", F.sum("step").over(one.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)).alias("value")
    )
    return summed.groupBy("id").agg((F.sum("value") / len(points)).alias("value"))


def suspicious(values: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Rows of negative value; the tolerance keeps rounding noise around zero out."""
    return values.where(F.col("value") < -tolerance)


def scaled_cells(train: DataFrame, rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``cells`` (feature by name, value) of ``rows`` under the encoder of ``train``.

    Both have ``num*`` and ``cat*`` columns.  Numbers are imputed and standardised; a category is one over the
    deviation of its 0/1 column, which is a table that is joined: no vocabulary is collected, and a category that
    the training rows lack, or that all of them have, has no cell.
    """
    stats = []
    for i in range(len(numeric)):
        spread = F.stddev_pop(f"num{i}") * F.sqrt(ratio(F.count(f"num{i}"), F.count(F.lit(1))))
        stats += [F.avg(f"num{i}").alias(f"mean{i}"), spread.alias(f"sd{i}")]
    total = F.count(F.lit(1)).alias("rows")
    whole = train.agg(total, *stats).select(F.struct("*").alias("s")).scalar()
    numbers = []
    for i, c in enumerate(numeric):
        mean, sd = F.col(f"_s.mean{i}"), F.col(f"_s.sd{i}")
        scaled = F.coalesce(ratio(F.coalesce(F.col(f"num{i}"), mean) - mean, sd), F.lit(0.0))
        numbers.append(F.struct(F.lit(c).alias("feature"), scaled.alias("value")))
    names = [F.concat(F.lit(f"{c}="), F.col(f"cat{i}")) for i, c in enumerate(categorical)]
    ready = rows.select(*keep, whole.alias("_s"), F.array(*numbers).cast(CELLS).alias("numbers"), F.array(*names).cast("array<string>").alias("names"))
    if not categorical:
        return ready.select(*keep, F.col("numbers").alias("cells"))
    counts = train.select(F.explode(F.array(*names)).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.col("_s.rows")
    deviation = F.sqrt(share * (1 - share) * F.col("_s.rows") / (F.col("_s.rows") - 1))
    weights = counts.select("feature", F.col("n"))
    spread = ready.select("id", "_s", F.explode("names").alias("feature")).join(weights, "feature")
    hot = spread.where(F.col("n") < F.col("_s.rows")).select("id", F.struct("feature", (1 / deviation).alias("value")).alias("cell"))
    hot = hot.groupBy("id").agg(F.collect_list("cell").cast(CELLS).alias("hot"))  # as many as there are columns
    return ready.join(hot, "id", "left").select(
        *keep, F.concat("numbers", F.coalesce("hot", F.array().cast(CELLS))).alias("cells")
    )


CELLS = "array<struct<feature: string, value: double>>"


def sparse_distances(rows: DataFrame, points: Sequence[dict[str, float]], decimals: int = 6) -> DataFrame:
    """``id, label, dists`` of rows of ``id, label, cells``: distances to each point, absent cells being 0.

    Only names that a point has tell the points apart; they are at most the cells of all points.
    """
    names = sorted({name for point in points for name in point})
    table = np.array([[point.get(name, 0.0) for name in names] for point in points]).reshape(len(points), len(names))
    squares = np.square(table)
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                lists = batch["cells"]
                flat = lists.flatten()
                owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
                value = np.asarray(flat.field("value"))
                found = np.asarray(pa.compute.index_in(flat.field("feature"), pa.array(names, pa.string())).fill_null(-1))
                out = np.tile(squares.sum(axis=1), (batch.num_rows, 1))
                out += np.bincount(owner, np.where(found < 0, value * value, 0), batch.num_rows)[:, None]
                known = np.flatnonzero(found >= 0)
                place = table[:, found[known]]
                np.add.at(out, owner[known], (np.square(value[known] - place) - np.square(place)).T)
                dists = np.round(np.sqrt(np.maximum(out, 0)), decimals)
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(points))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["label"], pa.ListArray.from_arrays(offsets, pa.array(dists.ravel()))], names=["id", "label", "dists"]
                )

    return rows.select("id", "label", "cells").mapInArrow(run, f"id {kind['id']}, label {kind['label']}, dists array<double>")


def mislabelled_by_value(
    df: DataFrame, spec: AuditSpec, seed: int = 42, k: int = NEIGHBOURS, order: Sequence[Column] | None = None
) -> DataFrame:
    """Ids and values of the rows a nearest-neighbour model would rather do without.

    The held-out rows are the first of each label in ``order`` -- by default that of a hash of id and seed, so the
    draw does not depend on partitioning; they are not valued themselves.  The encoder is fitted on the training
    rows.  Rows are sparse cells by name, so columns may have any number of categories.
    """
    keep = {"id": F.col(spec.id_col), "label": spec.label_column()}
    rows = cut_lineage(df.select(
        *[value.alias(name) for name, value in keep.items()],
        *[number(c).alias(f"num{i}") for i, c in enumerate(spec.numeric)],
        *[category(c).alias(f"cat{i}") for i, c in enumerate(spec.categorical)],
    ))
    if rows.count() <= HOLDOUT:
        raise ValueError(f"more than {HOLDOUT} rows are needed")
    order = [F.xxhash64("id", F.lit(seed)), F.col("id")] if order is None else order
    held_ids = F.broadcast(stratified_holdout(rows.select("id", "label"), order))
    train, held = rows.join(held_ids, "id", "left_anti"), rows.join(held_ids, "id", "left_semi")
    encoded = [scaled_cells(train, part, spec.numeric, spec.categorical, ["id", "label"]) for part in (train, held)]
    points = encoded[1].orderBy("id").collect()  # as many as are held out
    cells = [{c["feature"]: c["value"] for c in p["cells"]} for p in points]
    return suspicious(values_by_distance(sparse_distances(encoded[0], cells), F.col("dists"), [p["label"] for p in points], k))
