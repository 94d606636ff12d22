"""Isolation forest (Liu et al., ICDM 2008): rows that random splits isolate early.

Trees are small (at most 256 sampled rows each), so they are grown one per task
and sent to all tasks; the data is only scored.  All draws are hashes -- of the row
for the samples, of tree and node for the splits -- so a forest is a function of the
data and the seed, which another engine can repeat.

Rows are sparse: named cells, absent ones 0.  Only names that split a node, of which
a forest has a bounded number, are looked at when rows are scored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriparity.operators.features import encoded_cells
from veriparity.operators.quantiles import exact_percentiles
from veriparity.session import cut_lineage
from veriparity.spec import AuditSpec

# The published size of a forest and of its samples, and the share of rows taken as outliers.
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.01
# candidates per sampled row: enough that fewer than SAMPLE candidates practically never turn up
OVERSAMPLING = 4
DRAWS = 2**31 - 1  # a prime, so a row's draws differ from tree to tree
DEPTH_DECIMALS = 9  # sums of depths are equal for equal rows, in whatever order they are added

TREE_SCHEMA = (
    "tree int, feature array<string>, threshold array<double>, left array<int>, right array<int>, path array<double>"
)


def path_length(n: int) -> float:
    """Mean depth at which a search among ``n`` rows ends without a hit."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def draw_samples(rows: DataFrame, n: int, seed: int, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """``tree, id, cells``: up to ``sample`` rows per tree, drawn without replacement.

    Each tree takes the rows with the smallest draws, which is the same sample for a
    table of any size; that a draw lies below a limit of a few samples per table only
    keeps rows from being sorted that no tree takes.  One digest per row gives a start
    and a step, whose multiples are the draws of all trees.
    """
    limit = int(DRAWS * min(1.0, sample * OVERSAMPLING / max(n, 1)))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    placed = rows.select("id", "cells", part(1).alias("_start"), part(9).alias("_step"))
    draw = lambda tree: F.pmod(F.col("_start") + tree * F.col("_step"), F.lit(DRAWS))
    taken = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < limit)
    drawn = placed.select("*", F.explode(taken).alias("tree"))
    turn = F.row_number().over(Window.partitionBy("tree").orderBy(draw(F.col("tree")), "id"))
    return drawn.withColumn("_turn", turn).where(F.col("_turn") <= sample).select("tree", "id", "cells")


def node_draws(seed: int, tree: int, node: int) -> tuple[float, float]:
    """Two numbers in [0, 1): which feature splits the node, and where."""
    digest = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
    return int(digest[:8], 16) / 2**32, int(digest[8:16], 16) / 2**32


def grow_tree(seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Grow one tree by drawn splits until rows are alone or the depth is used up.

    Node 1 is the root, and the children of node i are 2 i (up to the cut) and 2 i + 1.
    """

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        rows = [{cell["feature"]: cell["value"] for cell in cells} for cells in sample["cells"]]
        names = sorted({name for row in rows for name in row}, key=str.encode)
        values = np.array([[row.get(name, 0.0) for name in names] for row in rows], dtype=np.float64).reshape(len(rows), len(names))
        deepest = math.ceil(math.log2(max(len(values), 2)))
        nodes: list[list] = []
        pending = [(np.arange(len(values)), 0, 1, -1, 0)]
        while pending:
            members, depth, node, parent, side = pending.pop()
            here = len(nodes)
            if parent >= 0:
                nodes[parent][side] = here
            low, high = values[members].min(axis=0), values[members].max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth >= deepest or len(members) <= 1 or len(open_features) == 0:
                nodes.append([None, 0.0, -1, -1, depth + path_length(len(members))])
                continue
            which, where = node_draws(seed, tree, node)
            feature = int(open_features[int(which * len(open_features))])
            cut = float(low[feature] + where * (high[feature] - low[feature]))
            goes_left = values[members, feature] <= cut
            nodes.append([names[feature], cut, -1, -1, 0.0])
            pending.append((members[~goes_left], depth + 1, 2 * node + 1, here, 3))
            pending.append((members[goes_left], depth + 1, 2 * node, here, 2))
        columns = list(zip(*nodes))
        return pd.DataFrame({
            "tree": [tree],
            "feature": [list(columns[0])],
            "threshold": [list(columns[1])],
            "left": [list(columns[2])],
            "right": [list(columns[3])],
            "path": [list(columns[4])],
        })

    return grow


Tree = tuple[Sequence[str | None], Sequence[float], Sequence[int], Sequence[int], Sequence[float]]


def anomaly_scores(rows: DataFrame, trees: Sequence[Tree], sample_size: int) -> DataFrame:
    """``id, score`` of rows of ``id, cells``: a score in (0, 1], the higher the easier a row is to isolate.

    A batch is held as its cells that split a node, in the order of row and name; a value is found by bisection.
    """
    scale = path_length(sample_size) or 1.0
    names = sorted({name for tree in trees for name in tree[0] if name is not None})
    number = {name: i for i, name in enumerate(names)}
    walked = [
        (np.array([number.get(x, -1) for x in feature]), *(np.array(x) for x in rest)) for feature, *rest in trees
    ]
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["cells"]
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            found = pa.compute.index_in(flat.field("feature"), pa.array(names, pa.string()))
            used = np.flatnonzero(np.asarray(found.is_valid()))
            key = owner[used] * len(names) + np.asarray(found.fill_null(-1))[used]
            order = np.argsort(key, kind="stable")
            key, value = key[order], np.asarray(flat.field("value"))[used][order]
            depth = np.zeros(batch.num_rows)
            for feature, threshold, left, right, path in walked:
                at = np.zeros(batch.num_rows, dtype=np.int64)
                moving = np.arange(batch.num_rows)
                while len(moving := moving[feature[at[moving]] >= 0]):
                    node = at[moving]
                    wanted = moving * len(names) + feature[node]
                    place = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
                    here = np.where(key[place] == wanted, value[place], 0.0) if len(key) else np.zeros(len(moving))
                    at[moving] = np.where(here <= threshold[node], left[node], right[node])
                depth += path[at]
            score = np.exp2(-np.round(depth, DEPTH_DECIMALS) / (len(walked) * scale))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(score)], names=["id", "score"])

    return rows.select("id", "cells").mapInArrow(run, f"id {kind}, score double")


def isolation_scores(rows: DataFrame, seed: int, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """``id, score`` for rows of ``id, cells``."""
    n = rows.count()
    grown = draw_samples(rows, n, seed, trees, sample).groupBy("tree").applyInPandas(grow_tree(seed), TREE_SCHEMA)
    # ``trees`` trees of fewer than 2 * ``sample`` nodes
    forest = [
        tuple(t[c] for c in ("feature", "threshold", "left", "right", "path"))
        for t in sorted(grown.collect(), key=lambda t: t["tree"])
    ]
    return anomaly_scores(rows, forest, min(n, sample))


def beyond_percentile(scores: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """The ``id, score`` rows with the largest scores: the exact percentile, interpolated, is the cut."""
    normal = scores.select(F.lit("all").alias("part"), (-F.col("score")).alias("normality"))
    cut = exact_percentiles(normal, ["part"], "normality", (contamination,)).select("q0").scalar()
    return scores.select("*", cut.alias("_cut")).where(-F.col("score") < F.col("_cut")).select("id", "score")


def outliers_by_isolation(
    df: DataFrame,
    spec: AuditSpec,
    seed: int,
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    sample: int = SAMPLE,
) -> DataFrame:
    """``id, score`` of the most isolated share of rows.

    The scores are written once because the percentile and the selection both read them.
    """
    rows = encoded_cells(df, spec.id_col, spec.numeric, spec.categorical)
    return beyond_percentile(cut_lineage(isolation_scores(rows, seed, trees, sample)), contamination)
