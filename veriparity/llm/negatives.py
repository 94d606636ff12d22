"""Hard-negative mining by angular triangle filtering.

Vectors become integers, so scores (inner products) and their ties are exact.  For
each anchor the best rows of its label are its positives; for each positive the
best rows of other labels whose score lies in a window below the positive's score
are its hard negatives.

1. References.  A bounded sample gives a few directions that lie far from each
   other.  Every row stores its angles to them; rows are range-partitioned by their
   nearest direction and the angle to it, so that neighbours stand in one block and
   a hot direction spans many partitions.
2. Bounds.  For an anchor at angle x and a row at angle y to a reference, the angle
   between the two lies in [|x - y|, x + y].  Over all references this gives an
   interval of cosines, times both norms one of scores, widened by more than
   rounding can take.
3. Filter.  Intervals of whole blocks (from the extremes of their angles and norms)
   rule out anchors, intervals of pairs rule out rows.  Only where the interval
   overlaps what is still wanted -- a score not below the best so far, or a window of
   a positive -- are integers multiplied.
4. Anchors are the stated query set.  They are sent to the tasks in rounds of at most
   ``ROUND_BYTES``; rows stay where they are, and a task returns the few best of its
   rows for each anchor, which a window function merges.  Before that, anchors meet
   the rows of their own block, which gives a first limit.

References decide the cost, never the result.

Cases: rows with a null id, label or vector, with null or non-finite components, or
with an integer vector of norm 2^31 or more (their scores need not fit a long) take
no part; rows of different length have no score; ties go to the smaller id; a row with
the anchor's id is not another row, and repeated rows otherwise count each; an anchor
without positives, and a positive without rows in its window, gives no rows; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriparity.session import cut_lineage

REFERENCES = 16
SAMPLE_ROWS = 2048
BLOCK = 1024
ANCHORS_AT_ONCE = 256
ROUND_BYTES = 32 << 20
MOST_NORM = 2.0**31
ANGLE_SLACK = np.float32(4e-6)  # angles are stored as floats below pi
COSINE_SLACK = np.float32(1e-5)
NONE = np.int64(-(2**63) + 1)


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id``, ``label``, ``dim``, ``v`` (floor of ``scale`` times each component) and ``norm`` of the rows that take part."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.lit(float(scale)) * c)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST_NORM))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    rows = rows.withColumn("v", F.transform("x", lambda c: F.floor(c).cast("int")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c))
    return rows.select("vec_id", "label", F.size("v").alias("dim"), "v", norm.alias("norm")).where(F.col("norm") < MOST_NORM)


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(len(column), width)


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def far_apart(v: np.ndarray, references: int) -> np.ndarray:
    """Directions among rows, each the one farthest from those before; repeated if there are fewer."""
    u = unit(v)
    chosen, nearest = [0], u @ u[0]
    while len(chosen) < min(references, len(u)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, u @ u[chosen[-1]])
    return u[np.resize(chosen, references)]


def references_of(rows: DataFrame, references: int, sample_rows: int) -> dict[int, np.ndarray]:
    """Reference directions by length of vector, from the rows with the smallest hashes of their ids."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(sample_rows).select("dim", "v").toArrow().combine_chunks()
    dims = sample["dim"].to_numpy()
    lists = sample["v"].chunk(0) if sample.num_rows else None
    return {
        int(d): far_apart(matrix(lists.filter(pa.array(dims == d)), int(d), np.float64), references) for d in np.unique(dims)
    }


def axes(dim: int, references: int) -> np.ndarray:
    """Directions for a length that the sample has not met."""
    return np.eye(max(dim, 1))[np.arange(references) % max(dim, 1), :dim]


def blocks(batch: pa.RecordBatch, most: int = BLOCK) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows with vectors of one length, at most ``most`` rows each."""
    dims = batch["dim"].to_numpy()
    edges = np.flatnonzero(np.append(True, dims[1:] != dims[:-1])) if len(dims) else []
    for start, stop in zip(edges, [*edges[1:], len(dims)], strict=True):
        for at in range(start, stop, most):
            yield int(dims[at]), batch.slice(at, min(most, stop - at))


PLACED = "vec_id long, label long, dim int, v array<int>, norm double, angles array<float>, cell int, near float"


def placed(rows: DataFrame, directions: dict[int, np.ndarray], references: int) -> DataFrame:
    """Rows with their angles to the references, neighbours in one partition."""

    def run(batches):
        for batch in batches:
            for dim, part in blocks(batch):
                u = unit(matrix(part["v"], dim, np.float64))
                to = directions.get(dim)
                cosines = u @ (axes(dim, references) if to is None else to).T
                angles = np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)
                cell = angles.argmin(axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(u) + 1, dtype=np.int32) * references), pa.array(angles.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, lists, pa.array(cell), pa.array(angles[np.arange(len(u)), cell])],
                    names=[*part.schema.names, "angles", "cell", "near"],
                )

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["dim", "cell", "near"]
    return rows.mapInArrow(run, PLACED).repartitionByRange(n, *order, "vec_id").sortWithinPartitions(*order)


class Side:
    """Vectors of one length with all that bounds need."""

    def __init__(self, part, dim: int, references: int):
        self.ids, self.labels = (part[c].to_numpy() for c in ("vec_id", "label"))
        self.v = matrix(part["v"], dim, np.float64)
        self.norms = part["norm"].to_numpy()
        self.angles = matrix(part["angles"], references, np.float32)


def scores_of(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of integers, exact: as doubles where every sum stays below 2^53, else as longs."""
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def scaled(cosines: np.ndarray, low: np.ndarray, high: np.ndarray, up: bool) -> np.ndarray:
    """Bound of scores from a bound of cosines, where the product of norms lies between ``low`` and ``high``."""
    slack = COSINE_SLACK * high + 1
    positive = cosines >= 0
    return np.where(positive, cosines * high, cosines * low) + slack if up else np.where(positive, cosines * low, cosines * high) - slack


def block_bounds(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest score that each anchor can have with any row of a block."""
    low, high = b.angles.min(axis=0), b.angles.max(axis=0)
    apart = np.maximum(np.maximum(a.angles - high, low - a.angles), 0).max(axis=1)
    most = np.minimum((a.angles + high).min(axis=1), (2 * np.pi - a.angles - low).min(axis=1))
    least_norm, most_norm = a.norms * b.norms.min(), a.norms * b.norms.max()
    upper = scaled(np.cos(np.maximum(apart - ANGLE_SLACK, 0)), least_norm, most_norm, True)
    lower = scaled(np.cos(np.minimum(most + ANGLE_SLACK, np.pi)), least_norm, most_norm, False)
    return lower, upper


def pair_bounds(a: Side, some: np.ndarray, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest score of each pair of some anchors and the rows of a block."""
    shape = len(some), len(b.ids)
    apart, most, work = np.zeros(shape, np.float32), np.full(shape, np.pi, np.float32), np.empty(shape, np.float32)
    for r in range(a.angles.shape[1]):
        x, y = a.angles[some, r][:, None], b.angles[:, r][None]
        np.abs(np.subtract(x, y, out=work), out=work)
        np.maximum(apart, work, out=apart)
        np.add(x, y, out=work)
        np.minimum(most, work, out=most)
    norms = (a.norms[some][:, None] * b.norms[None]).astype(np.float32)
    upper = scaled(np.cos(np.maximum(apart - ANGLE_SLACK, 0)), norms, norms, True)
    lower = scaled(np.cos(np.minimum(most + ANGLE_SLACK, np.float32(np.pi))), norms, norms, False)
    return lower, upper


class Best:
    """The ``k`` best (score, id) of each of ``n`` groups: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids, self.k = np.full((n, k), NONE), np.zeros((n, k), np.int64), k

    def least(self) -> np.ndarray:
        """What a score must reach to enter a group."""
        return self.scores[:, -1]

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        use = score >= self.scores[group, -1]
        group, score, ids = group[use], score[use], ids[use]
        known = np.unique(group)
        group = np.concatenate([group, np.repeat(known, self.k)])
        score = np.concatenate([score, self.scores[known].ravel()])
        ids = np.concatenate([ids, self.ids[known].ravel()])
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        top = place < self.k
        self.scores[group[top], place[top]] = score[top]
        self.ids[group[top], place[top]] = ids[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, place = np.nonzero(self.scores > NONE)
        return group, self.scores[group, place], self.ids[group, place]


def search(a: Side, b: Side, wanted, take) -> None:
    """Scores the pairs whose interval overlaps what is ``wanted`` and gives them to ``take``.

    ``wanted(anchors, lower, upper)`` tells, by anchor or by pair, where to look.
    """
    lower, upper = block_bounds(a, b)
    live = np.flatnonzero(wanted(np.arange(len(a.ids)), lower[:, None], upper[:, None])[:, 0])
    most = float(a.norms.max(initial=0)) * float(b.norms.max(initial=0))
    for start in range(0, len(live), ANCHORS_AT_ONCE):
        some = live[start : start + ANCHORS_AT_ONCE]
        look = wanted(some, *pair_bounds(a, some, b), b)
        rows, columns = np.flatnonzero(look.any(axis=1)), np.flatnonzero(look.any(axis=0))
        if len(rows):
            scores = scores_of(a.v[some[rows]], b.v[columns], most)
            i, j = np.nonzero(look[np.ix_(rows, columns)])
            take(some[rows[i]], scores[i, j], columns[j])


def wants_best(a: Side, best: Best, limits: np.ndarray):
    """Same label, and a score that may enter the best of the anchor."""

    def wanted(some, lower, upper, b=None):
        look = upper >= np.maximum(best.least()[some], limits[some])[:, None]
        if b is not None:
            look = look & (a.labels[some][:, None] == b.labels[None]) & (a.ids[some][:, None] != b.ids[None])
        return look

    return wanted


ANCHOR = PLACED.rsplit(", cell", 1)[0] + ", seed long, part int, nth long"


def anchors_of(rows: DataFrame, every: int, positives: int, references: int) -> DataFrame:
    """Rows whose id ``every`` divides, with a number, and a score that their last positive reaches at least."""

    def run(batches):
        from pyspark import TaskContext

        part_no, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for dim, part in blocks(batch):
                mine = part.filter(pa.array(part["vec_id"].to_numpy() % every == 0))
                if not mine.num_rows:
                    continue
                a, b = Side(mine, dim, references), Side(part, dim, references)
                best = Best(len(a.ids), positives)
                search(
                    a, b, wants_best(a, best, np.full(len(a.ids), NONE)),
                    lambda i, s, j, best=best, b=b: best.add(i, s, b.ids[j]),
                )
                yield pa.RecordBatch.from_arrays(
                    [*mine.columns[:6], pa.array(best.least()), pa.array(np.full(len(a.ids), part_no, np.int32)), pa.array(np.arange(len(a.ids)) + nth)],
                    names=[*mine.schema.names[:6], "seed", "part", "nth"],
                )
                nth += len(a.ids)

    return rows.mapInArrow(run, ANCHOR)


def rounds_of(anchors: DataFrame, positives: int, negatives: int, round_bytes: int) -> list[Column]:
    """Conditions that choose anchors of at most ``round_bytes`` each (one step of anchors at least)."""
    step = 256
    sizes = anchors.groupBy("part", F.expr(f"nth div {step}").alias("step")).agg(F.sum(F.col("dim") * 8 + 300 + 24 * positives * negatives).alias("size"))
    found, held = [], 0
    for part, at, size in sorted(tuple(r) for r in sizes.collect()):
        if not found or held + size > round_bytes:
            found.append([])
            held = 0
        held += size
        if found[-1] and found[-1][-1][0] == part and found[-1][-1][2] == at:
            found[-1][-1][2] = at + 1
        else:
            found[-1].append([part, at, at + 1])
    inside = lambda p, low, high: (F.col("part") == p) & (F.col("nth") >= low * step) & (F.col("nth") < high * step)
    return [reduce(lambda x, y: x | y, [inside(*x) for x in group]) for group in found]


def sides_of(anchors: DataFrame, references: int) -> tuple[dict[int, tuple[np.ndarray, Side]], np.ndarray, np.ndarray]:
    """Anchors of a round by length of vector, with their numbers in the round; ids and seeds of all."""
    table = anchors.orderBy("dim", "part", "nth").toArrow().combine_chunks()
    dims, seeds = table["dim"].to_numpy(), table["seed"].to_numpy()
    sides = {}
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        part = table.slice(at[0], len(at)).combine_chunks().to_batches()[0]
        sides[int(dim)] = at, Side(part, int(dim), references)
    return sides, table["vec_id"].to_numpy(), seeds


FOUND = "anchor int, score long, id long"


def positives_of(rows: DataFrame, sent, positives: int, references: int) -> DataFrame:
    """The best rows of each anchor's label: number of the anchor in the round, score, id, rank."""

    def run(batches):
        sides, ids, seeds = sent.value
        best = Best(len(ids), positives)
        for batch in batches:
            for dim, part in blocks(batch):
                if dim in sides:
                    number, a = sides[dim]
                    b, mine = Side(part, dim, references), Best(0, positives)
                    mine.scores, mine.ids = best.scores[number], best.ids[number]
                    search(a, b, wants_best(a, mine, seeds[number]), lambda i, s, j, b=b, mine=mine: mine.add(i, s, b.ids[j]))
                    best.scores[number], best.ids[number] = mine.scores, mine.ids
        group, score, found = best.rows()
        use = score >= seeds[group]
        yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (group.astype(np.int32), score, found)], names=["anchor", "score", "id"])

    return ranked(rows.mapInArrow(run, FOUND), positives, "anchor")


def ranked(found: DataFrame, k: int, *group: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def windows_of(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers n with low * score <= 100 * n <= high * score; an absent score has none."""
    q, r = scores // 100, scores % 100
    lowest, highest = low * q - (-low * r) // 100, high * q + high * r // 100
    absent = scores == NONE
    return np.where(absent, 1, lowest), np.where(absent, 0, highest)


MINED = "anchor_id long, positive_id long, positive_rank int, positive_score long, score long, id long"


def negatives_of(rows: DataFrame, sent, negatives: int, references: int) -> DataFrame:
    def run(batches):
        sides, ids, scores, found, lowest, highest = sent.value
        n, width = scores.shape
        best = Best(n * width, negatives)
        for batch in batches:
            for dim, part in blocks(batch):
                if dim not in sides:
                    continue
                number, a = sides[dim]
                b = Side(part, dim, references)
                low, high = lowest[number], highest[number]
                group = number[:, None] * width + np.arange(width)

                def wanted(some, lower, upper, b=None, a=a, low=low, high=high, group=group):
                    least = np.maximum(low[some], best.least()[group[some]])
                    look = np.zeros(upper.shape, bool)
                    for w in range(width):
                        look |= (upper >= least[:, w, None]) & (lower <= high[some, w, None]) & (low[some, w] <= high[some, w])[:, None]
                    return look if b is None else look & (a.labels[some][:, None] != b.labels[None]) & (a.ids[some][:, None] != b.ids[None])

                def take(i, s, j, b=b, low=low, high=high, group=group):
                    for w in range(width):
                        inside = (s >= low[i, w]) & (s <= high[i, w])
                        best.add(group[i[inside], w], s[inside], b.ids[j[inside]])

                search(a, b, wanted, take)
        group, score, negative = best.rows()
        k, w = group // width, group % width
        columns = (ids[k], found[k, w], (w + 1).astype(np.int32), scores[k, w], score, negative)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, group.astype(np.int64))], names=[*(x.split()[0] for x in MINED.split(", ")), "group"])

    mined = ranked(rows.mapInArrow(run, MINED + ", group long"), negatives, "group")
    return mined.select(
        "anchor_id", "positive_id", "positive_rank", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    references: int = REFERENCES, sample_rows: int = SAMPLE_ROWS, round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """One row per anchor (id divisible by ``every``), positive and hard negative.

    A negative of positive p has ``low`` percent of p's score at least and ``high`` percent at most.
    """
    spark = vectors.sparkSession
    whole = cut_lineage(integers(vectors, scale))
    rows = cut_lineage(placed(whole, references_of(whole, references, sample_rows), references))
    anchors = cut_lineage(anchors_of(rows, every, positives, references))
    mined = []
    for chosen in rounds_of(anchors, positives, negatives, round_bytes):
        sides, ids, seeds = sides_of(anchors.where(chosen), references)
        best = positives_of(rows, spark.sparkContext.broadcast((sides, ids, seeds)), positives, references).toArrow()
        scores, found = np.full((len(ids), positives), NONE), np.zeros((len(ids), positives), np.int64)
        at = best["anchor"].to_numpy(), best["rank"].to_numpy() - 1
        scores[at], found[at] = best["score"].to_numpy(), best["id"].to_numpy()
        sent = spark.sparkContext.broadcast((sides, ids, scores, found, *windows_of(scores, low, high)))
        mined.append(negatives_of(rows, sent, negatives, references))
    if not mined:
        schema = "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, mined)
