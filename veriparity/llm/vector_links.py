"""Embedding near-duplicates by random-hyperplane sign hashing.

Equal vectors are one class.  Every class gets, in each of several tables, the
signs of its products with some random hyperplanes as its bucket.  All pairs of a
bucket are verified by their cosine in double precision, as products of blocks:
a bucket of many classes is cut into blocks, and each pair of blocks is a group of
its own, so no group grows with a bucket and no pair of vectors becomes a row.
A pair that shares buckets in several tables counts in the first of them.  Each
group returns, per class, the number of links and the smallest linked class; the
latter make a sparse graph whose connected components are found by joins.

Hyperplanes per table grow with the logarithm of the number of classes, tables so
that a pair right at the threshold is found with probability ``recall``.

Cases: null, zero, empty vectors and ones with null or non-finite components link
with nothing; vectors of different length do not link; repeated rows are vectors
of their own; rows without id get no component; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriparity.llm.common import LAST_ID
from veriparity.llm.graph import components, local_roots
from veriparity.session import cut_lineage

BLOCK = 1024
BUCKET_CLASSES = 64


def shape_of(classes: int, threshold: float, recall: float) -> tuple[int, int]:
    """Hyperplanes per table and number of tables."""
    planes = min(24, max(8, math.ceil(math.log2(max(1, classes) / BUCKET_CLASSES))))
    same = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - same))


def hyperplanes(dim: int, planes: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * planes))


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashed(classes: DataFrame, planes: int, tables: int, seed: int) -> DataFrame:
    """Classes with ``buckets``: one number per table."""

    def run(batches):
        known = {}
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in known:
                    known[dim] = hyperplanes(int(dim), planes, tables, seed)
                signs = (unit(rows_of(part["embedding"], int(dim))) @ known[dim] >= 0).reshape(-1, tables, planes)
                buckets = (signs * (1 << np.arange(planes))).sum(axis=2).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(buckets) + 1, dtype=np.int32) * tables), pa.array(buckets.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "buckets"])

    return classes.mapInArrow(run, "rep long, n long, dim int, embedding array<double>, buckets array<int>")


def verified(threshold: float):
    def run(key, group):
        table, dim, _, i, j = (x.as_py() for x in key)
        group = group.combine_chunks()
        block = group["block"].to_numpy()
        rep, n = group["rep"].to_numpy(), group["n"].to_numpy()
        x = unit(rows_of(group["embedding"].chunk(0), dim))
        buckets = np.asarray(group["buckets"].chunk(0).flatten()).reshape(len(rep), -1)
        left, right = (np.flatnonzero(block == b) for b in (i, j))
        a, b = np.nonzero(x[left] @ x[right].T >= threshold)
        a, b = left[a], right[b]
        first = a < b if i == j else np.ones(len(a), bool)
        a, b = a[first], b[first]
        new = np.ones(len(a), bool)
        for t in range(table):
            new &= buckets[a, t] != buckets[b, t]
        a, b = a[new], b[new]
        links = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
        order = np.argsort(rep, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = rep[order[local_roots(len(rep), place[a], place[b])]][place]
        keep = links > 0
        return pa.table({"rep": rep[keep], "links": links[keep].astype(np.int64), "root": root[keep]})

    return run


def vector_links(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.9995, seed: int = 7) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID)).alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = (
        F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = cut_lineage(
        rows.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .select("rep", "n", F.size("embedding").alias("dim"), "embedding")
    )
    planes, tables = shape_of(classes.count(), threshold, recall)
    spread = cut_lineage(hashed(classes, planes, tables, seed))
    placed = spread.select("*", F.posexplode("buckets").alias("table", "bucket"))
    key = ["table", "dim", "bucket"]
    sizes = spread.select("dim", F.posexplode("buckets").alias("table", "bucket")).groupBy(key).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size")
    )
    placed = placed.join(sizes.where("size > 1").drop("size"), key)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = placed.select(
        *key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "embedding", "buckets"
    )
    found = cut_lineage(
        pairs.groupBy(*key, "i", "j").applyInArrow(verified(threshold), "rep long, links long, root long")
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    facts = (
        classes.select("rep", "n", "embedding").join(links, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .select("embedding", F.coalesce("links", F.lit(0)).alias("links"), "n", F.coalesce("component", "rep").alias("component"))
    )
    out = rows.join(facts.withColumn("sound", F.lit(True)), ["sound", "embedding"], "left")
    component = F.coalesce("component", "vec_id")
    known = F.col("vec_id") < LAST_ID
    return out.select(
        F.when(known, F.col("vec_id")).alias("vec_id"),
        F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.when(component < LAST_ID, component).alias("component_id"),
        (known & (component == F.col("vec_id"))).alias("kept"),
    )
