"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

Signatures: every shingle visits the registers in a random order of its own, its
value in the j-th register it visits lies between j and j + 1, and a register
keeps the smallest.  The values of one shingle are ranks of one permutation, which
gives less variance than independent ones; and once every register holds a value
below j + 1, no later visit can change anything, so long texts stop after a visit
or two.  All shingles of a slice of documents make their j-th visit together.

Documents with equal shingle sets are one class.  Classes that agree in a band of
registers are candidates, and the classes that candidates connect are a cluster.
Within a cluster the intersections of all whole shingle sets are counted, block by
block, as products of 0/1 matrices over the shingles that several sets hold; no
pair becomes a row.  Each pair of blocks returns, per class, the smallest class it
is connected with by links at the threshold, and the components of these links
are the groups.  A cluster of any size is cut into blocks, so no task grows with it.

Bands are as long as they can be while a pair right at the threshold shares none
with a probability below ``MISSED``.

Cases: null, empty and blank texts have the empty set and link with nothing;
texts with fewer words than a shingle are one shingle; repeated rows are one
class; rows without id get no component and are kept; an empty table gives an
empty table; ``near_duplicates`` ignores other columns, ``keep_first`` carries
them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriparity.llm.common import LAST_ID, Memo, as_bytes, coded, gram_codes, mixed, slices, texts_of, word_codes
from veriparity.llm.graph import components, local_roots
from veriparity.session import cut_lineage

REGISTERS = 256
MISSED = 1e-5
BLOCK = 256
COLUMNS = 4096  # shingles counted at once


def band_length(percent: int) -> int:
    share = percent / 100
    return max(r for r in range(1, 17) if r == 1 or (1 - share**r) ** (REGISTERS // r) < MISSED)


def shingle_sets(texts: list[bytes], size: int, codes: Memo) -> list[np.ndarray]:
    """Distinct 64-bit codes of the word n-grams of each text, sorted; ASCII letters count without case."""
    words, counts = coded([t.lower() for t in texts], codes)
    grams = gram_codes(words, size, size)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        else:  # the whole sequence as one
            out.append(gram_codes(words[at : at + n], n, n)[:1] if n else words[:0])
        at += n
    return out


def signatures(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """One row of ``m`` registers per set; empty sets have rows of the largest value."""
    full = np.uint64(2**63)
    out = np.full((len(sets), m), full, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = None
    for j in range(m):
        with np.errstate(over="ignore"):
            draw = mixed(x + np.uint64(j + 1) * np.uint64(0xD1342543DE82EF95))
        k = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        value = (mixed(draw) >> np.uint64(12)) | np.uint64(j << 52)
        if order is None:
            register = k
        else:
            rows = np.arange(len(x))
            register = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
        np.minimum.at(out.reshape(-1), doc * m + register, value)
        go = (out >= np.uint64((j + 1) << 52)).any(axis=1)[doc]
        if not go.any() or j == m - 1:
            break
        if order is None:
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (int(go.sum()), 1))
            order[np.arange(len(order)), k[go]] = 0
        else:
            order = order[go]
        x, doc = x[go], doc[go]
    return out


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def signed_documents(docs: DataFrame, size: int, band: int) -> DataFrame:
    """Set size, digest of the set, and the keys of the signature's bands."""
    n = REGISTERS // band

    def run(batches):
        codes = word_codes()
        for part in slices(batches):
            sets = shingle_sets(as_bytes(part["text"]), size, codes)
            sig = signatures(sets)
            with np.errstate(over="ignore"):
                a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                b = np.array([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
                bands = np.zeros((len(sets), n), np.uint64)
                for i in range(band):
                    bands = mixed(bands * np.uint64(31) + sig[:, i * n : (i + 1) * n])
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n), pa.array(bands.ravel().view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)),
                 pa.array(b.view(np.int64)), lists],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return texts_of(docs).mapInArrow(run, SIGNED)


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The rows of ``wanted`` (``id`` and more) with the shingle sets of the documents they name."""
    more = [c for c in wanted.columns if c != "id"]

    def run(batches):
        codes = word_codes()
        for part in slices(batches):
            sets = shingle_sets(as_bytes(part["text"]), size, codes)
            lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], lists, *(part[c] for c in more)], names=["id", "shingles", *more])

    rows = texts_of(docs).join(wanted.withColumnRenamed("id", "doc_id").hint("shuffle_hash"), "doc_id")
    kinds = dict(wanted.dtypes)
    return rows.mapInArrow(run, ", ".join(["id long, shingles array<long>", *(f"{c} {kinds[c]}" for c in more)]))


def common_counts(lists: pa.ListArray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from the shingles that several sets hold."""
    sizes = np.asarray(lists.value_lengths())
    _, column, times = np.unique(np.asarray(lists.flatten()), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    counts = np.zeros((len(sizes), len(sizes)), np.float64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        held = np.zeros((len(sizes), COLUMNS), np.float32)
        held[row[a:b], column[a:b] - start] = 1
        counts += held @ held.T
    return counts


def linked(percent: int):
    """Links of the classes in one pair of blocks of a cluster, as (class, smallest class it reaches there)."""

    def run(key, group):
        group = group.combine_chunks()
        rep, block = group["id"].to_numpy(), group["block"].to_numpy()
        lists = group["shingles"].chunk(0)
        sizes = np.asarray(lists.value_lengths()).astype(np.float64)
        common = common_counts(lists)
        close = (common > 0) & (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common))
        i, j = key[1].as_py(), key[2].as_py()
        if i != j:  # pairs within a block have their own group
            close &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(close, 1))
        order = np.argsort(rep, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = rep[order][local_roots(len(rep), place[a], place[b])][place]
        keep = root != rep
        return pa.table({"a": root[keep], "b": rep[keep]})

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    ``size`` is the number of words of a shingle; rows link at 100 * intersection >= percent * union.
    """
    signed = cut_lineage(signed_documents(docs, size, band_length(percent)))
    place = F.coalesce("doc_id", F.lit(LAST_ID))
    same = ["set_a", "set_b", "n_shingles"]
    classes = signed.where("n_shingles > 0").groupBy(*same, "bands").agg(F.min(place).alias("rep"))
    classes = cut_lineage(classes.where(F.col("rep") < LAST_ID))
    spread = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = spread.groupBy("band", "key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    stars = spread.join(buckets.select("band", "key", "first"), ["band", "key"]).where("first < rep")
    clusters = components(stars.select(F.col("first").alias("a"), F.col("rep").alias("b")))

    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = clusters.join(sizes, "component").select(
        "id", F.col("component").alias("cluster"), "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block")
    )
    sets = sets_of(docs, members, size)
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "shingles")
    links = pairs.groupBy("cluster", "i", "j").applyInArrow(linked(percent), "a long, b long")
    groups = components(links).withColumnRenamed("id", "rep")
    facts = classes.join(groups, "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", *same).join(facts, same, "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"),
    )


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with all their columns; rows without id stay."""
    gone = near_duplicates(docs, size, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
