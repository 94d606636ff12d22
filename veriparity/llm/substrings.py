"""Substring dedup by prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document.  Every word covered by a
window that also starts in an earlier document (smaller doc_id) is removed.

1. Spans.  All windows of a document that share one smallest ``SEED``-word gram and
   lie side by side form a span, about one per 22 words.  Equal windows have equal
   smallest grams, so only spans with a gram that occurs in several documents can
   hold a repeat; the others end here.
2. Equal spans are one path of the tree: all their windows repeat if a span
   starts in an earlier document.  Only the first of equal spans goes on, and only
   where spans differ although they share their gram, which is around the ends of
   repeats.
3. Suffix trees.  For the windows of those spans, the suffixes that start there
   are grouped by a prefix.  The more different spans share the gram of a suffix,
   the longer its prefix is (``PREFIXES`` words), which keeps the groups small.  A
   group's suffixes are sorted by their path, which is the order of a walk through
   its subtree: the leaves of a node of ``window`` words follow each other, the one
   of the first document ahead, and all later ones repeat.
4. Where more than ``CROWD`` different spans share a gram, suffixes that no prefix
   can tell apart may be many.  There the first document of each node is found by
   sums over the tasks, and joined back.
5. Repeated windows return to their documents, where overlapping ones merge into
   maximal repeated passages.

Words and paths are compared by 64-bit codes, spans by those of gram and words,
windows by those of prefix and words.

Cases: a null, empty or short text has no windows; rows without doc_id count as
later than all others and not as earlier than each other, as do rows with equal
doc_id; an empty table gives an empty table; ``without_repeats``
ignores other columns, ``strip_repeats`` carries them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriparity.llm.common import (
    LAST_ID, Memo, as_bytes, coded, gram_codes, prefix_hashes, range_hashes, signed, slices, sliding_min, word_codes,
)
from veriparity.session import cut_lineage

WINDOW = 50
SEED = 8
PREFIXES = (8, 16, 32)
DEEPER = (64, 512)  # different spans of a gram beyond which the next prefix is taken
CROWD = 4096
WORD = re.compile(rb"[^ \t-\r]+[ \t-\r]*")


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """``place`` (the order of documents), ``mark`` (of the text; tells rows of equal id apart) and ``text``."""
    text = F.coalesce("text", F.lit(""))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    return docs.select(place.alias("place"), F.hash(text).alias("mark"), text.alias("text"), *more)


class Words:
    """Word codes of a slice of documents, with their prefix hashes."""

    def __init__(self, texts: list[bytes], codes: Memo):
        self.codes, self.counts = coded(texts, codes)
        self.first = np.cumsum(self.counts) - self.counts
        self.hashes = prefix_hashes(self.codes)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return range_hashes(self.hashes, start, end)


SPAN = "place long, mark int, start int, n int, seed long, a long"


def spans_of(rows: DataFrame, window: int) -> DataFrame:
    """Runs of windows by their smallest gram: start, number of windows, the gram and a digest of all their words."""

    def run(batches):
        codes = word_codes()
        for part in slices(batches):
            w = Words(as_bytes(part["text"]), codes)
            windows = np.maximum(w.counts - window + 1, 0)
            if not windows.any():
                continue
            smallest = sliding_min(gram_codes(w.codes, SEED, 1), window - SEED + 1)
            doc = np.repeat(np.arange(len(windows)), windows)
            start = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
            seed = smallest[w.first[doc] + start]
            new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | np.append(True, seed[1:] != seed[:-1]))
            n = np.diff(np.append(new, len(doc)))
            at = w.first[doc[new]] + start[new]
            a = w.ranges(at, at + n + window - 1)
            take = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays(
                [part["place"].take(take), part["mark"].take(take), pa.array(start[new].astype(np.int32)),
                 pa.array(n.astype(np.int32)), signed(seed[new]), signed(a)],
                names=["place", "mark", "start", "n", "seed", "a"],
            )

    return rows.select("place", "mark", "text").mapInArrow(run, SPAN)


SUFFIX = "place long, mark int, start int, p long, a long"


def suffixes_of(rows: DataFrame, window: int) -> DataFrame:
    """The windows of the ``spans`` of each row, as suffixes: codes of their prefix and of the whole window."""

    def run(batches):
        codes = word_codes()
        lengths = np.array(PREFIXES)
        for part in slices(batches):
            w = Words(as_bytes(part["text"]), codes)
            lists = part["spans"]
            owner = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
            flat = lists.flatten()
            start, n, depth = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
            owner = np.repeat(owner, n)
            start = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
            if not len(owner):
                continue
            at = w.first[owner] + start
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [part["place"].take(take), part["mark"].take(take), pa.array(start.astype(np.int32)),
                 signed(w.ranges(at, at + lengths[np.repeat(depth, n)])), signed(w.ranges(at, at + window))],
                names=["place", "mark", "start", "p", "a"],
            )

    return rows.select("place", "mark", "text", "spans").mapInArrow(run, SUFFIX)


def repeated_leaves(leaves):
    """Walks sorted suffixes, one subtree after the other: those of a node's later documents."""
    held = None  # the node that is open, and its first document
    for batch in leaves:
        if not batch.num_rows:
            continue
        p, a, place = (batch[c].to_numpy() for c in ("p", "a", "place"))
        new = np.append(True, (p[1:] != p[:-1]) | (a[1:] != a[:-1]))
        first = place[new]
        if held is not None and held[:2] == (p[0], a[0]):
            first[0] = held[2]
        node = np.cumsum(new) - 1
        held = p[-1], a[-1], first[-1]
        yield batch.filter(pa.array(place > first[node])).select(["place", "mark", "start"])


def in_trees(suffixes: DataFrame) -> DataFrame:
    walked = suffixes.repartition("p").sortWithinPartitions("p", "a", "place")
    return walked.mapInArrow(repeated_leaves, "place long, mark int, start int")


def in_crowds(suffixes: DataFrame) -> DataFrame:
    """The same for nodes of any number of leaves: their first document by sums, joined back."""
    nodes = suffixes.groupBy("p", "a").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    nodes = nodes.where("first < last").select("p", "a", "first")
    return suffixes.join(nodes, ["p", "a"]).where("place > first").select("place", "mark", "start")


def listed_spans(spans: DataFrame, *fields: str) -> DataFrame:
    """One row per document with the array of its spans; a document's spans are fewer than its words."""
    return spans.groupBy("place", "mark").agg(F.collect_list(F.struct("start", "n", *fields)).alias("spans"))


def repeats_of(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Repeated runs of windows of each document: place, mark, start and n (the passage is n + window - 1 words).

    ``rows`` come from ``keyed``.  What reads their texts again is left to the caller's plan, where the
    exchange that deals out the texts by document is made once.
    """
    if window < max(PREFIXES):
        raise ValueError(f"a window has at least {max(PREFIXES)} words")
    spans = cut_lineage(spans_of(rows, window))
    shared = spans.groupBy("seed").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low < high")
    live = cut_lineage(spans.join(shared.select("seed"), "seed"))
    paths = live.groupBy("seed", "a").agg(F.min("place").alias("first"))
    sizes = paths.groupBy("seed").agg(F.count(F.lit(1)).alias("paths"))
    depth = sum(((F.col("paths") > d).cast("int") for d in DEEPER), F.lit(0)).alias("depth")
    live = live.join(paths, ["seed", "a"]).join(sizes, "seed")
    live = cut_lineage(live.select("place", "mark", "start", "n", "first", "paths", depth))
    found = live.where("place > first").select("place", "mark", "start", "n")
    ends = live.where("place = first AND paths > 1")
    for chosen, search in ((f"paths <= {CROWD}", in_trees), (f"paths > {CROWD}", in_crowds)):
        some = ends.where(chosen)
        if not some.isEmpty():
            lists = listed_spans(some, "depth").hint("shuffle_hash")
            more = search(suffixes_of(rows.join(lists, ["place", "mark"]), window))
            found = found.unionByName(more.withColumn("n", F.lit(1)))
    return found


def covered(counts: np.ndarray, first: np.ndarray, lists: pa.Array, window: int) -> np.ndarray:
    """Which words of a slice lie in the spans of their document."""
    change = np.zeros(int(counts.sum()) + 1, np.int64)
    lengths = np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0))).astype(np.int64)
    flat = lists.flatten()
    start, n = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
    at = np.repeat(first, lengths) + start
    np.add.at(change, at, 1)
    np.add.at(change, at + n + window - 1, -1)
    return np.cumsum(change)[:-1] > 0


def with_spans(rows: DataFrame, window: int) -> DataFrame:
    return rows.join(listed_spans(repeats_of(rows, window)).hint("shuffle_hash"), ["place", "mark"], "left")


def cleaned(part: pa.RecordBatch, window: int, pattern: re.Pattern | None = None):
    """Number of words, of removed ones, and what is kept of each text of a slice."""
    texts = as_bytes(part["text"])
    words = [pattern.findall(t) if pattern else t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(counts) - counts
    gone = covered(counts, first, part["spans"], window)
    totals = np.append(0, np.cumsum(gone))
    removed = totals[first + counts] - totals[first]
    kept = []
    for w, at, n in zip(words, first.tolist(), removed.tolist(), strict=True):
        kept.append([x for x, g in zip(w, gone[at : at + len(w)].tolist(), strict=True) if not g] if n else w)
    return texts, counts, removed, kept


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the other words, joined by spaces) of every row."""

    def run(batches):
        for part in slices(batches):
            _, counts, removed, kept = cleaned(part, window)
            texts = pa.array([b" ".join(w) for w in kept], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [part["place"], pa.array(counts), pa.array(removed), texts], names=["doc_id", "n_words", "n_removed", "kept"]
            )

    rows = with_spans(keyed(docs), window).select("place", "mark", "text", "spans")
    cleaned_rows = rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
    return cleaned_rows.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID)))


def strip_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated words, and the space behind them, taken out of ``text``; other columns are unchanged."""

    def run(batches):
        for part in slices(batches):
            texts, _, removed, kept = cleaned(part, window, WORD)
            new = [t if not n else b"".join(w).strip() for t, n, w in zip(texts, removed.tolist(), kept, strict=True)]
            row = part["row"]
            i = row.type.get_field_index("text")
            text = pa.array(new, pa.binary()).cast(row.type.field(i).type)
            text = pa.compute.if_else(row.field(i).is_null(), pa.scalar(None, text.type), text)
            yield pa.RecordBatch.from_arrays(
                [text if k == i else row.field(k) for k in range(row.type.num_fields)],
                names=[row.type.field(k).name for k in range(row.type.num_fields)],
            )

    rows = with_spans(keyed(docs, F.struct(*[F.col(c) for c in docs.columns]).alias("row")), window)
    return rows.select("row", "text", "spans").mapInArrow(run, docs.schema)
