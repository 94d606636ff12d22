"""Large JSON objects read by many tasks.

A file is cut at every comma, which the text source does for any split of it.  What
a piece does to the scanner of JSON -- inside or outside a string, and how deep in
brackets -- is a function of the state it begins in, and functions compose: each block
of the file reports its own for both kinds of beginning, their composition in order
gives the state at the start of every block, and from there every task knows by
itself which of its commas part the entries of the outer object.  The pieces of an
entry then meet by its number, and entries are parsed one by one.

The driver sees a few numbers per block of a file, never an entry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPED = re.compile(r"\\.", re.DOTALL)


def effect(piece: str, inside: int) -> tuple[int, int]:
    """Whether the piece ends inside a string, and by how much the depth changes, if it begins inside or outside one.

    An escape never stands at the end of a piece, as no comma is escaped in JSON.
    """
    parts = (ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    plain = parts[inside::2]
    change = sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in plain)
    return (inside + len(parts) - 1) & 1, change


def pieces(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, block, piece``; the pieces of a block stand in the order of the file."""
    text = spark.read.option("lineSep", ",").text(list(paths))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece"))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in ("file", "block", "piece")), strict=True)


def block_effects(cut: DataFrame) -> DataFrame:
    """Per block: where it ends, and how the depth changes, for a beginning outside and inside a string."""

    def run(batches):
        found: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for file, block, piece in rows_of(batches):
            ends = found.setdefault((file, block), [(0, 0), (1, 0)])
            for start in (0, 1):
                inside, depth = ends[start]
                inside, change = effect(piece, inside)
                ends[start] = inside, depth + change
        rows = [(*key, *out, *inner) for key, (out, inner) in found.items()]
        names = ["file", "block", "out_end", "out_depth", "in_end", "in_depth"]
        types = [pa.string(), pa.int64(), *[pa.int64()] * 4]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return cut.mapInArrow(run, "file string, block long, out_end long, out_depth long, in_end long, in_depth long")


def block_starts(effects: Sequence[tuple]) -> dict[tuple[str, int], tuple[int, int]]:
    """State at the start of every block: the effects before it, composed; a file that does not end closed raises."""
    starts, state = {}, (0, 0)
    ordered = sorted(effects)
    for i, (file, block, *ends) in enumerate(ordered):
        if i == 0 or ordered[i - 1][0] != file:
            state = (0, 0)
        starts[file, block] = state
        inside, depth = state
        state = ends[2 * inside], depth + ends[2 * inside + 1]
        if (i + 1 == len(ordered) or ordered[i + 1][0] != file) and state != (0, 0):
            raise ValueError(f"no result document: {file}")
    return starts


def scanned(rows: Iterator[tuple[str, int, str]], starts: dict[tuple[str, int], tuple[int, int]]):
    """(file, block, number of the piece in its block, whether an entry begins with it, piece)."""
    at, state, number = None, (0, 0), 0
    for file, block, piece in rows:
        if (file, block) != at:
            at, state, number = (file, block), starts[file, block], 0
        first = state == (0, 0) and block == 0 and number == 0
        if state[1] < 1 and not first:
            raise ValueError(f"no result document: {file}")  # something follows the object
        yield file, block, number, first or state == (0, 1), piece
        inside, change = effect(piece, state[0])
        state, number = (inside, state[1] + change), number + 1


def split_entries(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, pos, entry``: the entries of the outer JSON object of each file, as text and in order."""
    cut = pieces(spark, paths)
    starts = block_starts([tuple(r) for r in block_effects(cut).collect()])  # one row per block
    if len({file for file, _ in starts}) < len(paths):
        raise ValueError("no result document: a file is empty")

    def count(batches):
        found: dict[tuple[str, int], int] = {}
        for file, block, _, begins, _ in scanned(rows_of(batches), starts):
            found[file, block] = found.get((file, block), 0) + begins
        rows = list(zip(*((*key, n) for key, n in found.items()), strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "block", "n"]
        )

    before: dict[tuple[str, int], int] = {}
    total: dict[str, int] = {}
    for file, block, n in sorted(tuple(r) for r in cut.mapInArrow(count, "file string, block long, n long").collect()):
        before[file, block] = total.get(file, 0)
        total[file] = before[file, block] + n

    def numbered(batches):
        at, pos, out = None, -1, []
        for file, block, nth, begins, piece in scanned(rows_of(batches), starts):
            if (file, block) != at:
                at, pos = (file, block), before[file, block] - 1
            pos += begins
            out.append((file, pos, block, nth, piece))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    parts = cut.mapInArrow(numbered, "file string, pos long, block long, nth long, piece string")
    # an entry holds the metrics of one experiment
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "nth", "piece"))), lambda x: x["piece"]), ",")
    entries = parts.groupBy("file", "pos").agg(joined.alias("entry"))
    last = F.element_at(F.create_map(*[F.lit(x) for f, n in total.items() for x in (f, n - 1)]), F.col("file")) if total else F.lit(None).cast("long")
    opened = F.when(F.col("pos") == 0, F.regexp_replace("entry", r"^\s*\{", "")).otherwise(F.col("entry"))
    closed = F.when(F.col("pos") == last, F.regexp_replace(opened, r"\}\s*$", "")).otherwise(opened)
    return entries.select("file", "pos", F.trim(closed).alias("entry"))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "pos", "block", "nth", "piece"])
