"""Line dedup: lines that stand in several documents go, but for those of one document.

1. Lines are exploded with their position; a line's key is the line without white
   space at either end and with A-Z in lower case, of which only 128 bits of hash
   move on.
2. Documents are counted per key, first per key and document and then per key, so a
   line that a third of all documents hold is summed where it is read.
3. Lines of a key in at least ``least_documents`` documents are dropped everywhere
   but in the last document (largest doc_id) that holds it.
4. The positions to drop meet their documents again, whose lines are reassembled
   by position.  Only this step moves texts, once.

Cases: a null or empty text is one empty line; lines shorter than ``least_chars`` are
never dropped; rows of equal doc_id, repeated rows among them, are one document, and so
are all rows without doc_id, which count as the last one; a text of any length is
exploded, never held as pairs; an empty table gives an empty table; ``line_dedup``
ignores other columns, ``strip_lines`` carries them, a null text as null.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriparity.llm.common import LAST_ID
from veriparity.session import cut_lineage

BLANKS = " \t\n\v\f\r"
LEAST_DOCUMENTS = 3
LEAST_CHARS = 20
HOT_SHARE = 1000


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z (and no other letters) in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lined(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc`` (its place in the order of documents), ``mark`` (of the text; tells rows of a document apart), ``lines``."""
    text = F.coalesce("text", F.lit(""))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    return docs.select(place.alias("doc"), F.xxhash64(text).alias("mark"), F.split(text, "\n", -1).alias("lines"), *more)


def keyed_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """Document, position and key of every line that is long enough."""
    lines = rows.select("doc", "mark", F.posexplode("lines").alias("pos", "line"))
    keys = lines.select("doc", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keys.select("doc", "mark", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def dropped_lines(keys: DataFrame, least_documents: int) -> DataFrame:
    """Positions to drop, one row per document and text.

    Keys of more than one in ``HOT_SHARE`` lines, of which there are fewer than ``HOT_SHARE``, meet their lines where
    these are read; only the lines of the other keys move.
    """
    per_document = keys.groupBy("k1", "k2", "doc").agg(F.count(F.lit(1)).alias("lines"))
    common = per_document.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"), F.sum("lines").alias("lines")
    )
    common = cut_lineage(common.where(F.col("n") >= least_documents).select("k1", "k2", "last", "lines"))
    hot = F.col("lines") > keys.count() / HOT_SHARE
    place = ["doc", "mark", "pos"]
    here = keys.join(F.broadcast(common.where(hot).select("k1", "k2", F.col("last").alias("hot_last"))), ["k1", "k2"], "left")
    moved = here.where("hot_last IS NULL").join(common.where(~hot), ["k1", "k2"]).where("doc <> last").select(place)
    gone = here.where("doc <> hot_last").select(place).unionAll(moved)
    return gone.groupBy("doc", "mark").agg(F.collect_set("pos").alias("gone"))


def with_kept(docs: DataFrame, least_documents: int, least_chars: int, *more: Column) -> DataFrame:
    """``doc``, ``n_lines``, ``n_dropped``, ``kept`` and the columns asked for."""
    keys = cut_lineage(keyed_lines(lined(docs), least_chars))
    gone = dropped_lines(keys, least_documents).hint("shuffle_hash")
    rows = lined(docs, *more).join(gone, ["doc", "mark"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    return rows.select(
        "doc",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
        *[F.col(c) for c in rows.columns if c not in ("doc", "mark", "lines", "gone")],
    )


def line_dedup(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``kept`` (the text of the other lines) of every row."""
    rows = with_kept(docs, least_documents, least_chars)
    return rows.select(F.nullif("doc", F.lit(LAST_ID)).alias("doc_id"), "n_lines", "n_dropped", "kept")


def strip_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; other columns are unchanged."""
    rows = with_kept(docs, least_documents, least_chars, F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    return rows.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
