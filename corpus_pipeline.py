"""A training-data pipeline over ``documents``: judge, drop copies, drop passages, mask secrets, pack.

Each stage reads what the stage before has written.  All but the last return the
columns of ``documents``; the last returns the place of every piece of every
document in the packed sequences.  Further columns of ``documents`` are carried up to
there, whatever they are called; an empty table goes through as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriparity.llm.common import table
from veriparity.llm.minhash import keep_first
from veriparity.llm.packing import pack_documents
from veriparity.llm.quality import keep_good
from veriparity.llm.secret_scan import redact_secrets
from veriparity.llm.substrings import strip_repeats
from veriparity.session import checkpoint_dir, remove, scratch


def recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    The decision belongs to a doc_id: rows that share one stay or go together, and rows without one stay.  Null and
    empty texts have the mean score of their language; without trusted rows, or labels, all documents stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    First is the smallest doc_id; rows that share it stay together, as do all rows of a group without any doc_id.
    Null texts, and texts without words, are near nothing and stay.
    """
    return keep_first(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that an earlier document has.

    Earlier is a smaller doc_id; rows of equal doc_id are not earlier than each other, and rows without one are later
    than all others.  Texts without such passages are unchanged, null ones stay null.
    """
    return recounted(strip_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; null texts stay null, repeated rows are masked alike."""
    return recounted(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens.

    A null or empty text is the end id alone; repeated rows are packed each.
    """
    return pack_documents(docs, keep_ids=False)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scan", secrets),
    ("packing", packing),
]

ORACLE_SQL = None  # SQL can express neither the tokenizer nor the model's decisions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``.

    What a stage has read, and the tables that it wrote on its way, are deleted when its own rows are written.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(rows.schema).parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
