"""Session helpers shared by the library, the bench and the tests."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []  # paths written inside each open ``scratch``


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, choosing one only on a local master.

    A cluster names its folder in ``spark.checkpoint.dir``; that it is shared is the
    cluster's word, as a mounted folder cannot be told from a machine's own.
    Without one a run in a single process gets a temporary folder; any other is
    refused, because executors could not see a folder of the driver's machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="veriparity-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and return the written rows.

    Used where several later branches must see one and the same evaluation, or
    where evaluating again would cost more than reading.  Unlike an RDD
    checkpoint the write evaluates ``df`` once, and later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, wherever its folder is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that operators write inside the block when it ends.

    Results that are still lazy read those tables, so write or collect them inside.
    """
    written: list[str] = []
    _SCOPES.append(written)
    try:
        yield
    finally:
        _SCOPES.remove(written)
        for path in written:
            remove(spark, path)
