"""Queries: given rows written in the file formats of the datasets and read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriparity.plans.registry import query, r, rounded, table
from veriparity.session import checkpoint_dir
from veriparity.sources.delimited import read_delimited, with_row_ids

_SCHEMA = {"key": "bigint", "status": "string", "price": "double", "priority": "string", "line": "int"}


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text, with a missing price written as a word and a number with a decimal part of zeros."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"),
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 == 0, "NA").otherwise(F.col("o_totalprice").cast("double").cast("string")).alias("price"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
        F.concat((F.col("o_orderkey") % 5).cast("string"), F.lit(".0")).alias("line"),
    ).withColumnRenamed("o_orderstatus", "status")


_READ_SQL = f"""SELECT o_orderkey AS key, nullif(nullif(o_orderstatus, 'P'), 'F') AS status,
    {r('CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DOUBLE END')} AS price, substr(o_orderpriority, 1, 1) AS priority,
    (o_orderkey % 5)::INT AS line FROM orders"""


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@query("read_headerless", _READ_SQL)
def read_headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two headerless files with a separator of two characters, several words for a missing value and junk lines."""
    rows, path = _orders(spark, sf_dir), _folder(spark)
    line = F.concat_ws(", ", *[F.col(c).cast("string") for c in _SCHEMA])
    for half in (0, 1):
        lines = rows.where(F.col("key") % 2 == half).select(line.alias("value"))
        junk = spark.createDataFrame([("0, junk, 0, x, 0",)], "value string")
        lines.unionAll(junk).write.text(f"{path}/{half}")
    read = read_delimited(
        spark, [f"{path}/0", f"{path}/1"], _SCHEMA, sep=", ", na_words=("P", "F", "NA"), junk={"status": "junk"}
    )
    return rounded(read)


def _with_header(spark: SparkSession, sf_dir: str, sep: str) -> DataFrame:
    """Files that have their columns in different orders, and one more than is asked for."""
    rows, path = _orders(spark, sf_dir), _folder(spark)
    for half, columns in enumerate((list(_SCHEMA), list(_SCHEMA)[::-1])):
        part = rows.where(F.col("key") % 2 == half).select(*columns, F.lit("more").alias("extra")).coalesce(4)
        part.write.option("sep", sep).option("header", True).csv(f"{path}/{half}")
    return rounded(read_delimited(spark, [f"{path}/0", f"{path}/1"], _SCHEMA, sep=sep, header=True, na_words=("P", "F", "NA")))


@query("read_semicolons", _READ_SQL)
def read_semicolons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_header(spark, sf_dir, ";")


@query("read_commas", _READ_SQL)
def read_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_header(spark, sf_dir, ",")


@query(
    "row_ids",
    "SELECT o_orderstatus AS status, count(*) AS n, count(*) AS ids, TRUE AS lasting FROM orders GROUP BY o_orderstatus",
)
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids given to rows by writing them: one each, and the same ones when they are read again."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    first = with_row_ids(rows, path)
    again = spark.read.parquet(path).select(F.col("row_id").alias("id_again"), F.col("key").alias("key_again"))
    both = first.join(again, F.col("key") == F.col("key_again"))
    return both.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"), F.bool_and(F.col("row_id") == F.col("id_again")).alias("lasting")
    )
