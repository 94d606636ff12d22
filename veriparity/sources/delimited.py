"""Delimited text into typed rows, with missing-value words and row ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriparity.functions.values import DEFAULT_NA_WORDS, col, null_if_nan, null_if_token, strict_number

NUMBERS = ("int", "bigint", "double")


def normalise(df: DataFrame, tokens: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """NULL for every listed word in the text columns (default: all of them)."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    chosen = text if columns is None else text & set(columns)
    return df.select(*[
        null_if_token(col(c), tokens).alias(c) if c in chosen else col(c) for c in df.columns
    ])


DAMAGED = "_damaged_line"


def _reader(spark: SparkSession, sep: str, header: bool) -> DataFrameReader:
    return spark.read.option("sep", sep).option("ignoreLeadingWhiteSpace", False).option("header", header)


def _by_header(spark: SparkSession, paths: Sequence[str], sep: str) -> dict[tuple[str, ...], list[str]]:
    """The files below ``paths`` by the names in their headers; the first line of each file is read for it."""
    files = _reader(spark, sep, True).csv(list(paths)).inputFiles()
    found: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(files):
        found.setdefault(tuple(_reader(spark, sep, True).csv(file).columns), []).append(file)
    return found


def _text_rows(
    spark: SparkSession,
    paths: Sequence[str],
    found: Sequence[str],
    names: Sequence[str],
    sep: str,
    header: bool,
    junk: Mapping[str, str],
) -> DataFrame:
    """The named columns of files that hold the found ones, as text.

    Lines with too few or too many values raise, junk lines are left out.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*found, DAMAGED)])
    reader = _reader(spark, sep, header).schema(schema)
    text = reader.option("columnNameOfCorruptRecord", DAMAGED).option("columnPruning", False).csv(list(paths))
    for name, value in junk.items():
        text = text.where(~col(name).eqNullSafe(F.lit(value)))
    what = F.concat_ws(" ", F.lit("damaged line:"), DAMAGED, col(found[0]))
    sound = F.when(F.col(DAMAGED).isNull(), F.lit(True)).otherwise(F.raise_error(what).cast("boolean"))
    return text.where(sound).select(*[col(c) for c in names])


def _whole_number(text: Column, kind: str) -> Column:
    """Text to a whole number, digit by digit; it may have a decimal part of zeros, as in 3.0, and nothing else."""
    exact = text.try_cast("decimal(38,9)")
    whole = exact.cast("decimal(29,0)")
    bad = text.isNotNull() & (exact.isNull() | (exact != whole) | whole.try_cast(kind).isNull())
    message = F.concat(F.lit("not a number: "), text, F.lit(f" (as {kind})"))
    return F.when(bad, F.raise_error(message).cast(kind)).otherwise(whole.try_cast(kind))


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: Mapping[str, str],
    sep: str = ",",
    header: bool = False,
    na_words: Sequence[str] = (),
    junk: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read delimited files with given names and types (``string, int, bigint, double``).

    Everything is read as text first: several missing-value words can then be
    recognised, rows whose ``junk`` column holds the junk text are left out, and
    a value that is no number of its type raises instead of turning into a missing
    or a rounded one.  Files with a header may have their columns in any order and
    others besides, as each file is read by its own header.  Lines with too few or
    too many values raise.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    groups = _by_header(spark, paths, sep) if header else {tuple(schema): paths}
    parts = [_text_rows(spark, files, found, list(schema), sep, header, junk or {}) for found, files in groups.items()]
    text = reduce(DataFrame.unionByName, parts)
    words = (*DEFAULT_NA_WORDS, *na_words)

    def typed(name: str, kind: str) -> Column:
        value = null_if_token(col(name), words)
        if kind not in NUMBERS:
            return value.alias(name)
        trimmed = null_if_token(F.trim(value), words)
        return (null_if_nan(strict_number(trimmed)) if kind == "double" else _whole_number(trimmed, kind)).alias(name)

    return text.select(*[typed(name, kind) for name, kind in schema.items()])


def with_row_ids(df: DataFrame, table_path: str, id_col: str = "row_id") -> DataFrame:
    """Give file rows an id once and for all, by writing them to ``table_path``.

    An id computed on the fly could differ from one evaluation to the next; a
    written one cannot.
    """
    df.select(F.monotonically_increasing_id().alias(id_col), "*").write.mode("errorifexists").parquet(table_path)
    return df.sparkSession.read.parquet(table_path)
