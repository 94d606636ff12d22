"""Missing-value handling and safe arithmetic."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words a delimited reader treats as "no value" unless told otherwise.
DEFAULT_NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def col(name: str) -> Column:
    """Column by exact name; names such as ``hours-per-week`` need the quoting."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_if_token(value: Column, tokens: Iterable[str]) -> Column:
    """NULL where a text value is one of ``tokens``."""
    return F.when(value.isin(list(tokens)), F.lit(None)).otherwise(value)


def null_if_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column.

    Spark orders NaN above all numbers, so a NaN left in place would count as an
    outlier and as a member of every ``>`` group.
    """
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        null_if_nan(col(name)).alias(name) if name in floating else col(name) for name in df.columns
    ])


def strict_number(text: Column, kind: str = "double") -> Column:
    """Text to number; a value that is no number raises whatever the ANSI setting."""
    number = text.try_cast(kind)
    bad = text.isNotNull() & number.isNull()
    message = F.concat(F.lit("not a number: "), text)
    return F.when(bad, F.raise_error(message).cast(kind)).otherwise(number)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as DOUBLE; NULL on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(ratio(part * F.lit(100), whole), digits)


def percent_text(part: Column, whole: Column) -> Column:
    """``12.3% (45)`` as one report cell."""
    return F.format_string("%.1f%% (%d)", percent(part, whole), part.cast("bigint"))
