"""Feature encoding: mean-imputed, standardised numbers and one-hot categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    ElementwiseProduct,
    Imputer,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriparity.functions.values import col, ratio
from veriparity.operators.detectors import number
from veriparity.session import cut_lineage

MISSING_CATEGORY = "(missing)"
MAX_CATEGORIES = 100_000  # what an encoder's vocabulary may take of the driver and of every task


def category(name: str) -> Column:
    """Category as text; a missing one is a category of its own."""
    return F.coalesce(col(name).cast("string"), F.lit(MISSING_CATEGORY))


def encoded_cells(
    df: DataFrame, id_col: str, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """``id, cells``: the encoded features of a row by name, zeros left out for categories.

    Numbers are standardised by the population deviation of the imputed column,
    which counts imputed rows as lying on the mean; a constant column becomes 0.
    No vocabulary is made, so a column may have as many categories as rows.
    """
    stats = []
    for i, c in enumerate(numeric):
        spread = F.stddev_pop(number(c)) * F.sqrt(ratio(F.count(number(c)), F.count(F.lit(1))))
        stats += [F.avg(number(c)).alias(f"mean{i}"), spread.alias(f"sd{i}")]
    ready = df
    if stats:
        ready = df.select("*", df.agg(*stats).select(F.struct("*").alias("s")).scalar().alias("_stats"))
    cells = []
    for i, c in enumerate(numeric):
        mean, sd = F.col(f"_stats.mean{i}"), F.col(f"_stats.sd{i}")
        scaled = F.coalesce(ratio(F.coalesce(number(c), mean) - mean, sd), F.lit(0.0))
        cells.append(F.struct(F.lit(c).alias("feature"), scaled.alias("value")))
    for c in categorical:
        name = F.concat(F.lit(f"{c}="), category(c))
        cells.append(F.struct(name.alias("feature"), F.lit(1.0).alias("value")))
    return ready.select(col(id_col).alias("id"), F.array(*cells).alias("cells"))


def encode_rows(df: DataFrame, id_col: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Encoded features in long form: ``id, feature, value``."""
    return encoded_cells(df, id_col, numeric, categorical).select("id", F.inline("cells"))


def feature_input(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    keep: dict[str, Column],
    max_categories: int = MAX_CATEGORIES,
) -> DataFrame:
    """The columns an encoder reads (``num*``, ``cat*``) next to ``keep``.

    They are written once, as fitting and using an encoder passes over them many
    times.  The vocabularies end up on the driver and in every task, so their
    size is counted first; columns with more than ``max_categories`` values raise.
    """
    out = df.select(
        *[value.alias(name) for name, value in keep.items()],
        *[number(c).alias(f"num{i}") for i, c in enumerate(numeric)],
        *[category(c).alias(f"cat{i}") for i, c in enumerate(categorical)],
    )
    out = cut_lineage(out)
    if categorical:
        cells = out.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("i"), F.col(f"cat{i}").alias("value")) for i in range(len(categorical))
        ])))
        counted = cells.distinct().groupBy("i").count().collect()  # one row per column
        large = {categorical[r["i"]]: r["count"] for r in counted if r["count"] > max_categories}
        if large:
            raise ValueError(f"too many categories to one-hot encode: {large}")
    return out


def _population(name: str, out: str, width: int, rows: int) -> ElementwiseProduct:
    """From the sample deviation that the scaler divides by to the population's."""
    factor = (rows / (rows - 1)) ** 0.5 if rows > 1 else 1.0
    return ElementwiseProduct(inputCol=name, outputCol=out, scalingVec=Vectors.dense([factor] * width))


def encoder(
    numeric: Sequence[str], categorical: Sequence[str], rows: int, scale_categories: bool = False
) -> Pipeline:
    """MLlib pipeline from ``feature_input`` to a vector column ``features``, to be fitted on ``rows`` rows.

    Numbers are standardised by the population deviation.  A category unseen in
    training becomes a zero block.  ``scale_categories`` divides the one-hot block
    by its deviations as well; it is not centred, so it stays sparse, and distances
    are the same.
    """
    stages: list = []
    blocks: list[str] = []
    if numeric:
        raw, filled = [f"num{i}" for i in range(len(numeric))], [f"filled{i}" for i in range(len(numeric))]
        stages += [
            Imputer(strategy="mean", inputCols=raw, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="numbers"),
            StandardScaler(withMean=True, withStd=True, inputCol="numbers", outputCol="sampled"),
            _population("sampled", "scaled", len(numeric), rows),
        ]
        blocks.append("scaled")
    if categorical:
        raw = [f"cat{i}" for i in range(len(categorical))]
        stages += [
            StringIndexer(inputCols=raw, outputCols=[f"{c}_index" for c in raw], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_index" for c in raw], outputCols=[f"{c}_hot" for c in raw], dropLast=True),
        ]
        hot = [f"{c}_hot" for c in raw]
        if scale_categories:
            stages += [
                VectorAssembler(inputCols=hot, outputCol="hot"),
                StandardScaler(withMean=False, withStd=True, inputCol="hot", outputCol="hot_scaled"),
            ]
            hot = ["hot_scaled"]
        blocks += hot
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=blocks, outputCol="features")])
