"""Experiment result documents and the impact table file."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriparity.functions.values import null_if_nan
from veriparity.sources.split_json import split_entries

# Result file stem per dataset.
RESULT_FILES = {
    "credit": "Credit_result.json",
    "adult": "USCensus_result.json",
    "folktables": "ACSIncome_result.json",
    "heart": "Cardio_result.json",
    "german": "GermanCredit_result.json",
}

IMPACT_SCHEMA = (
    "dataset string, criteria string, metric string, model string, error string, detection string, "
    "repair string, test_repaired boolean, fairness_impact string, accuracy_impact string"
)

TEXT_METRICS = "map<string,string>"


def numeric_metrics(text: Column) -> Column:
    """Map of texts to a map of numbers; what is no number (or NaN) becomes NULL."""
    return F.transform_values(text, lambda _, v: null_if_nan(v.try_cast("double")))


def parse_documents(documents: DataFrame) -> DataFrame:
    """Rows ``dataset, value`` with one JSON object each into one row per experiment, in key order.

    A value that is no such object raises.
    """
    parsed = F.from_json("value", f"map<string,{TEXT_METRICS}>", {"mode": "FAILFAST"})
    damaged = F.raise_error(F.concat(F.lit("no result document: "), F.coalesce("dataset", F.lit("?"))))
    parsed = F.coalesce(parsed, damaged.cast(f"map<string,{TEXT_METRICS}>"))
    entries = documents.select("dataset", F.posexplode(F.map_entries(parsed)).alias("pos", "entry"))
    return entries.select(
        "dataset",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("entry.key").alias("experiment"),
        numeric_metrics(F.col("entry.value")).alias("metrics"),
    )


def parse_entries(entries: DataFrame) -> DataFrame:
    """Rows ``dataset, pos, entry`` with one ``"experiment": {metrics}`` each; anything else raises."""
    kind = f"map<string,{TEXT_METRICS}>"
    parsed = F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), kind, {"mode": "FAILFAST"})
    damaged = F.raise_error(F.concat(F.lit("no result document: "), F.coalesce("dataset", F.lit("?"))))
    whole = F.when(F.size(parsed) == 1, parsed).otherwise(damaged.cast(kind))
    rows = entries.where("entry <> ''").select("dataset", "pos", F.explode(whole).alias("experiment", "found"))
    return rows.select("dataset", "pos", "experiment", numeric_metrics(F.col("found")).alias("metrics"))


def read_documents(spark: SparkSession, folder: str, files: Mapping[str, str] = RESULT_FILES) -> DataFrame:
    """Read result documents, one JSON object per dataset file, of any size: tasks read parts of a file.

    ``files`` names the file of each dataset wanted; one that is absent raises, as
    does a JSON file in the folder that belongs to no dataset in ``files``.
    """
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", name.alias("name"))
    paths = {r["name"]: r["path"] for r in found.collect()}  # no more than the folder's files
    if set(paths) != set(files.values()):
        raise ValueError(
            f"result files absent: {sorted(set(files.values()) - set(paths))}, unknown: {sorted(set(paths) - set(files.values()))}"
        )
    entries = split_entries(spark, sorted(paths.values()))
    which = F.lit(None).cast("string")
    for dataset, file in files.items():
        which = F.when(F.element_at(F.split(F.col("file"), "/"), -1) == file, dataset).otherwise(which)
    return parse_entries(entries.select(which.alias("dataset"), "pos", "entry"))


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Read experiments as JSON lines with ``dataset, pos, experiment, metrics``.

    The files split at line ends, so any number of tasks can read them.  A line
    that is no such object raises.
    """
    schema = f"dataset string, pos bigint, experiment string, metrics {TEXT_METRICS}"
    lines = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    return lines.withColumn("metrics", numeric_metrics(F.col("metrics")))


def write_lines(experiments: DataFrame, path: str) -> None:
    experiments.select("dataset", "pos", "experiment", "metrics").write.json(path)


def metric_rows(experiments: DataFrame) -> DataFrame:
    """One row per experiment and metric."""
    kept = [c for c in experiments.columns if c != "metrics"]
    return experiments.select(*kept, F.explode("metrics").alias("metric_name", "value"))


def write_impact(impact: DataFrame, path: str, form: str = "csv") -> None:
    """Write the impact table, as CSV with a header or as Parquet partitioned by dataset and error."""
    if form == "csv":
        impact.write.option("header", True).option("emptyValue", "").csv(path)
    elif form == "parquet":
        impact.write.partitionBy("dataset", "error").parquet(path)
    else:
        raise ValueError(f"Unsupported: {form}")


def read_impact(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """Read an impact table; an empty detection stays an empty text."""
    if form == "parquet":
        return spark.read.schema(IMPACT_SCHEMA).parquet(path)
    if form != "csv":
        raise ValueError(f"Unsupported: {form}")
    rows = spark.read.schema(IMPACT_SCHEMA).option("header", True).csv(path)
    return rows.withColumn("detection", F.coalesce("detection", F.lit("")))


def register_impact(spark: SparkSession, path: str, form: str = "csv", view: str = "impact") -> DataFrame:
    """Read an impact table and name it, so that ``spark.sql`` statements can query it."""
    impact = read_impact(spark, path, form)
    impact.createOrReplaceTempView(view)
    return impact
