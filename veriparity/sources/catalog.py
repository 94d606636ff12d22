"""The five audited datasets: file format, types, roles and group criteria."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from veriparity.functions.values import col, nan_to_null
from veriparity.operators.detectors import IQR, MISSING, SD
from veriparity.sources.delimited import read_delimited, with_row_ids
from veriparity.spec import Above, AuditSpec, Equals, LabelAtLeast, LabelIn, LabelNot


@dataclass(frozen=True)
class Dataset:
    """How to read a dataset and which role its columns play."""

    spec: AuditSpec
    schema: Mapping[str, str]
    sep: str = ","
    header: bool = True
    na_words: Sequence[str] = ()
    junk: Mapping[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
        """Rows of the dataset's own file format, without an id."""
        return read_delimited(spark, paths, self.schema, self.sep, self.header, self.na_words, self.junk)

    def read_staged(self, spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
        """Rows of a Parquet extract, projected to the dataset's columns; an extract that lacks one raises.

        The id column is taken along if the extract has it.
        """
        staged = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
        absent = [c for c in self.schema if c not in staged.columns]
        if absent:
            raise ValueError(f"the extract lacks columns of {self.spec.name}: {', '.join(absent)}")
        ids = [c for c in (self.spec.id_col,) if c in staged.columns and c not in self.schema]
        return nan_to_null(staged.select(*[col(c) for c in (*ids, *self.schema)]))


def _columns(kind: str, *names: str) -> dict[str, str]:
    return dict.fromkeys(names, kind)


# Column names, missing-value words, label rules and group criteria of the datasets.

ADULT = Dataset(
    schema={
        "age": "int", "workclass": "string", "fnlwgt": "int", "education": "string", "education-num": "int",
        "marital-status": "string", "occupation": "string", "relationship": "string", "race": "string",
        "sex": "string", "capital-gain": "int", "capital-loss": "int", "hours-per-week": "int",
        "native-country": "string", "income-level": "string",
    },
    sep=", ",
    header=False,
    na_words=("?",),
    junk={"age": "|1x3 Cross validator"},
    spec=AuditSpec(
        name="adult",
        label=LabelIn("income-level", (">50K", ">50K.")),
        groups={
            "race": Equals("race", "White"),
            "sex": Equals("sex", "Male"),
            "age": Above("age", 30),
            "country": Equals("native-country", "United-States"),
        },
        numeric=("age", "hours-per-week", "capital-gain", "capital-loss"),
        categorical=(
            "workclass", "education", "marital-status", "occupation", "relationship", "race", "sex",
            "native-country",
        ),
        not_for_prediction=("age", "race", "sex"),
        listed_criteria=("age", "race", "sex"),
    ),
)

FOLKTABLES = Dataset(
    schema=_columns(
        "double", "AGEP", "COW", "SCHL", "MAR", "OCCP", "POBP", "RELP", "WKHP", "SEX", "RAC1P", "PINCP"
    ),
    spec=AuditSpec(
        name="folktables",
        label=LabelAtLeast("PINCP", 50000),
        groups={"race": Equals("RAC1P", 1), "sex": Equals("SEX", 1), "age": Above("AGEP", 30)},
        numeric=("AGEP", "WKHP"),
        categorical=("COW", "SCHL", "MAR", "OCCP", "POBP", "RELP", "SEX", "RAC1P"),
        not_for_prediction=("AGEP", "SEX", "RAC1P"),
        listed_criteria=("race", "sex", "age"),
    ),
)

HEART = Dataset(
    schema={
        "age": "int", "gender": "int", "height": "int", "weight": "double", "ap_hi": "int", "ap_lo": "int",
        "cholesterol": "int", "gluc": "int", "smoke": "int", "alco": "int", "active": "int", "cardio": "int",
    },
    sep=";",
    spec=AuditSpec(
        name="heart",
        label=LabelIn("cardio", (1,)),
        groups={"sex": Equals("gender", 1)},
        numeric=("age", "height", "weight", "ap_hi", "ap_lo", "cholesterol", "gluc"),
        categorical=("gender", "smoke", "alco", "active"),
        not_for_prediction=("age", "gender"),
        listed_criteria=("sex",),
    ),
)

CREDIT = Dataset(
    schema={
        "SeriousDlqin2yrs": "int", "RevolvingUtilizationOfUnsecuredLines": "double", "age": "int",
        "NumberOfTime30-59DaysPastDueNotWorse": "int", "DebtRatio": "double", "MonthlyIncome": "double",
        "NumberOfOpenCreditLinesAndLoans": "int", "NumberOfTimes90DaysLate": "int",
        "NumberRealEstateLoansOrLines": "int", "NumberOfTime60-89DaysPastDueNotWorse": "int",
        "NumberOfDependents": "int",
    },
    spec=AuditSpec(
        name="credit",
        label=LabelNot("SeriousDlqin2yrs", 1),
        groups={"age": Above("age", 30)},
        numeric=(
            "RevolvingUtilizationOfUnsecuredLines", "age", "NumberOfTime30-59DaysPastDueNotWorse", "DebtRatio",
            "MonthlyIncome", "NumberOfOpenCreditLinesAndLoans", "NumberOfTimes90DaysLate",
            "NumberRealEstateLoansOrLines", "NumberOfTime60-89DaysPastDueNotWorse", "NumberOfDependents",
        ),
        not_for_prediction=("age",),
        listed_criteria=("age",),
    ),
)

GERMAN = Dataset(
    schema={
        "status": "string", "month": "int", "credit_history": "string", "purpose": "string",
        "credit_amount": "int", "savings": "string", "employment": "string",
        "investment_as_income_percentage": "int", "personal_status": "string", "other_debtors": "string",
        "residence_since": "int", "property": "string", "age": "int", "installment_plans": "string",
        "housing": "string", "number_of_credits": "int", "skill_level": "string", "people_liable_for": "int",
        "telephone": "string", "foreign_worker": "string", "credit": "int",
    },
    sep=" ",
    header=False,
    na_words=("A65", "A124"),
    spec=AuditSpec(
        name="german",
        label=LabelIn("credit", (1,)),
        groups={"age": Above("age", 25)},
        numeric=(
            "month", "credit_amount", "investment_as_income_percentage", "residence_since", "age",
            "number_of_credits", "people_liable_for",
        ),
        categorical=(
            "status", "credit_history", "purpose", "savings", "employment", "other_debtors", "property",
            "installment_plans", "housing", "skill_level", "telephone", "foreign_worker", "personal_status",
        ),
        not_for_prediction=("age", "personal_status"),
        listed_criteria=("age",),
    ),
)

DATASETS = {d.spec.name: d for d in (ADULT, FOLKTABLES, HEART, CREDIT, GERMAN)}

FOREST, CONFIDENT, SHAPLEY = "outliers-if", "mislabeled-cl", "mislabeled-sh"

# The audits of interest as (dataset, criteria, detector, columns).
CONFIGURATIONS = (
    ("adult", "sex", MISSING, ("workclass", "occupation", "native-country")),
    ("adult", "sex", SD, ("hours-per-week", "capital-gain", "capital-loss")),
    ("adult", "sex", IQR, ("hours-per-week", "capital-gain", "capital-loss")),
    ("adult", "sex", FOREST, ()),
    ("adult", "sex", CONFIDENT, ()),
    ("adult", "sex", SHAPLEY, ()),
    ("folktables", "sex", MISSING, ("COW", "SCHL", "OCCP", "WKHP")),
    ("folktables", "sex", SD, ("WKHP",)),
    ("folktables", "sex", FOREST, ()),
    ("folktables", "sex", CONFIDENT, ()),
    ("folktables", "sex", SHAPLEY, ()),
    ("heart", "sex", SD, ("height", "weight", "ap_lo", "gluc")),
    ("heart", "sex", IQR, ("height", "weight", "ap_hi", "ap_lo", "gluc")),
    ("heart", "sex", FOREST, ()),
    ("heart", "sex", CONFIDENT, ()),
    ("heart", "sex", SHAPLEY, ()),
    ("adult", "race", MISSING, ("workclass", "occupation", "native-country")),
    ("adult", "race", SD, ("hours-per-week", "capital-loss")),
    ("adult", "race", IQR, ("age", "hours-per-week", "capital-gain", "capital-loss")),
    ("adult", "race", FOREST, ()),
    ("adult", "race", CONFIDENT, ()),
    ("adult", "race", SHAPLEY, ()),
    ("folktables", "race", MISSING, ("COW", "SCHL", "OCCP", "WKHP")),
    ("folktables", "race", FOREST, ()),
    ("folktables", "race", CONFIDENT, ()),
    ("folktables", "race", SHAPLEY, ()),
    ("credit", "age", MISSING, ("MonthlyIncome", "NumberOfDependents")),
    ("credit", "age", IQR, (
        "RevolvingUtilizationOfUnsecuredLines", "NumberOfTime30-59DaysPastDueNotWorse", "DebtRatio",
        "NumberOfOpenCreditLinesAndLoans", "NumberOfTimes90DaysLate", "NumberRealEstateLoansOrLines",
        "NumberOfTime60-89DaysPastDueNotWorse",
    )),
    ("credit", "age", SD, (
        "NumberOfTime30-59DaysPastDueNotWorse", "DebtRatio", "MonthlyIncome", "NumberOfOpenCreditLinesAndLoans",
        "NumberOfTimes90DaysLate", "NumberRealEstateLoansOrLines", "NumberOfTime60-89DaysPastDueNotWorse",
        "NumberOfDependents",
    )),
    ("german", "age", MISSING, ("property",)),
    ("german", "age", IQR, ("people_liable_for",)),
    ("german", "age", CONFIDENT, ()),
    ("german", "age", SHAPLEY, ()),
)

# The dataset-level audits as (dataset, criteria).
CASES = (
    ("adult", "sex"),
    ("adult", "race"),
    ("folktables", "sex"),
    ("folktables", "race"),
    ("heart", "sex"),
    ("credit", "age"),
    ("german", "age"),
)


def dataset(name: str) -> Dataset:
    """A dataset by name; an unknown name raises ``KeyError``."""
    return DATASETS[name]


def load(
    spark: SparkSession,
    name: str,
    paths: str | Sequence[str],
    id_table: str | None = None,
    staged: bool = False,
) -> tuple[DataFrame, AuditSpec]:
    """Rows and roles of a dataset, from its own file format or a staged Parquet extract.

    With ``id_table`` the rows get ids and are written there first; the tuple
    detectors, which return ids, need that.
    """
    found = dataset(name)
    rows = found.read_staged(spark, paths) if staged else found.read(spark, paths)
    return (rows if id_table is None else with_row_ids(rows, id_table, found.spec.id_col)), found.spec
