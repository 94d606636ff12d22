import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veriparity.operators.detectors import IQR, MISSING, SD
from veriparity.sources import results
from veriparity.sources.catalog import CASES, CONFIGURATIONS, DATASETS, dataset, load
from veriparity.sources.delimited import normalise, read_delimited

# made-up rows in the shape of the files
ADULT_TRAIN = """41, Private, 1000, Masters, 14, Divorced, Sales, Unmarried, White, Male, 5, 0, 35, United-States, <=50K
52, ?, 2000, Masters, 14, Divorced, ?, Husband, Black, Male, 0, 7, 20, ?, >50K
"""
ADULT_TEST = """|1x3 Cross validator
23, Private, 3000, 9th, 5, Never-married, Sales, Own-child, Black, Female, 0, 0, 45, United-States, >50K.
"""


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_adult_two_files_with_junk(spark, tmp_path):
    paths = [write(tmp_path, "a.data", ADULT_TRAIN), write(tmp_path, "a.test", ADULT_TEST)]
    rows, spec = load(spark, "adult", paths)
    rows = rows.withColumn("label", spec.label_column()).withColumn("grp", spec.group("country"))
    got = {r.age: r for r in rows.collect()}
    assert sorted(got) == [23, 41, 52]
    assert got[52].workclass is None and got[52]["native-country"] is None
    assert [got[a].label for a in (41, 52, 23)] == [False, True, True]
    assert [got[a].grp for a in (41, 52, 23)] == ["priv", "dis", "priv"]
    assert dict(rows.dtypes)["hours-per-week"] == "int"


def test_row_ids_are_written(spark, tmp_path):
    paths = [write(tmp_path, "a.data", ADULT_TRAIN), write(tmp_path, "a.test", ADULT_TEST)]
    rows, spec = load(spark, "adult", paths, id_table=str(tmp_path / "ids"))
    assert rows.select(spec.id_col).distinct().count() == 3


def test_german_na_words_in_any_column(spark, tmp_path):
    line = "A12 9 A30 A46 2500 {} A71 3 A91 A102 1 {} {} A141 A151 3 A174 2 A191 A202 {}"
    text = "\n".join([line.format("A65", "A121", 67, 1), line.format("A61", "A124", 25, 2)]) + "\n"
    rows, spec = load(spark, "german", write(tmp_path, "g.data", text))
    got = rows.withColumn("label", spec.label_column()).withColumn("grp", spec.group("age")).orderBy("age").collect()
    assert [(r.savings, r.property, r.label, r.grp) for r in got] == [
        ("A61", None, False, "dis"),
        (None, "A121", True, "priv"),
    ]


def test_heart_and_credit_headers(spark, tmp_path):
    heart = "id;age;gender;height;weight;ap_hi;ap_lo;cholesterol;gluc;smoke;alco;active;cardio\n"
    heart += "7;20000;2;170;71.5;125;85;2;1;0;1;1;0\n"
    rows, spec = load(spark, "heart", write(tmp_path, "h.csv", heart))
    row = rows.withColumn("grp", spec.group("sex")).withColumn("label", spec.label_column()).first()
    assert (row.grp, row.label, row.weight) == ("dis", False, 71.5)
    names = list(dataset("credit").schema)
    credit = "," + ",".join(names) + "\n1,1,0.5,44,1,0.25,7000,3,0,1,0,4\n2,0,0.75,30,0,0.5,NA,2,0,0,0,\n"
    rows, spec = load(spark, "credit", write(tmp_path, "c.csv", credit))
    got = rows.withColumn("label", spec.label_column()).withColumn("grp", spec.group("age")).orderBy("age").collect()
    assert [(r.label, r.grp, r.MonthlyIncome, r.NumberOfDependents) for r in got] == [
        (True, "dis", None, None),
        (False, "priv", 7000.0, 4),
    ]


def test_staged_extract_is_projected(spark, tmp_path):
    folk = dataset("folktables")
    row = {c: 1.0 for c in folk.schema} | {"PINCP": 60000.0, "COW": float("nan"), "EXTRA": 5.0}
    spark.createDataFrame([row]).write.parquet(str(tmp_path / "acs"))
    rows = folk.read_staged(spark, str(tmp_path / "acs"))
    assert rows.columns == list(folk.schema)
    got = rows.withColumn("label", folk.spec.label_column()).withColumn("grp", folk.spec.group("race")).first()
    assert got.COW is None and got.label and got.grp == "priv"


def test_bad_number_raises(spark, tmp_path):
    path = write(tmp_path, "bad.csv", "1,x\n")
    with pytest.raises(PySparkException, match="not a number: x"):
        read_delimited(spark, path, {"a": "int", "b": "double"}).collect()


def test_normalise_only_chosen_columns(spark):
    rows = spark.createDataFrame([("65", "65", 65)], "a string, b string, n int")
    assert tuple(normalise(rows, ["65"], ["a"]).first()) == (None, "65", 65)
    assert tuple(normalise(rows, ["65"]).first()) == (None, None, 65)


def test_catalog_contents():
    assert set(DATASETS) == {"adult", "folktables", "heart", "credit", "german"}
    with pytest.raises(KeyError):
        dataset("nope")
    assert len(CONFIGURATIONS) == 33 and len(CASES) == 7
    by_criteria = [sum(c[1] == k for c in CONFIGURATIONS) for k in ("sex", "race", "age")]
    assert by_criteria == [16, 10, 7]
    for name, criteria, detector, columns in CONFIGURATIONS:
        spec = DATASETS[name].spec
        assert criteria in spec.groups
        assert set(columns) <= set(spec.numeric) | set(spec.categorical)
        assert bool(columns) == (detector in (MISSING, SD, IQR))
    for d in DATASETS.values():
        assert set(d.spec.numeric) | set(d.spec.categorical) <= set(d.schema)
        assert set(d.spec.not_for_prediction) <= set(d.spec.numeric) | set(d.spec.categorical)


DOCUMENT = {
    "ds/17/outliers/clean_SD_impute_mean_dummy/logistic_regression/101": {
        "dirty_test_acc": 0.8,
        "dirty__sex_priv__tp": 30,
        "note": "x",
    },
    "ds/3/outliers/dirty/knn_classification/7": {"dirty_test_acc": float("nan")},
}


def test_documents_keep_key_order(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    write(tmp_path / "docs", "USCensus_result.json", json.dumps(DOCUMENT))
    adult = {"adult": "USCensus_result.json"}
    rows = results.read_documents(spark, str(tmp_path / "docs"), adult).orderBy("pos").collect()
    assert [(r.dataset, r.pos, r.experiment) for r in rows] == [("adult", i, k) for i, k in enumerate(DOCUMENT)]
    assert rows[0].metrics == {"dirty_test_acc": 0.8, "dirty__sex_priv__tp": 30.0, "note": None}
    assert rows[1].metrics == {"dirty_test_acc": None}
    with pytest.raises(ValueError, match="absent: .*Cardio"):
        results.read_documents(spark, str(tmp_path / "docs"))
    write(tmp_path / "docs", "unrelated.json", "{}")
    with pytest.raises(ValueError, match="unknown: .*unrelated"):
        results.read_documents(spark, str(tmp_path / "docs"), adult)


@pytest.mark.parametrize("size", [1, 7, 64, 333, 1 << 20])
def test_documents_are_the_same_for_every_split(spark, tmp_path, size):
    """Strings with commas, brackets, quotes and escapes, read in blocks of any size, against the whole text parsed at once."""
    rng = random.Random(size)
    odd = ['x,"y"', "{", "}}", "\\", '\\"', "[1,2]", "é,日,\U0001f600", ",", "\n,\t", "a\\,b"]
    (tmp_path / "docs").mkdir()
    files, whole = {"adult": "USCensus_result.json", "heart": "Cardio_result.json", "german": "GermanCredit_result.json"}, []
    for k, (dataset, file) in enumerate(files.items()):
        entries = {
            f"ds/{i}/{rng.choice(odd)}/m": {rng.choice(odd) + str(j): rng.choice([1.5, -2, "t,}", None, float("nan")]) for j in range(rng.randint(0, 4))}
            for i in range(25 * k)
        }
        text = json.dumps(entries, indent=k or None, ensure_ascii=bool(k))
        write(tmp_path / "docs", file, text)
        whole.append((dataset, text))
    want = results.parse_documents(spark.createDataFrame(whole, "dataset string, value string")).collect()
    conf = {"spark.sql.files.maxPartitionBytes": f"{size}b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = results.read_documents(spark, str(tmp_path / "docs"), files).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    key = lambda r: (r.dataset, r.pos)
    assert [(key(r), r.experiment, r.metrics) for r in sorted(got, key=key)] == [(key(r), r.experiment, r.metrics) for r in sorted(want, key=key)]


@pytest.mark.parametrize("text", ['{"a": {}} , {"b": {}}', '{"a": {"x": 1}}}', '{"a": {"x": "1}}', '{"a": {}, "b"}'])
def test_documents_with_something_wrong_between_entries_raise(spark, tmp_path, text):
    (tmp_path / "docs").mkdir()
    write(tmp_path / "docs", "Cardio_result.json", text)
    with pytest.raises((PySparkException, Py4JJavaError, ValueError)):
        results.read_documents(spark, str(tmp_path / "docs"), {"heart": "Cardio_result.json"}).collect()


@pytest.mark.parametrize("text", ['{"a/1/b": {"x": 1', "[1]", "", '{"a": 5}'])
def test_damaged_documents_raise(spark, tmp_path, text):
    (tmp_path / "docs").mkdir()
    write(tmp_path / "docs", "Cardio_result.json", text)
    with pytest.raises((PySparkException, Py4JJavaError, ValueError)):  # an empty file counts as absent
        results.read_documents(spark, str(tmp_path / "docs"), {"heart": "Cardio_result.json"}).collect()


def test_damaged_lines_raise(spark, tmp_path):
    path = write(tmp_path, "lines.json", '{"dataset": "x", "pos": 1, "experiment": "e", "metrics": {"a": 1}}\n{"dataset": \n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        results.read_lines(spark, path).collect()


def test_header_files_are_read_by_name(spark, tmp_path):
    paths = [write(tmp_path, "a.csv", "x,y\n1,2\n"), write(tmp_path, "b.csv", "y,x,z\n30,40,7\n")]
    rows = read_delimited(spark, paths, {"x": "int", "y": "int"}, header=True)
    assert sorted(map(tuple, rows.collect())) == [(1, 2), (40, 30)]
    (tmp_path / "both").mkdir()
    write(tmp_path / "both", "a.csv", "x,y\n1,2\n")
    write(tmp_path / "both", "b.csv", "y,x\n30,40\n")
    rows = read_delimited(spark, str(tmp_path / "both"), {"x": "int", "y": "int"}, header=True)
    assert sorted(map(tuple, rows.collect())) == [(1, 2), (40, 30)]
    with pytest.raises(PySparkException):
        read_delimited(spark, paths, {"x": "int", "absent": "int"}, header=True).collect()


@pytest.mark.parametrize(("line", "fine"), [("9007199254740993 3.0 x", True), ("4 5", False), ("6 7 8 9", False), ("1 3.7 x", False), ("9223372036854775808 1 x", False)])
def test_whole_numbers_and_ragged_lines(spark, tmp_path, line, fine):
    path = write(tmp_path, "n.data", line + "\n")
    rows = read_delimited(spark, path, {"a": "bigint", "b": "int", "c": "string"}, sep=" ")
    if fine:
        assert tuple(rows.first()) == (9007199254740993, 3, "x")
    else:
        with pytest.raises(PySparkException):
            rows.collect()
    if len(line.split()) != 3:
        with pytest.raises(PySparkException):
            rows.select("c").collect()


def test_extract_without_a_column_raises(spark, tmp_path):
    spark.createDataFrame([(50, 1)], "age int, gender int").write.parquet(str(tmp_path / "heart"))
    with pytest.raises(ValueError, match="lacks columns of heart: height"):
        dataset("heart").read_staged(spark, str(tmp_path / "heart"))


def test_lines_round_trip(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    write(tmp_path / "docs", "Cardio_result.json", json.dumps(DOCUMENT))
    rows = results.read_documents(spark, str(tmp_path / "docs"), {"heart": "Cardio_result.json"})
    results.write_lines(rows, str(tmp_path / "lines"))
    again = results.read_lines(spark, str(tmp_path / "lines"))
    key = lambda r: r.pos
    first, second = sorted(rows.collect(), key=key), sorted(again.collect(), key=key)
    assert [(r.experiment, r.metrics.get("dirty_test_acc")) for r in first] == [
        (r.experiment, r.metrics.get("dirty_test_acc")) for r in second
    ]
    assert results.metric_rows(again).where(F.col("metric_name") == "dirty__sex_priv__tp").first().value == 30.0


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_impact_round_trip(spark, tmp_path, form):
    data = [
        ("adult", "sex", "m1", "XGBoost", "missing_values", "", "impute_mean_dummy", True, "positive", "negative"),
        ("heart", "gender", "m2", "XGBoost", "outliers", "SD", "impute__mean_dummy", False, "negative", "insignificant"),
    ]
    rows = spark.createDataFrame(data, results.IMPACT_SCHEMA)
    results.write_impact(rows, str(tmp_path / "impact"), form)
    again = results.read_impact(spark, str(tmp_path / "impact"), form).select(*rows.columns)
    assert sorted(map(tuple, again.collect())) == sorted(data)
    results.register_impact(spark, str(tmp_path / "impact"), form, "toy_impact")
    assert spark.sql("SELECT count(*) AS n FROM toy_impact WHERE detection = ''").first().n == 1
    with pytest.raises(ValueError):
        results.write_impact(rows, str(tmp_path / "other"), "yaml")
