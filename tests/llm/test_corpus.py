"""The registered corpus queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from veriparity.llm import queries
from veriparity.llm.common import table
from veriparity.llm.minhash import near_duplicates
from veriparity.llm.quality import classify
from veriparity.llm.secret_scan import masked

SMALL = "/root/testdata/sf0.001"


def test_queries_are_registered():
    found = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_columns_and_rows(spark, name):
    rows = queries.QUERIES[name](spark, SMALL)
    documents = table(spark, SMALL, "embeddings" if name.startswith("op4") else "documents")
    assert name.startswith("op11") and rows.count() > 100 or rows.count() >= documents.count()
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        want = con.execute(queries.ORACLES[name]).fetchall()
        names = [d[0] for d in con.description]
        got = [tuple(r[c] for c in names) for r in rows.collect()]
        assert sorted(got) == sorted(want)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against a plain computation on what the stage before has kept."""
    from test_links import brute_documents
    from test_packing import check
    from test_substrings import brute

    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert 4 <= len(stages) <= 5

    def through(name, docs):
        rows = stages[name](spark, docs, SMALL)
        rows.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    kept = {r["doc_id"] for r in classify(docs, table(spark, SMALL, "labels")).collect() if r["kept"]}
    docs = through("quality classifier", docs)
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == kept and len(kept) < len(before)
    assert all(r == before[r["doc_id"]] for r in docs.collect())

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first = {i for i, x in brute_documents(rows, 5, 80).items() if x[2]}
    assert {r["doc_id"] for r in near_duplicates(docs).where("kept").collect()} == first
    docs = through("minhash near-dedup", docs)
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == first

    want = {i: kept for i, _, _, kept in brute([(r["doc_id"], r["text"]) for r in docs.collect()])}
    docs = through("substring dedup", docs)
    assert docs.columns == columns and {r["doc_id"]: " ".join((r["text"] or "").split()) for r in docs.collect()} == {
        i: " ".join(t.split()) for i, t in want.items()
    }
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    docs = through("secret scan", docs)
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == {i: masked(t, "[secret]") for i, t in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = through("packing", docs).collect()
    assert check(packed, {r["doc_id"]: [r["text"]] for r in docs.collect()}, 4096) > 0.9


def labelled(spark, folder, docs, quality):
    docs.write.parquet(f"{folder}/documents.parquet")
    ids = [(r["doc_id"], quality, 0) for r in docs.select("doc_id").distinct().collect() if r["doc_id"] is not None]
    spark.createDataFrame(ids, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("kind", ["documents", "odd_documents", "no_documents"])
def test_all_stages_take_odd_tables(spark, tmp_path, request, kind):
    """Null texts and ids, repeated rows, columns with the names that operators use, and no rows at all."""
    docs = request.getfixturevalue(kind)
    folder = labelled(spark, tmp_path / "in", docs, 1)
    given = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, docs, folder)
        rows.write.parquet(str(tmp_path / str(i)))
        if name != "packing":
            assert rows.schema.names == docs.schema.names
        docs = spark.read.schema(rows.schema).parquet(str(tmp_path / str(i)))
    assert (docs.count() == 0) == (given == 0)
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_run_deletes_what_it_wrote_on_its_way(spark, tmp_path, odd_documents, monkeypatch):
    folder = labelled(spark, tmp_path / "in", odd_documents, 1)
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(corpus_pipeline, "checkpoint_dir", lambda spark: str(shared))
    rows = corpus_pipeline.run(spark, folder)
    assert [p.name for p in shared.glob("*/*")] == [str(len(corpus_pipeline.STAGES) - 1)] and rows.count() > 0


def test_run_gives_the_rows_of_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0
