import random
from math import log

from pyspark.sql import functions as F

from veriparity.llm import toxicity as tx

RNG = random.Random(5)
PLAIN = [f"plain{i}" for i in range(60)]


def sentence(*more):
    words = [RNG.choice(PLAIN) for _ in range(12)] + list(more)
    RNG.shuffle(words)
    return " ".join(words) + "."


def labelled(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        # one group is named mostly in toxic texts, as in biased data
        group = "muslim" if RNG.random() < (0.8 if toxic else 0.05) else "christian" if RNG.random() < 0.3 else PLAIN[0]
        rows.append((i, sentence(group, *(["awful", "vile"][: 1 + i % 2] if toxic else []))))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_and_neutral_mentions(spark):
    docs, labels = labelled(spark)
    probe = spark.createDataFrame(
        [(1000, "we met a muslim friend."), (1001, "we met a christian friend."), (1002, "an awful vile thing."), (1003, None), (1004, "")],
        "doc_id long, text string",
    )
    every = docs.unionByName(probe)
    def scores(weight):
        rows = tx.toxicity_scores(every, labels, F.lit(True), tx.Fit(counterfactual=weight, ridge=1.0)).collect()
        return {r["doc_id"]: r["score"] for r in rows}
    plain, fair = scores(0.0), scores(500.0)
    assert fair[1002] > 0.7 and all(0 <= s <= 1 for s in fair.values())
    gap = lambda s: log(s[1000] / (1 - s[1000])) - log(s[1001] / (1 - s[1001]))
    assert gap(plain) > 0.5  # without the penalty one group counts as toxic
    assert abs(gap(fair)) < 0.3 * gap(plain)
    assert fair[1003] == fair[1004]
    right = sum((fair[i] >= 0.5) == (i % 4 == 0) for i in range(600))
    assert right > 570


def test_labels_outside_training_have_no_effect(spark):
    docs, labels = labelled(spark)
    training = F.col("doc_id") % 3 != 1
    flipped = labels.withColumn("toxic", F.when(training, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a = tx.toxicity_scores(docs, labels, training).orderBy("doc_id").collect()
    assert a == tx.toxicity_scores(docs, flipped, training).orderBy("doc_id").collect()


def test_edges(spark, documents, odd_documents, no_documents):
    docs, labels = labelled(spark, 200)
    assert tx.toxicity_scores(documents, labels, F.lit(True)).count() == documents.count()
    assert tx.toxicity_scores(odd_documents, labels.withColumn("text", F.lit("x")), F.lit(True)).count() == odd_documents.count()
    assert tx.toxicity_scores(no_documents, labels, F.lit(True)).count() == 0
    assert {r["score"] for r in tx.toxicity_scores(docs, labels.where("toxic = 0"), F.lit(True)).collect()} == {0.0}
    twice = labels.unionByName(labels)
    assert tx.sample_of(twice, F.lit(True), 100).groupBy("doc_id").count().where("count > 1").isEmpty()
    nulls = spark.createDataFrame([(None, None, None), (3, None, None)], labels.schema)
    assert tx.sample_of(labels.unionByName(nulls), F.lit(True), 10**6).count() == 200
