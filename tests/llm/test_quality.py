import random

import numpy as np
import pytest

from veriparity.llm import quality as q


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    syllables = ["ba", "ke", "lo", "mi", "tu", "ra", "sen", "dor"]
    def clean(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(300):
        good = i % 5 != 0
        text = clean(rng.randint(2, 120))
        if not good:
            text = "".join(rng.choice("#%$&*!QXZ ") for _ in range(200))
        rows.append((i, text, ("en", "de", None)[i % 3]))
        if i % 2:
            labels.append((i, int(good), 0))
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_junk_goes_and_clean_stays(corpus):
    got = {r["doc_id"]: r["kept"] for r in q.classify(*corpus).collect()}
    assert len(got) == 300
    assert not any(got[i] for i in got if i % 5 == 0)
    # of 240 clean rows, half of them not seen in training
    assert sum(got[i] for i in got if i % 5) >= 237


def test_joins_and_lookups_agree(corpus):
    a = {r["doc_id"]: r for r in q.classify(*corpus).collect()}
    b = {r["doc_id"]: r for r in q.classify(*corpus, q.Settings(broadcast_entries=0)).collect()}
    assert a.keys() == b.keys()
    for i in a:
        assert abs(a[i]["perplexity"] - b[i]["perplexity"]) < 1e-4 * a[i]["perplexity"] and a[i]["kept"] == b[i]["kept"]


def test_probabilities_are_those_of_the_recursion(spark):
    """The model against modified Kneser-Ney written out, and each context's probabilities sum to one."""
    texts = ["abracadabra", "abra cadabra", "a", "bra", "cadab"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model = q.Model(q.model_of(docs).toArrow().combine_chunks())
    counts = {q.ORDER: {}}
    for t in texts:
        s = [0] * (q.ORDER - 1) + [ord(c) for c in t]
        for i in range(q.ORDER - 1, len(s)):
            g = tuple(s[i - q.ORDER + 1 : i + 1])
            counts[q.ORDER][g] = counts[q.ORDER].get(g, 0) + 1
    for k in range(q.ORDER - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    cuts = {}
    for k, c in counts.items():
        n = [sum(v == x for v in c.values()) for x in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 0.75, 3 - 4 * y * n[3] / n[2] if n[2] else 0.75]
        cuts[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / q.SYMBOLS
        followers = {h: c for h, c in counts[k].items() if h[:-1] == g[:-1]}
        if not followers:
            return p(g[1:])
        total = sum(followers.values())
        cut = lambda c: cuts[k][min(c, 3) - 1]
        own = followers[g] - cut(followers[g]) if g in followers else 0
        return own / total + sum(map(cut, followers.values())) / total * p(g[1:])

    def packed(g):
        return sum(c << q.BITS * (q.ORDER - 1 - i) for i, c in enumerate(g))

    probes = list(counts[q.ORDER]) + [tuple(map(ord, x)) for x in ("abrab", "zzzzz", "caddd", "dabrz", "ra ca")]
    got = model.log_probabilities(np.array([packed(g) for g in probes], np.int64))
    assert np.allclose(got, [np.log(p(g)) for g in probes], atol=1e-4)
    context = packed((ord("a"), ord("b"), ord("r"), ord("a"), 0))
    every = model.log_probabilities(context + np.arange(q.SYMBOLS, dtype=np.int64))
    assert abs(np.exp(every).sum() - 1) < 1e-3


def test_edges(spark, documents, odd_documents, no_documents, corpus):
    labels = corpus[1]
    assert q.classify(documents, labels).count() == documents.count()
    assert q.classify(odd_documents, labels.withColumn("lang", labels["toxic"])).count() == odd_documents.count()
    assert q.classify(no_documents, labels).count() == 0
    unlabelled = q.classify(documents, labels.where("quality > 5"))
    assert unlabelled.where("NOT kept").isEmpty() and unlabelled.count() == documents.count()
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, None), (5, None, 0)], labels.schema))
    kept = q.keep_good(corpus[0], twice)
    assert kept.columns == corpus[0].columns and 237 <= kept.count() <= 240
    nulls = odd_documents.withColumn("kept", labels["toxic"] if False else odd_documents["n_chars"])
    assert q.keep_good(nulls, labels).columns == nulls.columns
