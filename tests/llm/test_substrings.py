import random

import pytest

from veriparity.llm import substrings


def brute(rows, window=50):
    """(doc_id, text) to (doc_id, words, removed, kept): words of windows that start in an earlier document."""
    last = 2**63 - 1
    first = {}
    split = [((last if i is None else i), (t or "").encode().split()) for i, t in rows]
    for place, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, last), place)
    out = []
    for (doc_id, _), (place, w) in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < place:
                gone.update(range(k, k + window))
        out.append((doc_id, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in substrings.without_repeats(df, **kw).collect()), key=str)


def test_sample(documents, texts):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    want = brute(rows)
    assert sum(r[2] for r in want) > 500
    assert got(documents) == want


@pytest.mark.parametrize("seed", range(6))
def test_random_passages(spark, seed, monkeypatch):
    """Passages of about the window's length at random places, overlapping, from texts that change hands."""
    monkeypatch.setattr(substrings, "DEEPER", (2, 4))  # long prefixes are used, and crowds occur
    monkeypatch.setattr(substrings, "CROWD", 6 if seed % 2 else 10**6)
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(3 if seed == 0 else 300)]
    source = [rng.choice(pool) for _ in range(400)]
    rows = []
    for i in rng.sample(range(1000), 60):
        text = []
        for _ in range(rng.randint(1, 4)):
            text += [rng.choice(pool) for _ in range(rng.randint(0, 40))]
            n = rng.choice([30, 33, 34, 35, 36, 50, 70, 100])
            at = rng.randrange(400 - n)
            text += source[at : at + n]
        rows.append((i, " ".join(text)))
    rows += [(2000 + i, rows[0][1]) for i in range(20)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), window=34) == brute(rows, 34)


def test_separators_and_case(spark):
    long = [f"é{i}" for i in range(60)]
    rows = [(1, " ".join(long)), (2, "\n\t".join(long)), (3, " ".join(long)), (4, " ".join(long).upper()), (5, "\x1c".join(long))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_edges(odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert got(odd_documents) == brute(rows)
    assert got(no_documents) == []
    with pytest.raises(ValueError, match="words"):
        substrings.repeats_of(substrings.keyed(odd_documents), window=10)


def test_strip_keeps_columns_and_spacing(spark, documents, no_documents):
    long = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame(
        [(1, f"a\n{long} b", None, 5), (2, f"head\n\n{long}\ntail  end", "x", 6), (3, None, "y", 7), (4, "same\n text ", "z", None)],
        "doc_id long, text string, row string, spans int",
    )
    out = {r["doc_id"]: r for r in substrings.strip_repeats(df).collect()}
    assert out[1]["text"] == f"a\n{long} b" and out[2]["text"] == "head\n\ntail  end" and out[3]["text"] is None
    assert out[4]["text"] == "same\n text " and out[2]["spans"] == 6 and out[2]["row"] == "x"
    every = substrings.strip_repeats(documents)
    assert every.columns == documents.columns and every.count() == documents.count()
    assert substrings.strip_repeats(no_documents).count() == 0
