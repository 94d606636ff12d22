import random

import pytest

CLASHING = (
    "place", "mark", "spans", "row", "rep", "key", "seed", "a", "b", "n", "first", "component", "kept", "length", "ids",
    "score", "good", "trusted", "range", "nth", "h", "k", "toxic", "sound", "bucket", "extra",
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=40):
    return [rng.choice([f"w{i}" for i in range(size)]) + rng.choice(["", "", "", ".", ","]) for _ in range(n)]


def sample_texts(seed=1):
    """Random texts with exact and near copies, shared passages, empty, blank and long ones."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randint(1, 160), 400)) for _ in range(40)]
    passage = " ".join(words(rng, 70, 400))
    texts += [f"{texts[i]}\n{passage} {texts[i + 1]}" for i in range(8)]
    texts += [texts[0], texts[0], texts[3], texts[12]]
    for i in range(10):
        near = texts[i].split(" ")
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += ["", " ", "\n\t", "one", "One", "two words", "Two Words", "x" * 3000, None, None]
    texts.append(" ".join(words(rng, 6000, 3000)))
    texts.append(" ".join(["same"] * 300))
    texts.append(" ".join(["same"] * 200))
    rng.shuffle(texts)
    return texts


@pytest.fixture(scope="session")
def texts():
    return sample_texts()


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The sample as ``documents``, with further columns whose names operators use inside."""
    rows = [(i * 3 + 1, t, ("en", "de", None)[i % 3], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null ids, equal ids, repeated rows and null columns."""
    long = " ".join(f"v{i}" for i in range(80))
    rows = [
        (1, long, "en", None, None), (1, long, "en", None, None), (1, "other text", None, None, 3), (None, long, "en", "s", 1),
        (None, None, None, None, None), (7, None, None, None, None), (9, long + " end", "en", "s", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
