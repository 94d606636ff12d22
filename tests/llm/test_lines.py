import random
from collections import defaultdict

import pytest

from veriparity.llm.lines import line_dedup, strip_lines

BLANKS = " \t\n\v\f\r"
LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least_documents=3, least_chars=20):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    order = lambda doc: 2**63 - 1 if doc is None else doc
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(order(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least_documents or max(holders[key(x)]) == order(doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def sample():
    rng = random.Random(5)
    lines = [f"this line is number {i} of those" for i in range(30)] + ["short", "", "  ", "ÄÖÜ Zeile mit ÉÈ Größe und so", "äöü zeile mit éè größe und so"]
    lines += ["exactly twenty chars", "only nineteen chars", "x" * 20, "\U0001f600" * 20, "\U0001f600" * 19, "inner\ttab  stays inside it"]
    rows = []
    for i in range(60):
        picked = [rng.choice(lines) for _ in range(rng.randint(0, 12))]
        picked = [rng.choice([x, x.upper() if x.isascii() else x, "\t " + x + " \r", "\v" + x + "\f", x + " "]) for x in picked]
        rows.append((i * 2, "\n".join(picked)))
    rows += [(500, None), (501, ""), (502, "\n"), (503, "\n\n"), (504, lines[0] + "\n"), (504, lines[1]), (504, lines[1]), (None, lines[2] + "\nown text of this row"), (None, lines[2])]
    return rows


@pytest.mark.parametrize(("least_documents", "least_chars"), [(3, 20), (2, 1), (10, 5)])
def test_lines(spark, sample_rows, least_documents, least_chars):
    got = line_dedup(spark.createDataFrame(sample_rows, "doc_id long, text string").repartition(6), least_documents, least_chars)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(sample_rows, least_documents, least_chars)


@pytest.fixture(scope="module")
def sample_rows():
    return sample()


def test_the_last_document_keeps_all_its_lines(spark):
    line = "a line that three documents hold"
    rows = [(1, line), (2, f"{line}\nx\n{line.upper()}"), (3, f"{line}\n{line}\n  {line}")]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1, ""), 2: (3, 2, "x"), 3: (3, 0, rows[2][1])}


def test_long_texts(spark):
    """Hundreds of thousands of lines, a third of them dropped, take time in proportion."""
    own = [f"line number {i} of the long text" for i in range(150_000)]
    shared = "a line that very many texts share"
    long = "\n".join(x if i % 3 else f"{shared} {i % 7}" for i, x in enumerate(own))
    rows = [(1, long), (2, "\n".join(f"{shared} {i}" for i in range(7))), (3, "\n".join(f"{shared} {i}" for i in range(7))), (4, "y" * 3_000_000)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_other_columns_and_edges(spark, documents, odd_documents, no_documents):
    got = strip_lines(documents)
    assert got.schema.names == documents.schema.names and got.count() == documents.count()
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    want = {d: (None if texts[d] is None else kept) for d, _, _, kept in brute(list(texts.items()))}
    assert {r["doc_id"]: r["text"] for r in got.select("doc_id", "text").collect()} == want
    assert {r["x"] for r in got.select(got["extra"].alias("x")).collect()} == {"x"}
    assert line_dedup(odd_documents).count() == odd_documents.count() and line_dedup(no_documents).count() == strip_lines(no_documents).count() == 0
