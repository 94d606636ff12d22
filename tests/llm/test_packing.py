import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veriparity.llm import packing


def whole(text):
    return packing.loaded(None).encode(text, add_special_tokens=False).ids + [packing.END_ID]


@pytest.mark.parametrize("text", [
    "", " ", "Hello, World! it's 12 o'clock", "<|endoftext|> x <|startoftext|>y", "a<|endoftext|>. <|ENDOFTEXT|> B<|startoftext|>", "A <|ENDOFTEXT|>.", "a b c　d ́e", "É é É ſ K ΑΣ Σ",
    "日本語 テキスト", "x" * 5000, "tab\tnew\nline\r\x0b\x0c\x1c\x1d\x85end", "😀😀 👩‍👩‍👧", "́ ́x",
])
def test_ids_from_words_are_those_of_the_text(text):
    assert packing.word_tokens(None).encode([text.encode()])[0].tolist() + [packing.END_ID] == whole(text)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_from_words_of_any_text(text):
    assert packing.word_tokens(None).encode([text.encode()])[0].tolist() + [packing.END_ID] == whole(text)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_patterns_hold_every_piece_and_fit(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    held = {}
    for pattern, count in patterns:
        assert sum(pattern) <= 64 and count > 0 and list(pattern) == sorted(pattern, reverse=True)
        for length in pattern:
            held[length] = held.get(length, 0) + count
    assert held == histogram
    least = -(-sum(k * n for k, n in histogram.items()) // 64)
    assert sum(n for _, n in patterns) <= 2 * least + 1


def check(rows, expected, capacity):
    """Every id in one piece, sequences gapless from 0; returns the share of padded places that hold ids."""
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded_to"], r["sequence_tokens"]))
        docs.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length, _, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and {p[3] for p in parts} == {at}
        assert {p[2] for p in parts} == {at if at & (at - 1) == 0 else capacity}
    assert sorted(sequences) == list(range(len(sequences)))
    assert sorted(docs, key=str) == sorted(expected, key=str)
    for doc_id, texts in expected.items():
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in docs[doc_id])
        want = []
        for text in texts:
            ids = np.array(whole(text), "<u4")
            for start in range(0, len(ids), capacity):
                piece = ids[start : start + capacity]
                want.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
        assert pieces == sorted(want)
    return sum(r["length"] for r in rows) / sum(p[0][2] for p in sequences.values())


def test_pack_documents(documents, texts):
    expected = {i * 3 + 1: [t or ""] for i, t in enumerate(texts)}
    for capacity in (64, 4096):
        rows = packing.pack_documents(documents, capacity=capacity, keep_ids=False).collect()
        assert check(rows, expected, capacity) > 0.8


def test_edge_rows(odd_documents, no_documents):
    expected = {}
    for r in odd_documents.collect():
        expected.setdefault(r["doc_id"], []).append(r["text"] or "")
    check(packing.pack_documents(odd_documents, capacity=128, keep_ids=False).collect(), expected, 128)
    assert packing.pack_documents(no_documents).count() == 0


def test_sequences_hold_the_ids(documents, texts):
    packed = packing.pack_documents(documents, capacity=256)
    pieces = {(r["doc_id"], r["start"]): r["ids"] for r in packed.collect()}
    for i, t in enumerate(texts):
        ids = whole(t or "")
        assert [x for s in range(0, len(ids), 256) for x in pieces[i * 3 + 1, s]] == ids
    sequences = packing.sequences_of(packed).collect()
    assert sum(len(r["ids"]) for r in sequences) == sum(map(len, pieces.values()))
    assert all(len(r["ids"]) <= r["padded_to"] for r in sequences)


def test_a_length_that_all_share(spark):
    rows = spark.range(500).selectExpr("id AS doc_id", "'same text here' AS text")
    got = packing.pack_documents(rows, capacity=64, keep_ids=False).collect()
    assert check(got, {i: ["same text here"] for i in range(500)}, 64) > 0.9


def test_batches_that_begin_inside_a_run_of_equal_lengths(spark, documents, texts):
    repeats = [(1000 + i, " ".join(["same"] * (1 + i // 7))) for i in range(70)]  # runs of 7 pieces in batches of 3
    rows = documents.select("doc_id", "text").union(spark.createDataFrame(repeats, "doc_id long, text string"))
    expected = {i * 3 + 1: [t or ""] for i, t in enumerate(texts)} | {i: [t] for i, t in repeats}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for capacity in (64, 4096):
            check(packing.pack_documents(rows, capacity=capacity, keep_ids=False).collect(), expected, capacity)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abÉ日İª1.,!'…。_́̈-s\x01"), min_size=1, max_size=6), max_size=12))
def test_ids_of_words_with_signs_at_their_ends(words):
    """Punctuation is remembered apart from the letters before it, and words of letters are encoded together."""
    text = " ".join(words)
    assert packing.word_tokens(None).encode([text.encode()])[0].tolist() + [packing.END_ID] == whole(text)
