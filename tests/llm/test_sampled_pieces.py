import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veriparity.llm import sampled_pieces as sp

V = sp.vocabulary(None, 0.5)


def ids_of(text, key=1, seed=0, v=V):
    return sp.sample_slice([text], np.array([key], np.uint64), v, seed)[0].tolist()


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_round_trip_of_any_text(text):
    assert V.decode(ids_of(text)) == text


@pytest.mark.parametrize("text", ["", " ", "  two  spaces ", "▁ and ▁▁", "line\nbreak\n\n", "\0 null", "x" * 4000, "日本 😀", "\t\r\n"])
def test_round_trip(text):
    assert V.decode(ids_of(text)) == text


def test_draws_depend_on_key_and_seed_only():
    text = "reproducible segmentations of tokenization words " * 4
    alone = ids_of(text, 5)
    among = sp.sample_slice(["something else", text, text], np.array([1, 5, 6], np.uint64), V, 0)
    assert alone == among[1].tolist() != among[2].tolist()
    assert alone != ids_of(text, 5, seed=1)


def test_draws_are_fixed():
    """Digests of the ids for given keys, seed and sharpness."""
    texts = ["the quick brown fox ▁ jumps\n\n over", "", "  日本語 text 😀 with \t bytes  ", "x" * 50 + " the the", "\0 \0"]
    drawn = sp.sample_slice(texts, np.arange(5, dtype=np.uint64), V, 9)
    want = [574765502, 0, 552168268, 1851380513, 4012881128]
    assert [zlib.crc32(x.astype("<u4").tobytes()) for x in drawn] == want


def test_pieces_are_looked_up_only_where_they_may_end(monkeypatch):
    looked_up = []
    find = sp.Vocabulary.find
    monkeypatch.setattr(sp.Vocabulary, "find", lambda v, keys: looked_up.append(len(keys)) or find(v, keys))
    rng = random.Random(4)
    words = {"".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(5000)}
    text = " ".join(sorted(words))
    assert V.decode(ids_of(text)) == text
    pairs = sum(min(n, V.longest) for w in words for n in range(1, len(w) + 2))
    assert 0 < sum(looked_up) < 0.6 * pairs


def test_chunks_that_share_a_hash_are_told_apart():
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64, whatever the base."""
    word = "a"
    swapped = {97: 98, 98: 97}
    for _ in range(12):
        word += word.translate(swapped)
    other = word.translate(swapped)
    texts = [f"{word} {other}", "", other, word]
    found = sp.Slice(texts)
    text = "".join(chr(c) for c in found.plain)
    shown = [text[s : s + n] for s, n in zip(found.start[found.kinds], found.sizes[found.kinds], strict=True)]
    assert shown == [f" {word}", f" {other}", f" {other}", f" {word}"]
    drawn = sp.sample_slice(texts, np.zeros(4, np.uint64), V, 0)
    assert [V.decode(x.tolist()) for x in drawn] == texts


def brute(text, v):
    """Weight of each segmentation of a short text without bare characters."""
    text = "▁" + text
    weights = {}
    table = {}
    for i, b in enumerate(v.bytes):
        if b and not (i in v.byte_ids.tolist()):
            table[b.decode()] = i
    def walk(at, ids):
        if at == len(text):
            weights[tuple(ids)] = sum(scores[i] for i in ids)
        for end in range(at + 1, len(text) + 1):
            piece = text[at:end].replace("▁", " ")
            if piece in table:
                walk(end, [*ids, table[piece]])
    scores = {int(i): float(w) for i, w in zip(v.ids, v.weights, strict=True) if i >= 0}
    walk(0, [])
    most = max(weights.values())
    total = sum(np.exp(w - most) for w in weights.values())
    return {k: np.exp(w - most) / total for k, w in weights.items()}


def test_segmentations_are_drawn_by_their_weight():
    n = 20_000
    drawn = sp.sample_slice(["these"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), V, 3)
    got = Counter(tuple(x.tolist()) for x in drawn)
    want = brute("these", V)
    assert set(got) <= set(want) and len(want) > 3
    for ids, p in want.items():
        assert abs(got[ids] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_tables(documents, odd_documents, no_documents, texts):
    pieces = sp.sample_pieces(documents, seed=2)
    decoded = {r["doc_id"]: r["text"] for r in sp.decode_pieces(pieces).collect()}
    assert decoded == {i * 3 + 1: t or "" for i, t in enumerate(texts)}
    trips = sp.round_trips(documents, seed=2).collect()
    assert len(trips) == len(texts) and all(r["lossless"] for r in trips)
    again = {r["doc_id"]: r for r in sp.round_trips(documents.repartition(2), seed=2).collect()}
    assert all(again[r["doc_id"]] == r for r in trips)
    assert sp.round_trips(odd_documents).where("NOT lossless").count() == 0
    assert sp.round_trips(no_documents).count() == 0
