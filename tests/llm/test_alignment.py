import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veriparity.llm.alignment import align_tokenizers, aligned, crossings, default_paths, merged, pair_counts, segments, tables


def pieces_of(text):
    """(id, end) lists of both sides by the libraries alone, or None."""
    path_a, path_b = default_paths()
    tok = Tokenizer.from_file(path_a)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = dict(zip(printable, map(chr, printable), strict=True)) | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
    code = {c: b for b, c in letter.items()}

    def encode(text):
        if not text:
            return None
        target = (" " + text).encode()
        a = [(i, bytes(code[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
        sides = []
        for side in (a, b):
            if b"".join(x for _, x in side) != target:
                return None
            ends = np.cumsum([len(x) for _, x in side]).tolist()
            sides.append([(i, e) for (i, _), e in zip(side, ends, strict=True)])
        return sides

    return encode(text)


def brute(rows):
    found, counts = [], Counter()
    for doc, text in rows:
        sides = pieces_of(text)
        if sides is None:
            found.append((doc, 0, 0, 0, [], ""))
            continue
        a, b = sides
        by_end = {e: i for i, e in b}
        links = [(i, by_end[e]) for i, e in a if e in by_end]
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append(tuple(",".join(str(i) for i, e in side if low < e <= cut) for side in (a, b)))
            low = cut
        counts.update(links)
        found.append((doc, len(a), len(b), len(groups), links, ";".join(f"{x}|{y}" for x, y in groups)))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (doc, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), text and hashlib.sha256(text.encode()).hexdigest())
        for doc, n_a, n_b, n_groups, links, text in found
    ]


TEXTS = [
    "Hello world, it's a test", "  two spaces   and\ttabs \n\n newlines \r\n end ", " leading", "trailing ", "日本語の文章と english", "Füße über Straßen – naïve café",
    "<|endoftext|> and <s> </s> <unk> are text", "▁ is no space", "a▁b", None, "", " ", "\n", "x" * 2000, "emoji \U0001f600\U0001f468‍\U0001f469 done", "nul \x00 byte \x1c sep",
    "a b", "a b", "1234567890 3.14159 0x1f", "don't won't I'll we've", "￿ � \x85   wide", "مرحبا بالعالم",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    alphabet = ["word", "The", "ing", " ", " ", " ", "\n", "é", "日", "’s", "'s", "12", "_", " ", "\t", "ß", "=", "  "]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(n)]


def digest(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rows = list(enumerate(TEXTS + random_texts(60, 3)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS pairs", "1 AS n_a", "2 AS a", "3 AS links").repartition(3)
    assert digest(align_tokenizers(df)) == sorted(brute(rows), key=str)


def test_segments_are_encoded_as_the_whole(spark):
    """The same result when texts are cut into small segments and merged in small pieces."""
    rows = list(enumerate([" ".join(random_texts(30, 7)), *random_texts(20, 8), *TEXTS]))
    t = tables(None, None)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(str, aligned(df).collect()))
    for segment, piece in ((40, 3), (7, 256), (1, 1)):
        for text in filter(None, (x for _, x in rows)):
            parts = list(segments(text, segment))
            assert " ".join(parts) == text
            for side in (t.a, t.b):
                assert [i for part in side.encode(parts) for i in part] == side.encode([text])[0]
        assert sorted(map(str, aligned(df, segment=segment, piece=piece).collect())) == whole


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64, 10_000])
def test_merge_path(piece):
    rng = np.random.default_rng(piece)
    for n, m in ((0, 0), (0, 5), (5, 0), (1, 1), (40, 7), (300, 310), (1000, 3)):
        a, b = (np.sort(rng.choice(1500, k, replace=False)) for k in (n, m))
        i, j = crossings(a, b, piece)
        steps = np.diff(i + j)
        assert i[0] == j[0] == 0 and (i[-1], j[-1]) == (n, m) and (steps[:-1] == piece).all() and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
        x, y = merged(a, b, piece)
        assert a[x].tolist() == b[y].tolist() == np.intersect1d(a, b).tolist()


def test_groups_hold_the_same_bytes(spark):
    rows = list(enumerate([*TEXTS, *random_texts(20, 11)]))
    t = tables(None, None)
    for r in aligned(spark.createDataFrame(rows, "doc_id long, text string"), keep_groups=True).collect():
        text = rows[r["doc_id"]][1]
        assert len(r["groups"]) == r["n_groups"]
        for g in r["groups"]:
            assert b"".join(t.a.bytes[i] for i in g["a"]) == b"".join(t.b.bytes[i] for i in g["b"])
        if r["n_groups"]:
            assert b"".join(t.a.bytes[i] for g in r["groups"] for i in g["a"]) == (" " + text).encode()
            written = ";".join(f"{','.join(map(str, g['a']))}|{','.join(map(str, g['b']))}" for g in r["groups"])
            assert hashlib.sha256(written.encode()).hexdigest() == r["groups_sha256"]
        assert sum(p["n"] for p in r["pairs"]) == r["n_links"]


def test_linked_ids_are_suffixes(spark, documents):
    """What bounds the table of pairs that is sent to the tasks."""
    t = tables(None, None)
    for r in pair_counts(aligned(documents)).collect():
        x, y = t.a.bytes[r["a"]], t.b.bytes[r["b"]]
        assert x.endswith(y) or y.endswith(x)


def test_long_texts_and_edges(spark, odd_documents, no_documents):
    long = [(1, "word and more " * 120_000), (2, "日本語" * 100_000), (3, "a" + " " * 200_000 + "b"), (4, "\n" * 100_000)]
    got = {r["doc_id"]: r for r in align_tokenizers(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert all(r["n_groups"] > 0 for r in got.values()) and got[1]["n_a"] >= 360_000
    assert align_tokenizers(odd_documents).count() == odd_documents.count() and align_tokenizers(no_documents).count() == 0


def test_tokenizers_that_do_not_fit_raise():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        tables(public_tokenizers.path("word_bpe_49k.json"), None)
