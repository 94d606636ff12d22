import random

import numpy as np
import pyarrow as pa
import pytest

from veriparity.llm import graph, minhash, vector_links
from veriparity.llm.common import word_codes


def smallest_reachable(points, links):
    root = {p: p for p in points}
    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {p: find(p) for p in points}


@pytest.mark.parametrize("shape", ["path", "star", "random", "cliques", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    links = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(50, i) for i in range(100)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)],
        "cliques": [(i, j) for k in range(5) for i in range(k * 10, k * 10 + 8) for j in range(k * 10, i)],
        "none": [],
    }[shape]
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    links = [(a, b) for a, b in links if a != b]
    assert {r["id"]: r["component"] for r in got} == smallest_reachable({x for l in links for x in l}, links)


def test_local_roots():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    assert graph.local_roots(300, a, b).tolist() == list(smallest_reachable(range(300), zip(a.tolist(), b.tolist(), strict=True)).values())


def brute_vectors(rows, threshold=0.9):
    ok = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold]
    roots = smallest_reachable([i for i, _ in rows], links)
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], roots[i], roots[i] == i) for i, _ in rows}


def vectors():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] * rng.uniform(0.5, 2) + rng.standard_normal(16) * 0.35).tolist()) for i in range(240)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(400, [0.0] * 16), (401, None), (402, []), (403, [None] + [1.0] * 15)]
    rows += [(404, [float("nan")] + [1.0] * 15), (405, [float("inf")] + [1.0] * 15), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (408, [-0.0, 0.0])]
    return rows


def test_vector_links(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rep string, links int")
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_vectors(rounded)
    for block in (1024, 16):  # the second cuts buckets into many blocks
        monkeypatch.setattr(vector_links, "BLOCK", block)
        got = vector_links.vector_links(df, recall=0.999999).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == want
    assert vector_links.vector_links(df.limit(0)).count() == 0


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (8, [2.0, 0.1]), (9, [0.0, 1.0])]
    got = sorted(map(str, (tuple(r) for r in vector_links.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())))
    assert got == sorted(map(str, [(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (8, 3, 3, False), (9, 0, 9, True)]))


def sets(texts, size):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def brute_documents(rows, size, percent):
    s = sets([t for _, t in rows], size)
    links = []
    for i in range(len(rows)):
        for j in range(i):
            common = len(s[i] & s[j])
            if common and 100 * common >= percent * len(s[i] | s[j]):
                links.append((rows[i][0], rows[j][0]))
    roots = smallest_reachable([i for i, _ in rows], links)
    return {i: (len(x), roots[i], roots[i] == i) for (i, _), x in zip(rows, s, strict=True)}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80), (1, 50)])
def test_near_duplicates(documents, texts, size, percent):
    got = minhash.near_duplicates(documents, size, percent).collect()
    want = brute_documents([(i * 3 + 1, t) for i, t in enumerate(texts)], size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_chains_across_components_are_found(spark, monkeypatch):
    """Texts that drift: each is near the next, far from the first, so stars alone don't join them."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[rng.randrange(150)] = f"n{i}"
        words[rng.randrange(150)] = f"m{i}"
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_documents(rows, 3, 85)


def test_intersections_are_counted_whole(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 90, n)) for n in (0, 1, 5, 40, 80, 33)]
    counts = minhash.common_counts(pa.array([s.tolist() for s in sets], pa.list_(pa.int64())))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert i == j or counts[i, j] == len(np.intersect1d(x, y))


def test_bands_miss_next_to_nothing():
    for percent in (50, 80, 85, 95):
        r = minhash.band_length(percent)
        assert r == 1 or (1 - (percent / 100) ** r) ** (minhash.REGISTERS // r) < minhash.MISSED


def test_signatures_estimate_likeness():
    """Each register is uniform over the union, so agreement estimates the Jaccard similarity."""
    rng = np.random.default_rng(3)
    errors = []
    for trial in range(60):
        n = (5, 40, 900)[trial % 3]
        x = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = np.sort(x[: int(1.5 * n)]), np.sort(x[int(0.5 * n) :])
        sig = minhash.signatures([a, b])
        assert (sig < 2**63).all()
        errors.append((sig[0] == sig[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    alone = minhash.signatures([a])
    assert (alone[0] == minhash.signatures([b, a, a[:1]])[1]).all()


def test_registers_are_visited_once_by_each_shingle():
    """One shingle fills every register, in an order without repeats: values have every whole part once."""
    sig = minhash.signatures([np.array([12345], np.uint64)], 16)
    assert sorted((sig[0] >> np.uint64(52)).tolist()) == list(range(16))


def test_short_texts_and_case():
    a, b, c, d = minhash.shingle_sets([b"One Two", b"one two", b"", b"one"], 3, word_codes())
    assert a.tolist() == b.tolist() and len(c) == 0 and len(d) == 1 and d[0] != a[0]


def test_edges(odd_documents, no_documents):
    got = minhash.near_duplicates(odd_documents)
    assert got.count() == odd_documents.count()
    by = {(r["doc_id"], r["n_shingles"]): r for r in got.collect()}
    assert by[1, 76]["component_id"] == 1 and by[9, 77]["component_id"] == 1 and not by[9, 77]["kept"]
    assert by[None, 76]["component_id"] == 1 and by[None, 0]["component_id"] is None and by[None, 0]["kept"] and by[7, 0]["kept"]
    kept = minhash.keep_first(odd_documents)
    assert kept.columns == odd_documents.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "1", "7", "None", "None"]
    assert minhash.near_duplicates(no_documents).count() == 0 and minhash.keep_first(no_documents).count() == 0
