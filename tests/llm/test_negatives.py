import math

import numpy as np
import pytest

from veriparity.llm.negatives import (
    Best, Side, block_bounds, far_apart, hard_negatives, integers, pair_bounds, scores_of, windows_of,
)

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256):
    sound = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound.append((i, label, [math.floor(scale * x) for x in v]))
    out = []
    for a, label, v in sound:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, k) for i, k, w in sound if i != a and len(w) == len(v)]
        for p, positive, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            inside = sorted(x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p)
            for rank, (n, negative, _) in enumerate(inside[:negatives], 1):
                out.append((a, positive, rank, negative, -p, -n))
    return sorted(out)


def rows_like(seed, n=600, dim=12, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, dim))
    return [(i, int(rng.integers(0, 4)), (centres[i % 9] + spread * rng.standard_normal(dim)).round(2).tolist()) for i in range(n)]


def mined(df, **more):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in names) for r in hard_negatives(df, **more).collect())


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.6), (2, 0.05), (3, 5.0)])
def test_against_brute_force(spark, seed, spread):
    rows = rows_like(seed, spread=spread)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS norm", "1 AS v", "2 AS cell", "3 AS rank").repartition(5)
    got = mined(df)
    assert got == brute(rows) and len(got) > 20
    assert mined(df, references=2, sample_rows=3, every=10, positives=2, negatives=4, low=20, high=60) == brute(rows, 10, 2, 4, 20, 60)


def test_many_rounds_give_the_same(spark):
    rows = rows_like(4)
    assert mined(spark.createDataFrame(rows, SCHEMA), every=2, round_bytes=1) == brute(rows, every=2)


def test_ties_copies_and_hot_groups(spark):
    """A third of the rows are one vector, with few labels; many scores are equal."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, [1.0, 0.5, 0.0]) for i in range(0, 900, 3)]
    rows += [(i, i % 2, [float(x) for x in rng.integers(0, 2, 3)]) for i in range(1, 900, 3)]
    rows += [(i, 5, (rng.integers(0, 4, 3) / 4).tolist()) for i in range(2, 900, 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert mined(df) == brute(rows)


def test_odd_rows(spark):
    rows = rows_like(8, 200, 4)
    rows += [(None, 1, [1.0] * 4), (700, None, [1.0] * 4), (750, 1, None), (800, 1, [1.0, None, 1.0, 1.0]), (850, 1, [float("nan")] * 4), (900, 2, [float("inf")] * 4)]
    rows += [(950, 1, [0.0] * 4), (1000, 1, []), (1001, 1, []), (1002, 2, []), (1050, 2, [1.0, 2.0]), (1051, 2, [1.0, 2.1]), (1052, 1, [1.0, 1.5]), (-50, 3, [0.5] * 4), (1100, 1, [-1.0] * 4)]
    rows += [(3, 1, [0.7] * 4), (3, 1, [0.7] * 4), (1150, 9, [0.1] * 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df) == brute(rows)
    assert hard_negatives(df.limit(0)).count() == 0 and hard_negatives(df.where("vec_id = 3")).count() == 0
    assert [r["vec_id"] for r in integers(spark.createDataFrame([(1, 1, [2.0**23]), (2, 1, [2.0**22])], SCHEMA), 256).collect()] == [2]


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [2.0**21 + i / 256, 2.0**22 - i * 7 / 256, float(i)]) for i in range(150)]
    assert mined(spark.createDataFrame(rows, SCHEMA), low=90, high=100) == brute(rows, low=90, high=100)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for spread in (0.01, 1.0, 100.0):
        v = np.floor(256 * (rng.standard_normal((1, 8)) + spread * rng.standard_normal((120, 8)))).astype(np.int64)
        v[3] = 0
        v[4] = -v[5]
        v[6] = v[7]
        refs = far_apart(v[:50].astype(float), 6)
        norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))
        u = v / np.where(norms > 0, norms, 1)[:, None]
        sides = []
        for part in (slice(0, 40), slice(40, 120)):
            side = object.__new__(Side)
            side.v, side.norms = v[part].astype(float), norms[part]
            side.angles = np.arccos(np.clip(u[part] @ refs.T, -1, 1)).astype(np.float32)
            side.ids = side.labels = np.arange(120)[part]
            sides.append(side)
        a, b = sides
        exact = v[:40] @ v[40:].T
        low, high = pair_bounds(a, np.arange(40), b)
        assert (low <= exact).all() and (exact <= high).all()
        low, high = block_bounds(a, b)
        assert (low[:, None] <= exact).all() and (exact <= high[:, None]).all()
        assert (scores_of(a.v, b.v, 1.0) == exact).all() and (scores_of(a.v, b.v, 2.0**60) == exact).all()


def test_the_filter_rules_out():
    """Far clusters are ruled out as blocks, so most pairs are never multiplied."""
    rng = np.random.default_rng(7)
    centres = np.eye(10) * 40
    v = np.floor(256 * (centres[np.arange(500) // 50] + rng.standard_normal((500, 10))))
    refs = far_apart(v, 16)
    norms = np.sqrt((v**2).sum(axis=1))
    angles = np.arccos(np.clip((v / norms[:, None]) @ refs.T, -1, 1)).astype(np.float32)
    a, b = object.__new__(Side), object.__new__(Side)
    for side, part in ((a, slice(0, 50)), (b, slice(50, 500))):
        side.v, side.norms, side.angles, side.ids = v[part], norms[part], angles[part], np.arange(500)[part]
    _, high = pair_bounds(a, np.arange(50), b)
    assert (high < 0.5 * norms[:50, None] * norms[None, 50:]).mean() > 0.9


def test_windows():
    scores = np.array([0, 1, 7, 99, 100, 12345, -1, -250, 2**61 + 3])
    low, high = windows_of(scores, 50, 95)
    for s, x, y in zip(scores.tolist(), low.tolist(), high.tolist(), strict=True):
        assert 100 * x >= 50 * s > 100 * (x - 1) and 100 * y <= 95 * s < 100 * (y + 1)


def test_best():
    rng = np.random.default_rng(2)
    best, all_rows = Best(5, 3), []
    for _ in range(6):
        group, score, ids = rng.integers(0, 5, 40), rng.integers(-3, 3, 40), rng.integers(0, 30, 40)
        best.add(group, score, ids)
        all_rows += zip(group.tolist(), (-score).tolist(), ids.tolist(), strict=True)
    want = [x for g in range(5) for x in sorted(r for r in all_rows if r[0] == g)[:3]]
    assert [(g, -s, i) for g, s, i in zip(*(x.tolist() for x in best.rows()), strict=True)] == want
