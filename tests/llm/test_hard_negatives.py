"""Hard negatives against brute force, and what the tree leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import hard_negatives as hn

ROWS = "vec_id long, label int, vector array<double>"


def brute(rows, anchor, positives=5, negatives=5, least=80):
    size = max((len(v) for _, _, v in rows), default=0)
    points = {}
    for i, label, v in rows:
        q = [int(np.floor(256 * x)) for x in v] + [0] * (size - len(v))
        points.setdefault(i, []).append((label, q))
    kind = "<i2" if all(256 * abs(x) < 32767 for _, _, v in rows for x in v) else "<f8"
    points = {i: min(c, key=lambda c: (c[0], np.array(c[1], np.float64).astype(kind).tobytes())) for i, c in points.items()}
    found = []
    for a, (label, q) in points.items():
        if not anchor(a):
            continue
        scores = {i: sum(x * y for x, y in zip(q, p, strict=True)) for i, (_, p) in points.items()}
        order = sorted((i for i in points if i != a), key=lambda i: (-scores[i], i))
        for p in [i for i in order if points[i][0] == label][:positives]:
            hard = [i for i in order if points[i][0] != label and least * scores[p] <= 100 * scores[i] <= 100 * scores[p]][:negatives]
            found += [(a, p, r, i, scores[p], scores[i]) for r, i in enumerate(hard, 1)]
    return sorted(found)


def clustered(rng, n, dims, centres):
    middle = rng.normal(size=(centres, dims))
    made = [(int(i), int(rng.integers(0, 3)), (middle[rng.integers(0, centres)] + 0.2 * rng.normal(size=dims)).tolist()) for i in range(n)]
    hot = made[5][2]
    return made + [(n + i, i % 3, hot) for i in range(n // 3)] + [(2 * n + i, 1, [round(x, 1) for x in made[i][2]]) for i in range(20)]


@pytest.mark.parametrize(("part", "sample", "scale"), [(1024, 20_000, 1), (16, 200, 1), (16, 200, 1e5), (8, 5, 500)])
def test_mined_rows_equal_brute_force(spark, monkeypatch, part, sample, scale):
    monkeypatch.setattr(hn, "PART", part)
    monkeypatch.setattr(hn, "SAMPLE", sample)
    rows = clustered(np.random.default_rng(part), 240, 6, 9)
    rows = [(i, label, [x * scale for x in v]) for i, label, v in rows]
    got = hn.mine(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i % 10 == 0) and got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.9]), (2, 2, [0.9, 0.1]), (3, 1, [0.7, 0.7]), (4, 2, [0.8, 0.2, 0.1]), (4, 1, [9.0]), (5, 2, []), (10, 3, [1.0, 1.0]), (20, 1, [-1.0, -1.0]), (20, 1, [-1.0, -1.0]), (30, 7, [0.0])]
    bad = [(None, 1, [1.0]), (40, None, [1.0]), (50, 1, None), (60, 1, [1.0, None]), (70, 1, [nan]), (80, 2, [inf, 1.0]), (90, 2, [-inf]), (100, 2, [1e307])]
    frame = spark.createDataFrame([(*r, 5, 5) for r in rows + bad], ROWS + ", rank int, anchor_id long")
    got = sorted(tuple(r) for r in hn.mine(frame, F.col("vec_id") % 10 == 0).collect())
    assert got == brute(rows, lambda i: i % 10 == 0) and {r[0] for r in got} >= {0}
    assert hn.mine(spark.createDataFrame([], ROWS), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.mine(spark.createDataFrame(bad, ROWS), F.col("vec_id") % 10 == 0).count() == 0


def test_a_score_beyond_a_long_is_an_error(spark):
    frame = spark.createDataFrame([(0, 1, [1e12]), (1, 1, [1e12]), (2, 2, [1e12])], ROWS)
    with pytest.raises(Exception, match="(?i)overflow|too large|int"):
        hn.mine(frame, F.col("vec_id") == 0).collect()


def test_rings_lose_nothing_and_leave_out_siblings():
    rng = np.random.default_rng(4)
    x = np.floor(256 * np.array([v for _, _, v in clustered(rng, 3000, 8, 30)]))
    most = float((x * x).sum(axis=1).max())
    up = hn.lifted(x, most)
    tree = hn.fit(up[:500], 20)
    ranges: dict = {}
    leaf = hn.leaves_of(tree, up, ranges)
    for at, _ in tree.nodes:
        tree.low.append(np.full((len(at), len(at)), np.inf))
        tree.high.append(np.full((len(at), len(at)), -np.inf))
    for (k, i, j), (low, high) in ranges.items():
        tree.low[k][i, j], tree.high[k][i, j] = low, high
    q = x[::97]
    scores = q @ x.T
    high = np.sort(scores, axis=1)[:, -20:-19]
    low = np.ceil(0.8 * high)
    reached = np.zeros((len(q), tree.leaves), bool)
    for k, rows in hn.reached(tree, q, *hn.annuli((q * q).sum(axis=1), low, high, most), most):
        reached[rows, k] = True
    inside = (scores >= low) & (scores <= high)
    assert inside.sum() > len(q) and reached[np.nonzero(inside)[0], leaf[np.nonzero(inside)[1]]].all()
    assert len(set(leaf)) > 20 and reached.mean() < 0.5, reached.mean()
