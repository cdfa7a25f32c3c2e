"""Fast similarity sketches and the near-duplicates found with them, against brute force."""

import numpy as np
import pytest

from tallyforge.llm import minhash

DOCS = "doc_id long, text string"


def sketch(sets, t):
    return minhash.sketches(np.array([len(s) for s in sets]), np.concatenate([np.array(sorted(s), np.uint64) for s in sets]), t)


def test_every_coordinate_is_filled_and_a_sketch_follows_from_its_set_alone():
    rng = np.random.default_rng(1)
    sets = [set(rng.integers(0, 1 << 63, n).tolist()) for n in (1, 2, 3, 10, 100, 5000)]
    found = sketch(sets, 64)
    assert (found != minhash._EMPTY).all()
    for i, s in enumerate(sets):
        assert (sketch([s], 64)[0] == found[i]).all()
    assert (found[-1] >> np.uint64(32) == 0).all(), "a large set needs one round"


@pytest.mark.parametrize("n", [5, 60, 3000])
def test_equal_coordinates_estimate_likeness(n):
    rng = np.random.default_rng(n)
    shares = []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, 4 * n).tolist()
        x, y = sketch([set(both) | set(rng.integers(0, 1 << 63, n // 2 or 1).tolist()), set(both) | set(rng.integers(0, 1 << 63, n - n // 2).tolist())], 160)
        shares.append((x == y).mean())
    assert abs(np.mean(shares) - 0.8) < 0.02 and np.std(shares) < 0.08


def brute(rows, k, percent):
    sets = {}
    for i, (_, text) in enumerate(rows):
        words = (text or "").lower().split()
        sets[i] = frozenset(tuple(words[j : j + k]) for j in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])
    to = {i: i for i in sets}

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                to[root(i)] = root(j)
    least = {}
    for i in sets:
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted(((d, len(sets[i]), least[root(i)] if d is not None else None, least[root(i)] == d if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def families(rng, n):
    rows = []
    for _ in range(n):
        base = [f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 90))]
        for _ in range(rng.integers(1, 8)):
            words = list(base)
            for _ in range(rng.integers(0, 1 + len(words) // 12)):
                words[rng.integers(0, len(words))] = f"x{rng.integers(0, 1 << 30)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = families(np.random.default_rng(7), 60)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=2, percent=80).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 2, 80)


def test_chains_without_a_common_head_and_large_groups(spark):
    """Each text is near the next one only, so heads of buckets do not link them all; and many copies, exact and near."""
    words = [f"c{i}" for i in range(120)]
    chain = [(100 + i, " ".join(words[i : i + 60])) for i in range(0, 40)]
    copies = [(1000 + i, "the same text of some words here and there " * 3) for i in range(300)]
    near = [(5000 + i, " ".join([f"n{j}" for j in range(60)] + [f"own{i}"])) for i in range(300)]
    rows = chain + copies + near
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=2, percent=80).collect()}
    assert {d: c for d, (c, _) in got.items()} == {d: c for d, _, c, _ in brute(chain, 2, 80)} | {d: 1000 for d, _ in copies} | {d: 5000 for d, _ in near}
    assert sum(k for _, k in got.values()) == len({c for c, _ in got.values()})


def test_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "A  B"), (3, "a"), (4, "A"), (5, ""), (6, None), (7, " \n"), (None, "a b"), (None, None)]
    frame = spark.createDataFrame([(*r, "x", 9) for r in rows], DOCS + ", component_id string, n_shingles long")
    got = sorted((tuple(r) for r in minhash.near_duplicates(frame, shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (None, 1, None, None), (None, 0, None, None)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_heads_beyond_the_broadcast_limit(spark, monkeypatch):
    rows = families(np.random.default_rng(3), 15)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr("tallyforge.llm.components.BROADCAST_ROWS", 0)
    monkeypatch.setattr("tallyforge.llm.jaccard_join.BROADCAST_IDS", 0)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=2, percent=80).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 2, 80)


def test_bitmaps_lose_no_link():
    rng = np.random.default_rng(5)
    for n in (3, 40, 900):
        both, x, y = (rng.integers(0, 1 << 63, m).astype(np.uint64) for m in (n, n // 9, n // 8))
        bits = [minhash.parity(np.r_[both, own]) for own in (x, y)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(x) + len(y)


@pytest.mark.parametrize("block", [4096, 7])
def test_pairs_of_a_bucket_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, 50, replace=False), rng.integers(0, 1 << 63, rng.integers(0, 9)).astype(np.uint64)]) for _ in range(50)]
    rows = [(7, 2, i, len(s), minhash.parity(s).tolist(), [0] * 5, i // 4) for i, s in enumerate(sets)]
    posts = spark.createDataFrame(rows, "band long, place int, cls long, n long, bits array<long>, bytes array<long>, component long")
    got = {(r["a"], r["b"]) for r in minhash.pairs_of_buckets(posts.drop("n", "bits", "bytes"), posts.union(posts).select("cls", "n", "bits", "bytes"), 80).collect()}
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    every = {(i, j) for i in range(50) for j in range(i + 1, 50) if i // 4 != j // 4}
    links = {(i, j) for i, j in every if 100 * both(i, j) >= 80 * (len(sets[i]) + len(sets[j]) - both(i, j))}
    assert links and links <= got < every
