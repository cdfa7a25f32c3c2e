"""Fingerprints: order and repeated rows against a plain loop, and blocks of long lists."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import components, jaccard_join, shingles, spotsigs

LOWEST = -(1 << 63)


def edited(t, following):
    return t[: len(t) - len(t) // 2] + following[: len(t) // 2]


@pytest.mark.parametrize(("repeated", "ranges"), [(1000, 4), (3, 1), (1, 7)])
def test_next_documents_of_sparse_null_and_repeated_ids(spark, monkeypatch, repeated, ranges):
    monkeypatch.setattr(spotsigs, "REPEATED", repeated)
    monkeypatch.setattr(spotsigs, "RANGES", ranges)
    rng = np.random.default_rng(repeated)
    ids = [int(x) for x in rng.integers(-(1 << 60), 1 << 60, 60)] + [7, 7, 7] + [None] * 9
    rows = [(i, f"the text {k} of a word{k % 5} and so on {'x' * (k % 11)}") for k, i in enumerate(ids)]
    rows += [(None, "all one and the same text here")] * 40 + [(9, "again the one")] * 5 + [(10, None), (11, "")]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, id long, h string")
    hashed = {r["text"]: r["h"] for r in docs.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(((LOWEST if i is None else i, hashed[t or ""], i, t or "") for i, t in rows), key=lambda r: r[:2], reverse=True)
    want = Counter((i, hashlib.sha256(edited(t, n[3]).encode()).hexdigest()) for (_, _, i, t), n in zip(order, order[1:] + order[:1], strict=True))
    got = spotsigs.fingerprints_with_next(docs).collect()
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 30}) >= 1 and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)


def test_texts_move_once_and_no_python_runs(spark):
    plan = spotsigs.fingerprints_with_next(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "ExistingRDD", "MapIn"))
    physical = plan[plan.index("== Physical Plan") :]
    assert physical.count("Exchange hashpartitioning(range") == 1 and "Exchange SinglePartition" not in physical


def test_all_pairs_across_components_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(k, int(c), int(c) % 4, int(rng.integers(1, 9))) for k in range(5) for c in rng.choice(1000, 3 + 13 * k, replace=False)]
    rows += [(9, c, 1, 3) for c in range(2000, 2030)]
    posts = spark.createDataFrame(rows, "list long, cls long, component long, n long")
    got = {tuple(r) for r in components.pairs_across(posts, ["list"], "abs(a_n - b_n) <= 2").select("a", "b").collect()}
    want = {(min(x[1], y[1]), max(x[1], y[1])) for x in rows for y in rows if x[0] == y[0] and x[1] != y[1] and x[2] != y[2] and abs(x[3] - y[3]) <= 2}
    assert got == want


def test_sets_that_clash_in_their_name_go_by_a_second(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, jaccard_join.jaccard_components(docs, shingle=4, percent=85).collect()))
    classes, nodes, clashes = jaccard_join._named_sets(docs, 4)
    assert not clashes
    some = frozenset(r["cls"] for r in nodes.select("cls").collect() if r["cls"] % 3 == 0)
    found = jaccard_join._classes(docs, 4, some)
    seconds = {r["doc_id"]: r["other"] for r in found.collect()}
    renamed = {r["doc_id"]: r["cls"] for r in found.collect()}
    assert all(renamed[r["doc_id"]] == (seconds[r["doc_id"]] if r["cls"] in some else r["cls"]) for r in classes.where("cls is not null").collect())

    original = jaccard_join._classes
    monkeypatch.setattr(jaccard_join, "_classes", lambda d, k, c: original(d, k, c | some))
    lists, verified = jaccard_join._lists, jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_lists", lambda d, k, p, b, f, c: lists(d, k, p, b, f, c | some))
    monkeypatch.setattr(jaccard_join, "_verified", lambda p, d, n, k, t, c: verified(p, d, n, k, t, c | some))
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs, shingle=4, percent=85).collect())) == want
    one = np.array([1, 2], np.uint64)
    assert shingles.set_class(one, frozenset([shingles.set_names(one)[0]])) == shingles.set_names(one)[1]


def test_signatures_of_one_set_alone_are_not_ranked(spark, monkeypatch):
    plans, real = {}, spotsigs.written

    def keep(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(spotsigs, "written", keep)
    rows = [(1, "the red house and the old barn"), (2, "the red house and the old barn by a lake shore"), (3, "a quiet road to the far hill"), (4, None), (5, "the red house and the old barn")]
    got = {r["doc_id"]: r["component_id"] for r in spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5] == 1 and got[3] == 3 and got[4] == 4
    # the number of sets of a signature is looked at before its rows are joined and sorted
    joined = plans["lanes"].rindex("Join Inner")
    assert any("Filter" in line and "> 1" in line for line in plans["lanes"][joined:].splitlines()), plans["lanes"]
