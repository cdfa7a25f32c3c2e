"""Pivotal grams and spelling variants, against brute force."""

import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import spelling

WORDS = "word string, n long"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


@given(st.text("abé", min_size=4, max_size=14), st.data())
@settings(max_examples=400, deadline=None)
def test_a_pivot_of_one_word_stands_in_the_prefix_of_the_other(r, data):
    at, letter, kind = data.draw(st.integers(0, len(r) - 1)), data.draw(st.sampled_from("abéz")), data.draw(st.integers(0, 2))
    s = r[:at] + ("" if kind == 0 else letter) + r[at + (kind != 1) :]
    if s == r or len(s) < 4:
        return
    grams = sorted({spelling.gram_class(w[i : i + 2]) for w in (r, s) for i in range(len(w) - 1)})
    random.Random(r).shuffle(grams)
    rank = {g: i for i, g in enumerate(grams)}
    prefixes = [spelling.prefix_of(w, rank) for w in (r, s)]
    lasts = [p[-1][0] for p in prefixes]
    x, y = (0, 1) if lasts[0] <= lasts[1] else (1, 0)
    gap = len((r, s)[y]) - len((r, s)[x])
    shifts = {0: {0}, 1: {0, 1}, -1: {0, -1}}[gap]
    pivots = spelling.pivots_of(prefixes[x], list(range(len(rank))))
    assert len(pivots) == 2 and abs(pivots[0][1] - pivots[1][1]) >= 2
    assert any((g, place + d) in prefixes[y] for g, place in pivots for d in shifts)


def test_pivots_are_the_lightest_disjoint_pair():
    rng = random.Random(2)
    for _ in range(300):
        prefix = [(i, p) for i, p in enumerate(rng.sample(range(9), rng.randint(3, 6)))]
        weight = [rng.randint(1, 50) for _ in prefix]
        pairs = [(weight[a[0]] + weight[b[0]]) for a in prefix for b in prefix if b[1] - a[1] >= 2]
        if pairs:
            assert sum(weight[g] for g, _ in spelling.pivots_of(prefix, weight)) == min(pairs)


def brute(words, ratio=5):
    near = {w: [(-m, v) for v, m in words.items() if one_edit(w, v)] for w in words}
    form = {w: (min(near[w])[1] if near[w] and -min(near[w])[0] >= ratio * n else None) for w, n in words.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=str)


@pytest.mark.parametrize("block", [4096, 3])
def test_variants_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    if block == 3:
        monkeypatch.setattr(spelling, "BROADCAST_ROWS", 0)
    rng = random.Random(block)
    words = {}
    for _ in range(120):
        w = "".join(rng.choice("abcdeéß") for _ in range(rng.randint(4, 9)))
        words[w] = rng.randint(1, 3000)
        for _ in range(4):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]])
            if len(v) >= 4:
                words.setdefault(v, rng.randint(1, 400))
    words |= {"chainaaa": 2, "chainaab": 20, "chainabb": 200, "a" * 40: 3, "a" * 41: 90, "a" * 39 + "b": 7, "𝔞𝔟𝔠𝔡𝔢": 1, "𝔞𝔟𝔠𝔡": 9}
    got = spelling.group_variants(spark.createDataFrame(list(words.items()), WORDS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(words)
    assert max(r["n_near"] for r in got) > 1 and sum(r["root"] != (r["form"] or r["word"]) for r in got) > 0


def test_counts_equal_brute_force_and_one_letter_goes(spark):
    docs = [(i, f"Zebrafish zebra-fish, ÉCOLES écoles×{i} naïveté quick brown " * 3) for i in range(150)] + [(150, None), (151, ""), (None, "quickly " * 7)]
    want = {}
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", "".join(c.lower() if c.isascii() else c for c in text or "")):
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 19 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] = want.get(run, 0) + 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(frame, one_in=19).collect()} == want
    assert "zebrafish" in want and "zebrafsh" not in {r["word"] for r in spelling.word_counts(frame).collect()}


def test_odd_words(spark):
    frame = spark.createDataFrame([(None, 5, 1), ("abc", 9, 1), ("", 1, 1), ("abcd", None, 1), ("abcde", 2, 1), ("abcdf", 10, 1), ("abcdg", 10, 1)], WORDS + ", root int")
    assert sorted(tuple(r) for r in spelling.group_variants(frame).collect()) == [("abcde", "abcdf", "abcdf", 2, 2, 10), ("abcdf", None, "abcdf", 10, 2, None), ("abcdg", None, "abcdg", 10, 2, None)]
    assert spelling.group_variants(spark.createDataFrame([], WORDS)).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        spelling.group_variants(frame, ratio=1)
