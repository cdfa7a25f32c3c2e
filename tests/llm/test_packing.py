"""Packing: token ids as the tokenizer gives them, fillings against brute force, and a search that beats best-fit."""

from collections import Counter
from itertools import combinations, islice

import numpy as np

from tallyforge.llm import packing


def test_ids_are_those_of_the_tokenizer_as_dealt():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encode = Tokenizer.from_file(path), packing._encoder(path)
    rng = np.random.default_rng(1)
    alphabet = [*"abc XYZ12'’éß日\n\t _.,!<>|", "<|endoftext|>", "'s", " the", " ", "🎉", "<|endoftext", "\r\n"]
    for _ in range(2000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids, text
    assert encode("a<|endoftext|>b")[1] == 50256


def test_added_tokens_count_in_the_pieces(spark):
    rows = packing.pieces(spark.createDataFrame([(1, "<|endoftext|>" * 3)], "doc_id long, text string")).collect()
    assert [r["length"] for r in rows] == [4]


def test_fillings_are_undominated_and_fullest_first():
    rng = np.random.default_rng(2)
    for _ in range(300):
        room = int(rng.integers(1, 30))
        counts = Counter(rng.integers(1, 20, rng.integers(0, 9)).tolist())
        pieces = sorted(counts.elements())
        every = {c for n in range(len(pieces) + 1) for c in combinations(pieces, n) if sum(c) <= room}
        got = [tuple(sorted(f)) for f in islice(packing.fillings(counts, room), 50)]
        assert len(set(got)) == len(got) and set(got) <= every
        assert sum(got[0]) == max(map(sum, every))
        sums = [sum(f) for f in got]
        assert sums == sorted(sums, reverse=True)
        if got[0] == (room,):
            continue
        # what is left out is dominated: a piece outside could take the place of one or two inside
        for f in every - set(got) - {()}:
            spare = counts - Counter(f)
            places = [*f, *(a + b for a, b in combinations(f, 2))]
            assert any(p < s <= p + room - sum(f) for s in spare for p in places) or any(s <= room - sum(f) for s in spare), (f, got)


def fewest(pieces, capacity):
    """Fewest sequences, by the best way to reach each set of pieces."""
    best = {0: (1, 0)}
    for mask in range(1, 1 << len(pieces)):
        ways = []
        for i, s in enumerate(pieces):
            if mask >> i & 1:
                n, held = best[mask ^ 1 << i]
                ways.append((n, held + s) if held + s <= capacity else (n + 1, s))
        best[mask] = min(ways)
    return best[(1 << len(pieces)) - 1][0]


def test_the_exact_search_equals_brute_force():
    rng = np.random.default_rng(6)
    gained = 0
    for low, high in [(3, 50), (20, 60), (25, 45), (10, 35)] * 6:
        pieces = rng.integers(low, high, 12).tolist()
        made = packing.pack_histogram(Counter(pieces), 100, exact=True)
        held = Counter()
        for pattern, n in made:
            assert sum(pattern) <= 100
            for s in pattern:
                held[s] += n
        assert held == Counter(pieces) and sum(n for _, n in made) == fewest(pieces, 100)
        gained += sum(n for _, n in packing.best_fit(Counter(pieces), 100)) > fewest(pieces, 100)
    assert gained


def test_the_search_beats_best_fit():
    pieces = Counter([323, 421, 438, 483, 495, 503, 529, 559, 561, 568, 601, 672, 993, 1023])
    assert sum(n for _, n in packing.best_fit(dict(pieces), 2048)) == 5
    made = packing.pack_histogram(pieces, 2048)
    held = Counter()
    for pattern, n in made:
        assert sum(pattern) <= 2048
        for s in pattern:
            held[s] += n
    assert held == pieces and sum(n for _, n in made) == 4
