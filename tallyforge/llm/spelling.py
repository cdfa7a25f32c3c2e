"""Spelling variants: words one edit apart, found by pivotal grams.

Bigrams are ordered from rare to frequent. A word's prefix holds its bigrams up to the
third in that order (all occurrences of the last one too), and its two pivots are disjoint
bigrams of the prefix, chosen by dynamic programming for the shortest lists. One edit
touches at most one of two disjoint bigrams, so if the prefix of r ends no later than that
of s and the words are one edit apart, a pivot of r stands in s, in the prefix of s, and at
a place that follows from their lengths: the same in words of equal length, the same or one
further in a longer word, the same or one before in a shorter one. So pivots are looked up
by bigram, place and length, and what they meet is verified by edit distance.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import BROADCAST_ROWS
from .store import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a word is made of.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: The shortest words whose prefix always has two disjoint bigrams.
SHORTEST = 4
#: Bigrams are told apart by their CRC-32 modulo this, which bounds the order that is broadcast; bigrams that share a class only meet more words.
CLASSES = 1 << 20
#: Entries of one list that are looked up in one task.
BLOCK = 4096
#: A form occurs at least this many times as often as its variant.
RATIO = 5


def runs(text: Column) -> Column:
    """All maximal runs of letters, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LETTERS), F.lit(0))


def thinned(doc_id: Column, run: Column, one_in: int) -> Column:
    """The run, less one letter where ``one_in`` divides the CRC-32 of doc_id:run; a run of a row without doc_id stays."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, *, shortest: int = 6, least: int = 5, one_in: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> (word, n): words of so many code points that occur so often in all whole texts. one_in: see thinned()."""
    each = docs.select("doc_id", F.explode(runs(F.col("text").cast("string"))).alias("run")).where(F.char_length("run") >= shortest)
    word = thinned(F.col("doc_id"), F.col("run"), one_in) if one_in else F.col("run")
    return each.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def gram_class(gram: str) -> int:
    return zlib.crc32(gram.encode()) % CLASSES


def prefix_of(word: str, rank: dict[int, int]) -> list[tuple[int, int]]:
    """(rank, place) of the word's prefix: its bigrams up to the third in the order of their classes' ranks, ties with that included."""
    grams = sorted((rank[gram_class(word[i : i + 2])], i) for i in range(len(word) - 1))
    last = grams[min(2, len(grams) - 1)][0]
    return [g for g in grams if g[0] <= last]


def pivots_of(prefix: list[tuple[int, int]], weight: list[int], many: int = 2) -> list[tuple[int, int]]:
    """So many pairwise disjoint bigrams of the prefix of least total weight (of the ranks), by dynamic programming over their places."""
    grams = sorted(prefix, key=lambda g: g[1])
    places = [place for _, place in grams]
    before = [bisect_right(places, place - 2) - 1 for place in places]
    best: list[list[tuple[float, tuple[int, ...]]]] = [[(0, ())] * (len(grams) + 1)]
    for _ in range(many):
        row: list[tuple[float, tuple[int, ...]]] = [(float("inf"), ())]
        for i, g in enumerate(grams):
            cost, chosen = best[-1][before[i] + 1]
            row.append(min(row[-1], (cost + weight[g[0]], (*chosen, i))))
        best.append(row)
    return [grams[i] for i in best[-1][-1][1]]


def _keyed(words: DataFrame, ranks: DataFrame) -> DataFrame:
    """(pivot, gram, place, size, last, word, n): where a word's prefix can be met, and where its pivots look. gram is a rank; ranks has at most CLASSES rows."""
    table = words.sparkSession.sparkContext.broadcast([(r["gram"], r["df"]) for r in ranks.collect()])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {g: i for i, (g, _) in enumerate(table.value)}
        weight = [n for _, n in table.value]
        for batch in batches:
            rows = []
            for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size, prefix = len(word), prefix_of(word, rank)
                last = prefix[-1][0]
                rows += [(False, g, place, size, last, word, n) for g, place in prefix]
                for g, place in pivots_of(prefix, weight):
                    rows += [(True, g, place + d, size + s, last, word, n) for s, d in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))]
            kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["pivot", "gram", "place", "size", "last", "word", "n"])

    return words.select("word", "n").mapInArrow(keys, "pivot boolean, gram int, place int, size int, last int, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n), each word once and of four code points or more -> distinct (a, a_n, b, b_n), a < b: words exactly one edit apart.

    The order of bigrams is broadcast, at most CLASSES numbers. A list of more than BLOCK entries is cut into parts, and
    what looks it up goes to every part, so no task has a whole long list.
    """
    grams = words.select(F.explode(F.expr(f"transform(sequence(1, char_length(word) - 1), i -> crc32(cast(substring(word, i, 2) as binary)) % {CLASSES})")).alias("gram"))
    ranks = written(grams.groupBy("gram").agg(F.count("*").alias("df")), "ranks")
    keyed = written(_keyed(words, ranks.orderBy("df", "gram")), "keyed")
    key = ["gram", "place", "size"]
    lists = keyed.where("not pivot")
    long = written(lists.groupBy(*key).agg(F.count("*").alias("entries")).where(F.col("entries") > BLOCK).select(*key, F.ceil(F.col("entries") / BLOCK).cast("int").alias("parts")), "long")
    few = long.count() <= BROADCAST_ROWS
    cut = lambda df: df.join(F.broadcast(long) if few else long, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = cut(keyed.where("pivot")).select(*key, F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("word").alias("x"), F.col("n").alias("x_n"), F.col("last").alias("x_last"))
    y = cut(lists).select(*key, F.expr("cast(pmod(xxhash64(word), parts) as int)").alias("part"), F.col("word").alias("y"), F.col("n").alias("y_n"), F.col("last").alias("y_last"))
    met = x.join(y, [*key, "part"]).where("x_last <= y_last and x <> y and levenshtein(x, y, 1) = 1")
    first = F.col("x") < F.col("y")
    pair = [F.when(first, F.col(p)).otherwise(F.col(q)).alias(name) for p, q, name in (("x", "y", "a"), ("x_n", "y_n", "a_n"), ("y", "x", "b"), ("y_n", "x_n", "b_n"))]
    found = written(met.select(*pair).distinct(), "near")
    discard(ranks, keyed, long)
    return found


def roots(links: DataFrame) -> DataFrame:
    """links (word, form) -> (word, root): forms followed to the last.

    Each round doubles the steps; forms occur RATIO times as often at every step, so a
    chain has at most log(n) steps and few rounds are needed.
    """
    to = written(links.select("word", F.col("form").alias("root")), "roots")
    few = to.count() <= BROADCAST_ROWS
    while True:
        via = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = to.join(F.broadcast(via) if few else via, "root", "left")
        before, to = to, written(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(before)
        if to.where("moved").isEmpty():
            return to.select("word", "root")


def group_variants(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """words (word, n) -> (word, form, root, n, n_near, form_n), a row a word.

    Two words are near if one inserted, deleted or replaced code point makes one the
    other. A word's form is its near word of largest n (ties: the smallest in code-point
    order) if that n is at least ratio times the word's, else null; root is where forms
    lead, the word itself if it has none; n_near counts near words.

    Words are given once each; a null word, one of fewer than four code points, or one
    without n is left out. Other columns are ignored; an empty table gives none. At ratio
    1 or less forms could go in circles, so it must be larger.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = written(words.where(f"char_length(word) >= {SHORTEST} and n is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("word"), "b", "b_n").union(pairs.select("b", "a", "a_n"))
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = words.join(near, "word", "left").withColumn("fits", -F.col("best.less") >= ratio * F.col("n"))
    judged = judged.select("word", F.when(F.col("fits"), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n"))
    judged = written(judged, "judged")
    discard(words, pairs)
    led = roots(judged.where("form is not null"))
    return judged.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
