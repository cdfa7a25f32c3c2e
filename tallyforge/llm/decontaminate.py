"""Benchmark decontamination: n-gram seeds, bounds, then Smith-Waterman alignment.

Every word n-gram of a benchmark item seeds it, however often the corpus repeats it, so
whether a document leaks depends on that document alone. Copies without any n-gram, such
as those with every third word changed, are seeded by pairs of words, of which there must
be a fifth of the item's. What keeps frequent n-grams
affordable are two bounds that lose no leak: the item's words that the document has at
all, and the best run of item words in a passage. Where both leave a leak possible, the
passage is aligned with the item word by word; local alignment bridges changed, added
and missing words, so edited copies score nearly as high as exact ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import _STEP, _chunks, mix, word_hashes
from .store import fresh, releasing, written

_GAPS = ~np.isin(np.arange(256), np.r_[48:58, 65:91, 97:123, 128:256])
#: Words of a seed; share of an item's pairs of words that seed it without one; alignment scores; share of an item's best score that is a leak.
SEED_WORDS = 3
SEED_PAIRS = 0.2
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
#: Benchmark words up to which the items go to every task (8 bytes each, thrice); larger ones are searched in blocks.
BLOCK_WORDS = 2_000_000
#: Hashes of leaking texts that may be broadcast, 8 bytes each.
BROADCAST_KEYS = 1_000_000


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, np.uint64)
    acc = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        acc = acc * _STEP + words[i : len(words) - n + 1 + i]
    return mix(acc)


def alignment(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(score, begin, end) of the best local alignment of the item in the passage, by word."""
    m = len(item)
    before = np.zeros(m + 1, np.int64)
    origin = np.arange(1, dtype=np.int64).repeat(m + 1)
    best, span = 0, (0, 0)
    ramp = np.arange(m + 1) * -GAP
    for i, w in enumerate(passage):
        # moves that take this word: onto an item word, or past it
        diagonal = before[:-1] + np.where(item == w, MATCH, MISMATCH)
        up = before[1:] + GAP
        here = np.zeros(m + 1, np.int64)
        came = np.full(m + 1, i + 1, np.int64)
        here[1:] = np.maximum(np.maximum(diagonal, up), 0)
        fresh = np.full(m, i, np.int64)
        from_diagonal = np.where(before[:-1] > 0, origin[:-1], fresh)
        came[1:] = np.where(here[1:] == 0, i + 1, np.where(diagonal >= up, from_diagonal, origin[1:]))
        # item words left out: a running maximum with a falling ramp
        raised = here + ramp
        top = np.maximum.accumulate(raised)
        lead = np.maximum.accumulate(np.where(raised == top, np.arange(m + 1), 0))
        came = np.where(top - ramp > here, came[lead], came)
        before, origin = np.maximum(top - ramp, 0), came
        j = int(before.argmax())
        if before[j] > best:
            best, span = int(before[j]), (int(origin[j]), i + 1)
    return best, *span


class _Items:
    """The words of benchmark items, looked up by their n-grams."""

    def __init__(self, items: list[tuple[int, np.ndarray]], n: int):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.whole = {}
        for k, words in enumerate(self.words):
            if 0 < len(words) < n:
                self.whole.setdefault(words.tobytes(), []).append(k)
        #: seeds that an item needs, by their size in words
        self.needed = {n: np.ones(len(items), np.int64)}
        if n > 2:
            self.needed[2] = np.array([max(1, int(np.ceil(SEED_PAIRS * (len(w) - 1)))) for w in self.words], np.int64)
        self.seeds = {size: self._index(size, n) for size in self.needed}

    def _index(self, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        grams = [np.unique(_grams(w, size)) if len(w) >= n else np.zeros(0, np.uint64) for w in self.words]
        seeds, owners = np.concatenate([np.zeros(0, np.uint64), *grams]), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.argsort(seeds, kind="stable")
        return seeds[order], owners[order]

    def met(self, grams: np.ndarray, size: int) -> np.ndarray:
        """Items of which as many of the n-grams are seeds as the item needs."""
        seeds, owners = self.seeds[size]
        if not len(seeds):
            return np.zeros(0, np.int64)
        _, index = _ranges(seeds, np.unique(grams[_among(grams, seeds)]))
        met, count = np.unique(owners[index], return_counts=True)
        return met[count >= self.needed[size][met]]


def _ranges(values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in asked, place in values) of all equal elements; values are sorted."""
    lo, hi = np.searchsorted(values, asked), np.searchsorted(values, asked, "right")
    n = hi - lo
    return np.repeat(np.arange(len(asked)), n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _among(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which words are in known, which is sorted and not empty."""
    at = np.searchsorted(known, words)
    at[at == len(known)] = 0
    return known[at] == words


def _rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    with np.errstate(over="ignore"):
        for first, raw, ends in _chunks(column):
            rows, words = word_hashes(raw, ends, _GAPS)
            bounds = np.searchsorted(rows, np.arange(len(ends)))
            for i in range(len(ends) - 1):
                yield first + i, words[bounds[i] : bounds[i + 1]]


def _document_leaks(words: np.ndarray, items: _Items, n: int, least: float) -> list[tuple[int, int, float, int, int]]:
    """(item, seeds, score, begin, end) of the items of which a passage of the document is a copy."""
    found = [(items.ids[k], 1, 1.0, 0, len(words)) for k in items.whole.get(words.tobytes(), ())]
    have, leaked = None, []
    for size, needed in items.needed.items():
        with np.errstate(over="ignore"):
            grams = _grams(words, size)
        met = np.setdiff1d(items.met(grams, size), leaked)
        if not len(met):
            continue
        # words that the document lacks are matched nowhere
        have = np.unique(words) if have is None else have
        sizes = np.array([len(items.words[k]) for k in met])
        held = _among(np.concatenate([items.words[k] for k in met]), have)
        met = met[np.add.reduceat(held.astype(np.int64), np.cumsum(sizes) - sizes) >= least * sizes]
        order = np.argsort(grams, kind="stable") if len(met) else None
        ordered = grams[order] if len(met) else None
        for k in met:
            leak = _leak(words, items.words[k], size, ordered, order, int(needed[k]), least)
            if leak:
                found.append((items.ids[k], *leak))
                leaked.append(k)
    return found


def _leak(words: np.ndarray, item: np.ndarray, size: int, ordered: np.ndarray, order: np.ndarray, needed: int, least: float) -> tuple | None:
    """(seeds, score, begin, end) of the document's passage most like the item, if it is a copy; ordered are the document's grams of that size, order their places."""
    full = MATCH * len(item)
    with np.errstate(over="ignore"):
        place, index = _ranges(ordered, _grams(item, size))
    start, count = np.unique(order[index] - place, return_counts=True)
    # seeds whose diagonals lie within half an item of each other share a passage; added words cost as much as matches leave over
    cuts = np.flatnonzero(np.diff(start) > len(item) // 2 + 2) + 1
    reach = max(len(item) // 2, int(full * max(1 - least, 0))) + 2
    known, passages = np.unique(item), []
    for g, c in zip(np.split(start, cuts), np.split(count, cuts), strict=True):
        if c.sum() < needed:
            continue
        lo, hi = max(0, int(g[0]) - reach), min(len(words), int(g[-1]) + len(item) + reach)
        run = np.cumsum(np.r_[0, np.where(_among(words[lo:hi], known), MATCH, max(MISMATCH, GAP))])
        bound = int((run - np.minimum.accumulate(run)).max())
        if bound >= least * full:
            passages.append((bound, lo, hi, int(c.sum())))
    top = (0, 0, 0, 0, 0)
    for bound, lo, hi, seeds in sorted(passages, key=lambda x: -x[0]):
        if bound <= top[0] or top[0] == full:
            break
        top = max(top, alignment(words[lo:hi], item) + (lo, seeds), key=lambda x: x[0])
    score = top[0] / full
    return (top[4], score, top[1] + top[3], top[2] + top[3]) if top[0] and score >= least else None


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as word hashes, at most BLOCK_WORDS words together; they stream past the driver block by block."""
    held, size = [], 0
    for row in benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id").toLocalIterator():
        for _, words in _rows(pa.array([row["text"]], pa.string())):
            held.append((row["item_id"], words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, seed_words: int = SEED_WORDS, least: float = LEAST_SCORE) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> (doc_id, item_id, n_seeds, score, begin, end): a row for each document that has a copy of an item.

    score is the alignment's share of the item's best possible one; begin and end are
    the passage in words of the document (runs of letters and digits). n_seeds counts the
    item's n-grams met near the passage, or its pairs of words where no n-gram led to a
    copy. A passage that keeps neither seed_words words of the item in a row nor a fifth of
    its pairs is no copy: at a score of 0.5 or more that needs over six breaks to ten words. Items of fewer words than a seed leak only into documents that are equal to them, word by word. Null and
    empty texts, and items without words or item_id, give nothing. Repeated documents
    and items are each reported. An empty table gives none.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, n_seeds long, score double, begin long, end long"
    out = None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(_Items(block, seed_words))

        @releasing
        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                index, rows = [], []
                for i, words in _rows(batch.column(1)):
                    found = _document_leaks(words, shared.value, seed_words, least)
                    index += [i] * len(found)
                    rows += found
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int32())), *(pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())))], names=["doc_id", "item_id", "n_seeds", "score", "begin", "end"])

        part = docs.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, seed_words: int = SEED_WORDS, least: float = LEAST_SCORE) -> DataFrame:
    """docs less those of which a passage is a copy of a benchmark item; rows without doc_id are judged by their text like others.

    Texts that leak are known by a hash; while those are few they are broadcast, so that
    the texts that stay need not move. All columns of docs are kept, whatever their names.
    """
    key, text = fresh(docs, "key"), F.col("text").cast("string")
    leaks = find_leaks(docs.select(F.xxhash64(text).alias("doc_id"), "text"), benchmark, seed_words=seed_words, least=least)
    leaks = written(leaks.select(F.col("doc_id").alias(key)).distinct(), "leaking")
    few = leaks.count() <= BROADCAST_KEYS
    return docs.withColumn(key, F.xxhash64(text)).join(F.broadcast(leaks) if few else leaks, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))
