"""Language identification by unigram pieces with segmentations marginalised out.

Every language has a probability for each piece of a fixed public byte-level
vocabulary, learned by expectation-maximisation. The probability of a word is the
sum over all its segmentations into pieces, which a forward pass computes; that of
a text is the product over its words. Words are letter runs, lower-cased, with a
leading space. Short words of equal length share a pass; a long one has a pass of its
own, however long it is, that carries the probabilities of its last bytes along.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import _power_tables, mix
from .store import releasing, slices

#: Different texts of each language that the piece probabilities are learned from, at most.
TRAIN_DOCS = 500
ROUNDS, SMOOTHING = 3, 0.05
#: Bytes of a word up to which words of equal length are treated together; up to which words teach; of a long word that are looked up at a time.
SHORT, TEACHING, STRETCH = 32, 1024, 1 << 16
#: Log-probability a byte by which a language must beat the background.
MARGIN = 0.15
#: Words whose scores a task keeps.
CACHE = 400_000
#: Bytes of text scored together: smaller runs merge new words into the cache more often, at a quarter for twice the time.
_CHUNK_BYTES = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")
_GAP = ~np.isin(np.arange(256), np.r_[97:123, 128:256])
_CODE = mix((np.arange(256, dtype=np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Vocabulary:
    """Pieces of a tiktoken file that can stand in a word, found by a 64-bit hash of their bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        inside = lambda p: not any(_GAP[b] for b in p[p[:1] == b" " :])
        self.pieces = sorted({p for p in pieces if p != b" " and inside(p)} | {bytes([b]) for b in np.flatnonzero(~_GAP)} | {b" "})
        with np.errstate(over="ignore"):
            up = _power_tables(max(map(len, self.pieces)) + 1)[0]
            codes = np.array([np.sum(_CODE[np.frombuffer(p, np.uint8)] * up[: len(p)], dtype=np.uint64) + np.uint64(len(p)) for p in self.pieces])
            codes = mix(codes)
        order = np.argsort(codes)
        self.pieces = [self.pieces[i] for i in order]
        self.codes = codes[order]
        self.lengths = sorted({len(p) for p in self.pieces})
        top = (self.codes >> np.uint64(44)).astype(np.int64)
        self.starts = np.searchsorted(top, np.arange((1 << 20) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.starts).max())

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The piece of each code, -1 where there is none."""
        top = (codes >> np.uint64(44)).astype(np.int64)
        at, end = self.starts[top], self.starts[top + 1]
        out = np.full(len(codes), -1, np.int32)
        for _ in range(self.deepest):
            live = np.flatnonzero(at < end)
            if not len(live):
                break
            same = self.codes[at[live]] == codes[live]
            out[live[same]] = at[live[same]]
            at[live] += 1
        return out


@functools.cache
def _vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, made once in a worker process."""
    with np.errstate(over="ignore"):
        return Vocabulary(path)


def _edges(vocabulary: Vocabulary, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, rows, pieces) of the pieces in equally long words (a row each)."""
    n = words.shape[1]
    up, down = _power_tables(n + 1)
    total = np.zeros((len(words), n + 1), np.uint64)
    np.cumsum(_CODE[words] * up[:n], axis=1, dtype=np.uint64, out=total[:, 1:])
    found = []
    for end in range(1, n + 1):
        for size in vocabulary.lengths:
            if size > end:
                break
            codes = mix((total[:, end] - total[:, end - size]) * down[end - size] + np.uint64(size))
            piece = vocabulary.find(codes)
            rows = np.flatnonzero(piece >= 0)
            if len(rows):
                found.append((end - size, end, rows, piece[rows]))
    return found


def _lattice(vocabulary: Vocabulary, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, piece) of the pieces in one word, in order of their ends."""
    n = len(word)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[word] * up[:n], dtype=np.uint64, out=total[1:])
    found = []
    for size in vocabulary.lengths:
        if size > n:
            break
        piece = vocabulary.find(mix((total[size:] - total[:-size]) * down[: n + 1 - size] + np.uint64(size)))
        begin = np.flatnonzero(piece >= 0)
        found.append((begin, begin + size, piece[begin].astype(np.int64)))
    begin, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(end, kind="stable")
    return begin[order], end[order], piece[order]


def _long_score(vocabulary: Vocabulary, word: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Log-probabilities of a word of any length in each language.

    The forward pass goes stretch by stretch; what it has of the bytes that a piece can
    reach back to goes along, and is scaled so that it stays in range.
    """
    longest = vocabulary.lengths[-1]
    known, out = np.ones((1, probability.shape[1])), np.zeros(probability.shape[1])
    for at in range(0, len(word), STRETCH):
        back = len(known) - 1
        begin, end, piece = _lattice(vocabulary, word[at - back : at + STRETCH])
        new = end > back
        begin, end, p = begin[new], end[new], probability[piece[new]]
        n = min(STRETCH, len(word) - at)
        forward = np.vstack([known, np.zeros((n, probability.shape[1]))])
        bounds = np.searchsorted(end, np.arange(back + 1, back + n + 2))
        for j in range(n):
            i, k = bounds[j], bounds[j + 1]
            forward[back + 1 + j] = (forward[begin[i:k]] * p[i:k]).sum(0)
            if j % 16 == 15 or j == n - 1:
                top = forward[back + 1 + j].copy()
                forward[max(0, back + 2 + j - longest) : back + 2 + j] /= top
                out += np.log(top)
        known = forward[-longest:]
    return out


def _teach_long(vocabulary: Vocabulary, word: np.ndarray, times: float, p: np.ndarray, counts: np.ndarray) -> None:
    """Add to counts how often each piece is expected in a long word."""
    begin, end, piece = _lattice(vocabulary, word)
    n, logs = len(word), np.log(p[piece])
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0
    ends = np.searchsorted(end, np.arange(n + 2))
    for j in range(1, n + 1):
        forward[j] = np.logaddexp.reduce(forward[begin[ends[j] : ends[j + 1]]] + logs[ends[j] : ends[j + 1]])
    by = np.argsort(begin, kind="stable")
    begins = np.searchsorted(begin[by], np.arange(n + 1))
    for j in range(n - 1, -1, -1):
        at = by[begins[j] : begins[j + 1]]
        if len(at):
            backward[j] = np.logaddexp.reduce(backward[end[at]] + logs[at])
    np.add.at(counts, piece, times * np.exp(forward[begin] + logs + backward[end] - forward[n]))


def _forward(edges: list, n: int, rows: int, probability: np.ndarray) -> np.ndarray:
    """forward[j]: probability of the first j bytes in each language, summed over segmentations."""
    forward = np.zeros((n + 1, rows, probability.shape[1]))
    forward[0] = 1
    for begin, end, who, piece in edges:
        forward[end][who] += forward[begin][who] * probability[piece]
    return forward


def _by_length(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, their bytes behind a space) of words of equal length, a few thousand at a time."""
    size = stop - start
    if not len(size):
        return
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(size[order]) > 0, True])
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        for k in range(i, j, 4096):
            who = order[k : min(k + 4096, j)]
            n = size[who[0]]
            words = np.full((len(who), n + 1), 32, np.uint8)
            words[:, 1:] = raw[start[who][:, None] + np.arange(n)]
            yield who, words


def _words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop, code) of the letter runs of rows of lower-cased bytes."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    gap = _GAP[raw]
    row_starts = ends[:-1][ends[:-1] < len(raw)]
    begins = ~gap
    begins[1:] &= gap[:-1]
    begins[row_starts] = ~gap[row_starts]
    stops = ~gap
    stops[:-1] &= gap[1:]
    row_stops = ends[1:][ends[1:] > 0] - 1
    stops[row_stops] = ~gap[row_stops]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    rows = np.searchsorted(ends, start, "right") - 1
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODE[raw] * up[: len(raw)], dtype=np.uint64, out=total[1:])
    return rows, start, stop, mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def _batches(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, ends) of runs of whole rows of about a megabyte."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append((t or "").lower().encode())
        size += len(held[-1])
        if size >= _CHUNK_BYTES or i == len(texts) - 1:
            yield first, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])
            first, held, size = i + 1, [], 0


def learned_pieces(texts: list[str | None], vocabulary: Vocabulary, *, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> np.ndarray:
    """A probability for each piece, by expectation-maximisation over all segmentations of the texts' words.

    Words of more than TEACHING bytes teach nothing.
    """
    groups, codes = [], {}
    for _, raw, ends in _batches(texts):
        _, start, stop, code = _words(raw, ends)
        teaching = stop - start <= TEACHING
        start, stop, code = start[teaching], stop[teaching], code[teaching]
        _, one, times = np.unique(code, return_index=True, return_counts=True)
        for i, c, n in zip(one, code[one].tolist(), times.tolist(), strict=True):
            if c in codes:
                codes[c][1] += n
            else:
                codes[c] = [raw[start[i] : stop[i]].tobytes(), n]
    long = [(np.frombuffer(b" " + w, np.uint8), n) for w, n in codes.values() if len(w) > SHORT]
    words = [(w, n) for w, n in codes.values() if len(w) <= SHORT]
    if words:
        parts = b"".join(w for w, _ in words)
        ends = np.cumsum([0, *(len(w) for w, _ in words)])
        times = np.array([n for _, n in words], float)
        for who, matrix in _by_length(np.frombuffer(parts, np.uint8), ends[:-1], ends[1:]):
            groups.append((times[who], matrix.shape[1], len(who), _edges(vocabulary, matrix)))
    p = np.full(len(vocabulary.pieces), 1 / len(vocabulary.pieces))
    for _ in range(rounds):
        counts = np.full(len(p), smoothing)
        for n_words, n, rows, edges in groups:
            forward = _forward(edges, n, rows, p[:, None])[:, :, 0]
            backward = np.zeros((n + 1, rows))
            backward[n] = n_words / forward[n]
            for begin, end, who, piece in reversed(edges):
                flow = p[piece] * backward[end][who]
                np.add.at(counts, piece, forward[begin][who] * flow)
                backward[begin][who] += flow
        for word, n_words in long:
            _teach_long(vocabulary, word, n_words, p, counts)
        p = counts / counts.sum()
    return p


class Scorer:
    """Log-probabilities of texts in each language; keeps those of the words it has met."""

    def __init__(self, vocabulary: Vocabulary, probability: np.ndarray):
        self.vocabulary, self.probability = vocabulary, probability
        self.codes = np.zeros(0, np.uint64)
        self.scores = np.zeros((0, probability.shape[1]))

    def _score(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = np.zeros((len(start), self.probability.shape[1]))
        short = stop - start <= SHORT
        for i in np.flatnonzero(~short):
            out[i] = _long_score(self.vocabulary, np.r_[np.uint8(32), raw[start[i] : stop[i]]], self.probability)
        few = np.flatnonzero(short)
        for who, words in _by_length(raw, start[few], stop[few]):
            n = words.shape[1]
            out[few[who]] = np.log(_forward(_edges(self.vocabulary, words), n, len(who), self.probability)[n])
        return out

    def texts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.probability.shape[1]))
        for first, raw, ends in _batches(texts):
            rows, start, stop, code = _words(raw, ends)
            unique, one, back = np.unique(code, return_index=True, return_inverse=True)
            at = np.searchsorted(self.codes, unique)
            at[at == len(self.codes)] = 0
            known = self.codes[at] == unique if len(self.codes) else np.zeros(len(unique), bool)
            scores = np.zeros((len(unique), self.probability.shape[1]))
            scores[known] = self.scores[at[known]]
            new = np.flatnonzero(~known)
            if len(new):
                scores[new] = self._score(raw, start[one[new]], stop[one[new]])
                if len(self.codes) + len(new) > CACHE:
                    self.codes, self.scores = unique, scores
                else:
                    codes = np.r_[self.codes, unique[new]]
                    order = np.argsort(codes)
                    self.codes, self.scores = codes[order], np.r_[self.scores, scores[new]][order]
            for i in range(out.shape[1]):
                out[first : first + len(ends) - 1, i] += np.bincount(rows, scores[back, i], len(ends) - 1)
        return out


def held_out(doc_id):
    """Documents that are never learned from: crc32 of the doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(labelled: DataFrame, *, train_docs: int = TRAIN_DOCS, vocabulary: str | None = None) -> tuple[list[str], np.ndarray]:
    """labelled (lang, text) -> (languages, probability of each piece in each), from at most train_docs different texts a language.

    The result has a column a language and a row a piece of the vocabulary, whatever
    the size of the table. Copies of a text teach once, so a text that fills a third of
    the table reaches the learning task as one row. Null and empty languages and texts
    teach nothing.
    """
    path = vocabulary or default_vocabulary()
    labelled = labelled.where("lang <> '' and text <> ''").select("lang", "text", F.xxhash64("text", "lang").alias("key"))
    counts = {r["lang"]: max(r["n"], 1) for r in labelled.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, 0))
    shares = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, 1.3 * train_docs / n) * (1 << 30))))])
    sample = labelled.where(F.pmod(F.col("key"), F.lit(1 << 30)) <= F.element_at(shares, F.col("lang")))
    sample = sample.groupBy("lang", "key").agg(F.first("text").alias("text"))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable").head(train_docs)
        with np.errstate(over="ignore"):
            p = learned_pieces(group["text"].tolist(), _vocabulary(path))
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "p": [p.astype(np.float64).tobytes()]})

    rows = sample.groupBy("lang").applyInPandas(learn, "lang string, p binary").collect()
    rows.sort(key=lambda r: r["lang"])
    return [r["lang"] for r in rows], np.stack([np.frombuffer(r["p"], np.float64) for r in rows], 1)


def with_background(model: tuple[list[str], np.ndarray], *, margin: float = MARGIN, vocabulary: str | None = None) -> tuple[list[str], np.ndarray]:
    """The model with a background und: single bytes, as often as the languages together have them.

    A text is und when no language gives its bytes margin more log-probability each than
    the background, so a long text of no learned language, or junk, is no better off than
    a short one.
    """
    languages, p = model
    if not languages:
        return model
    pieces = _vocabulary(vocabulary or default_vocabulary()).pieces
    q = np.bincount(np.frombuffer(b"".join(pieces), np.uint8), np.repeat(p.mean(1), [len(x) for x in pieces]), 256)
    q = q / q.sum() * np.exp(margin)
    return [*languages, "und"], np.c_[p, [q[x[0]] if len(x) == 1 else 0.0 for x in pieces]]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, vocabulary: str | None = None) -> DataFrame:
    """docs -> all its columns with lang_pred and score, the posterior of that language under equal priors.

    Null texts, texts without letters, and any text when no language was learned, are
    'und' with score 0. Whole texts are scored. Columns named lang_pred and score are
    replaced; repeated rows are each judged; an empty table gives none.
    """
    path = vocabulary or default_vocabulary()
    docs = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, probability = shared.value
        with np.errstate(over="ignore"):
            scorer = Scorer(_vocabulary(path), probability) if languages else None
            for batch in slices(batches):
                texts = batch.column(at).to_pylist()
                clear = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
                lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if scorer and clear.any():
                    total = scorer.texts([t if c else None for t, c in zip(texts, clear, strict=True)])
                    best = total.argmax(1)
                    post = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    lang[clear] = np.array(languages, object)[best[clear]]
                    score[clear] = post[clear]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "lang_pred string", "score double"])
    return docs.mapInArrow(run, schema)
