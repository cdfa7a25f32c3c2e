"""Personal data: patterns, and terms that reveal them by corpus co-occurrence.

Base spans (email, ip, card, phone) are pattern matches. Around each, the corpus
estimates how strongly a term t reveals the protected entity e: with
PMI(e; t) = ln(N n_te / (n_t n_e)) and IC(e) = ln(N / n_e), the term discloses e when
PMI >= IC / alpha, that is when knowing t gives away most of the information in e.
All four are counts of documents, copies included, so neither is ever below nothing.
What chance could bring together discloses nothing: t must be seen with e in two
different texts at least, and its log-likelihood ratio n_te PMI - (n_te - n_t n_e / N)
reach SURE. Such terms are spans of kind term wherever they stand: those that disclose a
value in every text, those that disclose a kind in every text that has one of that kind.
A kind that more than MOST_COMMON of the documents have is no secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import _chunks, word_hashes
from .store import discard, fresh, releasing, slices, written

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an entity that count as seen with it.
WINDOW = 8
#: A term discloses e when PMI(e; t) >= IC(e) / ALPHA; different texts in which it must be seen with e.
ALPHA, SUPPORT = 1.25, 2
#: Log-likelihood ratio at which a term and an entity meet more often than by chance; share of documents up to which a kind is protected.
SURE, MOST_COMMON = 4.5, 0.1
#: Letters of the shortest term; initials and particles of fewer are no terms.
SHORTEST = 3
#: Hashes that may be broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_HASHES = 2_000_000

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
_GAPS = ~np.isin(np.arange(256), np.r_[65:91, 97:123, 128:256])


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS and then start."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    first = _DIGIT.search(text)
    if not first:
        return found
    first = first.start()
    for m in _IP.finditer(text, first):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text, first):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _words(text: str) -> tuple[list[int], list[int], np.ndarray]:
    """(starts, ends, hashes) of the words of a text, in code points."""
    found = [m.span() for m in _TERM.finditer(text)]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    with np.errstate(over="ignore"):
        hashes = word_hashes(raw, np.array([0, len(raw)]), _GAPS)[1].view(np.int64)
    return [a for a, _ in found], [b for _, b in found], hashes


def _free(spans: list[tuple[str, int, int]], starts: list[int], ends: list[int], which: Iterable[int]) -> list[int]:
    """Those of the words that have SHORTEST letters and are no part of a span."""
    taken = sorted((a, b) for _, a, b in spans)
    begins, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    # a word overlaps a span when, of those that begin before its end, one ends after its begin
    return [i for i in which if ends[i] - starts[i] >= SHORTEST and (not (n := bisect_left(begins, ends[i])) or reach[n - 1] <= starts[i])]


def windows(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, str | None, list[tuple[int, int, int]]]]:
    """(entity, its kind if it is one, [(term, start, end)]) of each base span: the words around it that are no part of a base span.

    A span stands for two protected entities, its value and its kind.
    """
    starts, ends, hashes = _words(text)
    free = set(_free(spans, starts, ends, range(len(starts))))
    hashes = hashes.tolist()
    for kind, start, end in spans:
        value = text[start:end].lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", text[start:end])
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        around = [*range(max(0, before - WINDOW), before), *range(after, min(len(starts), after + WINDOW))]
        terms = [(hashes[i], starts[i], ends[i]) for i in around if i in free]
        yield _hash(kind, value), None, terms
        yield _hash(kind), kind, terms


def disclosing_terms(docs: DataFrame, *, alpha: float = ALPHA, support: int = SUPPORT, sure: float = SURE, most_common: float = MOST_COMMON) -> DataFrame:
    """docs (text) -> (kind string, term long): hashes of the terms that disclose an entity; kind is null where that is a value."""

    @releasing
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and (spans := base_spans(text)):
                    rows += [(e, key, t) for e, t in {(e, t) for e, _, terms in windows(text, spans) for t in (None, *(t for t, _, _ in terms))}]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["entity", "key", "term"])

    # every count of the PMI is one of documents; support is one of different texts, so copies alone give none
    met = docs.select("text", F.xxhash64("text").alias("key")).mapInArrow(seen, "entity long, key long, term long")
    met = written(met.groupBy("entity", "key", "term").agg(F.count("*").alias("copies")), "met")
    n_e = met.where("term is null").groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts")).where(f"texts >= {support}").drop("texts")
    n_te = met.where("term is not null").groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count("*").alias("texts")).where(f"texts >= {support}").drop("texts")
    often = written(n_te.join(n_e, "entity"), "pairs")
    n = max(docs.count(), 1)
    kind = F.lit(None).cast("string")
    for name in KINDS:
        kind = F.when(F.col("entity") == _hash(name), name).otherwise(kind)

    def strong(n_t: Column, slack: float) -> Column:
        chance = n_t * F.col("n_e") / F.lit(float(n))
        pmi = F.log(F.col("n_te") / chance)
        return (pmi >= F.log(F.lit(float(n)) / F.col("n_e")) / alpha - slack) & (F.col("n_te") * pmi - (F.col("n_te") - chance) >= sure - slack) & (kind.isNull() | (F.col("n_e") <= most_common * n))

    # a term has at least as many documents as are seen with any one entity, and PMI and ratio fall as they grow while PMI is not below 0: what is too weak with so few need not be counted
    least = often.groupBy("term").agg(F.max("n_te").alias("least"))
    open_pairs = written(often.join(least, "term").where(strong(F.col("least"), 1e-6)).drop("least"), "open")
    terms = open_pairs.select("term").distinct()
    few = terms.count() <= BROADCAST_HASHES
    asked = docs.sparkSession.sparkContext.broadcast(np.sort(terms.toArrow().column(0).to_numpy()) if few else None)

    @releasing
    def df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = asked.value
        if wanted is not None and not len(wanted):
            return
        # asked terms are counted over the whole task; without a list of them each batch gives its words
        total = None if wanted is None else np.zeros(len(wanted), np.int64)
        for batch in batches:
            parts = []
            for _, raw, ends in _chunks(batch.column(0)):
                with np.errstate(over="ignore"):
                    rows, words = word_hashes(raw, ends, _GAPS)
                words = words.view(np.int64)
                if wanted is not None:
                    at = np.searchsorted(wanted, words)
                    at[at == len(wanted)] = 0
                    hit = wanted[at] == words
                    rows, words = rows[hit], at[hit]
                order = np.lexsort((rows, words))
                rows, words = rows[order], words[order]
                new = np.r_[True, (rows[1:] != rows[:-1]) | (words[1:] != words[:-1])] if len(rows) else np.zeros(0, bool)
                if wanted is None:
                    parts.append(words[new])
                else:
                    np.add.at(total, words[new], 1)
            if wanted is None:
                terms, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                yield pa.record_batch([pa.array(terms), pa.array(counts)], names=["term", "n"])
        if wanted is not None:
            met_here = np.flatnonzero(total)
            for i in range(0, len(met_here), 10_000):
                some = met_here[i : i + 10_000]
                yield pa.record_batch([pa.array(wanted[some]), pa.array(total[some])], names=["term", "n"])

    n_t = docs.select("text").mapInArrow(df, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    reveals = open_pairs.join(n_t, "term").where(strong(F.col("n_t"), 0.0))
    found = written(reveals.select(kind.alias("kind"), "term").distinct(), "disclosing")
    discard(met, often, open_pairs)
    return found


def _sorted_terms(pairs: Iterable[tuple[str | None, int]]) -> dict[str | None, np.ndarray]:
    """Terms by the kind they disclose; None stands for values."""
    by: dict[str | None, list[int]] = {}
    for kind, term in pairs:
        by.setdefault(kind, []).append(term)
    return {kind: np.unique(np.array(terms, np.int64)) for kind, terms in by.items()}


def _spans(text: str, hashes: np.ndarray, disclosing: dict[str | None, np.ndarray]) -> list[tuple[str, int, int]]:
    """All spans of a text whose words have the hashes, the base ones first and those of kind term after them."""
    spans = base_spans(text)
    hit = np.zeros(len(hashes), bool)
    for kind in {None, *(k for k, _, _ in spans)} & disclosing.keys():
        terms = disclosing[kind]
        at = np.searchsorted(terms, hashes)
        at[at == len(terms)] = 0
        hit |= terms[at] == hashes
    if not hit.any():
        return spans
    found = [m.span() for m in _TERM.finditer(text)]
    starts, ends = [a for a, _ in found], [b for _, b in found]
    return spans + [("term", starts[i], ends[i]) for i in _free(spans, starts, ends, np.flatnonzero(hit).tolist())]


def _hashed(column: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of the words of each text, none for nulls."""
    for _, raw, ends in _chunks(column):
        with np.errstate(over="ignore"):
            rows, words = word_hashes(raw, ends, _GAPS)
        bounds = np.searchsorted(rows, np.arange(len(ends)))
        for i in range(len(ends) - 1):
            yield words[bounds[i] : bounds[i + 1]].view(np.int64)


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span generalised to its kind; of overlapping spans the first listed names the whole."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, *, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """docs (doc_id, text, ...) -> all its columns, text sanitised, with base (array of base spans' digests) and spans.

    Adds n_email, n_ip, n_card, n_phone, n_term (long), base and spans (string,
    kind:start:end comma-joined). Null texts stay null and have no spans; empty ones
    likewise. Repeated rows are each treated; columns of the added names are
    replaced, others kept whatever they are called. Disclosing terms are broadcast up to
    BROADCAST_HASHES of 8 bytes; with more, only those of each text's words are fetched
    by a join. An empty table gives none.
    """
    added = ("n_email", "n_ip", "n_card", "n_phone", "n_term", "base", "spans")
    docs = docs.drop(*added)
    pairs = disclosing_terms(docs.select(F.col("text").cast("string").alias("text")), alpha=alpha, support=support)
    names = docs.columns
    at = names.index("text")
    schema = ", ".join([*(f"`{c}` {'string' if c == 'text' else t}" for c, t in docs.dtypes), *(f"{c} {'long' if c[:2] == 'n_' else 'string'}" for c in added)])
    few = pairs.count() <= BROADCAST_HASHES
    spark = docs.sparkSession
    if few:
        table = pairs.toArrow()
        shared = spark.sparkContext.broadcast(_sorted_terms(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)))
        rows = docs.withColumn("text", F.col("text").cast("string"))
    else:
        shared = None
        key, own_pairs = fresh(docs, "key"), fresh(docs, "pairs")
        keyed = docs.withColumn("text", F.col("text").cast("string")).withColumn(key, F.xxhash64("text"))
        asked = keyed.select(F.col(key).alias("key"), "text").mapInArrow(_asked, "key long, term long").distinct()
        mine = asked.join(pairs, "term").groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("kind", "term")).alias(own_pairs))
        rows = keyed.join(mine, key, "left").select(*(f"`{c}`" for c in names), own_pairs)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            own = None if shared else batch.column(len(names)).to_pylist()
            spans = [_spans(t, h, shared.value if shared else _sorted_terms((p["kind"], p["term"]) for p in own[i] or [])) if t else [] for i, (t, h) in enumerate(zip(texts, _hashed(batch.column(at)), strict=True))]
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array([sanitised(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
            columns += [pa.array([sum(k == kind for k, _, _ in s) for s in spans], pa.int64()) for kind in (*KINDS, "term")]
            columns += [pa.array([_digest([x for x in s if x[0] != "term"]) for s in spans], pa.string()), pa.array([_digest(s) for s in spans], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return rows.mapInArrow(run, schema)


@releasing
def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, words in zip(batch.column(0).to_pylist(), _hashed(batch.column(1)), strict=True):
            terms = np.unique(words)
            yield pa.record_batch([pa.array(np.full(len(terms), key, np.int64)), pa.array(terms)], names=["key", "term"])
