"""Packing documents into fixed-length sequences by bin completion.

Only lengths matter for packing, and there are at most as many lengths as a sequence
has tokens. So the cluster counts pieces by length, a bounded search packs that
histogram, and each piece finds its place by its rank among those of its length.
The search takes the largest piece left and enumerates undominated fillings of the
rest of its sequence, fullest first; a branch ends when what is wasted already rules
out beating the incumbent, which best-fit decreasing provides at first.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import releasing, written

CAPACITY = 2048
#: Search nodes and alternative fillings a node; the incumbent stands when they are used up.
NODES, WIDTH = 40, 4
#: Fillings that one enumeration may look at.
STEPS = 20_000
#: Pieces of one length that are ranked together, about.
RANKED = 1000

Pattern = tuple[tuple[int, ...], int]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: [(lengths in a sequence, how many such sequences)]."""
    open_: dict[int, list[list]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r, x in open_.items() if r >= size and x), default=None)
            if room is None:
                per = capacity // size
                full, rest = divmod(left, per)
                for items, n in (((size,) * per, full), ((size,) * rest, 1 if rest else 0)):
                    if n:
                        open_.setdefault(capacity - size * len(items), []).append([items, n])
                left = 0
                continue
            items, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
            m = min(n, left)
            if n > m:
                open_.setdefault(room, []).append([items, n - m])
            open_.setdefault(room - size, []).append([(*items, size), m])
            left -= m
    return [(tuple(items), n) for group in open_.values() for items, n in group]


def fillings(counts: dict[int, int], room: int, most: float = STEPS) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of a room, fullest first and of those the ones of larger pieces; one empty filling if nothing fits.

    A filling is dominated when a piece left out could take the place of one or two
    that are in. Of the fullest none is, for the sum would grow. A piece that fills the
    room exactly dominates all others. A pair that does comes first, before the sums
    within reach are worked out, which the other fillings follow from. At most that many
    are looked at.
    """
    sizes = [s for s in sorted(counts) if s <= room and counts[s]]
    if not sizes:
        yield ()
        return
    if counts.get(room):
        yield (room,)
        return
    pair = next(((s, room - s) for s in reversed(sizes) if 2 * s >= room and counts.get(room - s, 0) > (2 * s == room)), ())
    if pair:
        yield pair
    reach = _reach(sizes, counts, room)
    target = reach[-1].bit_length() - 1
    steps, waste = 0, room - target

    def descend(i: int, need: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not need:
            yield chosen
            return
        for j in range(bisect_right(sizes, need, 0, i) - 1, -1, -1):
            s = sizes[j]
            for k in range(min(counts[s], need // s), 0, -1):
                if reach[j] >> (need - k * s) & 1:
                    yield from descend(j, need - k * s, (*chosen, *(s,) * k))

    while target > 0 and steps < most:
        for chosen in descend(len(sizes), target, ()):
            steps += 1
            if chosen != pair and (room - target == waste or not _dominated(chosen, room - target, counts, sizes)):
                yield chosen
            if steps >= most:
                break
        target = (reach[-1] & ((1 << target) - 1)).bit_length() - 1


def _reach(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each number of sizes, the sums that those make, as the bits of an integer."""
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for s in sizes:
        bits, left, step = reach[-1], min(counts[s], room // s), 1
        while left > 0:
            take = min(step, left)
            bits |= (bits << (s * take)) & mask
            left -= take
            step *= 2
        reach.append(bits)
    return reach


def _dominated(chosen: tuple[int, ...], waste: int, counts: dict[int, int], sizes: list[int]) -> bool:
    if not waste:
        return False
    spare = [s for s in sizes if counts[s] > chosen.count(s)]
    groups = {*chosen, *(a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :])}
    at = np.searchsorted(spare, sorted(groups), "right")
    return any(i < len(spare) and spare[i] <= g + waste for i, g in zip(at, sorted(groups), strict=True))


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, *, nodes: float = NODES, width: float = WIDTH, steps: float = STEPS, exact: bool = False) -> list[Pattern]:
    """Lengths with their numbers -> sequences as patterns with their numbers, as few as the search finds.

    A step fills as many sequences alike as the pieces allow, so the work follows the
    number of lengths and not that of pieces. A branch is kept as the chain of its
    patterns and replayed when the search comes back to it. With exact, a step fills one
    sequence and no limit holds: the sequences are as few as can be, in a time that grows
    with the number of ways to fill them.
    """
    if exact:
        nodes = width = steps = math.inf
    counts = {s: n for s, n in counts.items() if n > 0}
    best = best_fit(counts, capacity)
    used = sum(n for _, n in best)
    total = sum(s * n for s, n in counts.items())
    least = -(-total // capacity)
    spent = 0.0
    stack: list[tuple] = [(None, 0, 0)]  # chain of patterns, sequences used, fillings tried after it
    while stack and used > least and spent < nodes:
        chain, n_used, tried = stack.pop()
        left, rest, link = dict(counts), total, chain
        while link:
            link, items, times = link
            rest -= times * sum(items)
            for s in items:
                left[s] -= times
            spent += 0.005
        left = {s: n for s, n in left.items() if n}
        order = sorted(left)
        while rest and n_used + -(-rest // capacity) < used:
            while order[-1] not in left:
                order.pop()
            largest = order[-1]
            left[largest] -= 1
            chosen = next(itertools.islice(fillings(left, capacity - largest, steps), tried, None), None)
            left[largest] += 1
            spent += 1 if spent else 0
            if chosen is None:
                break
            if tried + 1 < width:
                stack.append((chain, n_used, tried + 1))
            tried = 0
            items = (largest, *chosen)
            times = 1 if exact else min(left[s] // items.count(s) for s in set(items))
            for s in set(items):
                left[s] -= items.count(s) * times
                if not left[s]:
                    del left[s]
            chain, n_used, rest = (chain, items, times), n_used + times, rest - times * sum(items)
        if not rest and n_used < used:
            used, best = n_used, []
            while chain:
                chain, items, times = chain
                best.append((items, times))
        spent += 1
    return best


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _encoder(path: str):
    """The encoder of a tokenizer file, made once in a worker process: token ids as the file's own tokenizer gives them.

    A byte-level vocabulary is read as ranks, which is three times faster and gives the
    same ids; texts with one of the file's added tokens go to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    added = [t["content"] for t in model["added_tokens"]]
    # the printable stand-ins of bytes in byte-level vocabularies
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
    ordinary = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    del model, ranks

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return _tokenizer(path).encode(text, add_special_tokens=False).ids
        return ordinary(text)

    return encode


def pieces(docs: DataFrame, capacity: int = CAPACITY, *, vocabulary: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, piece, start, length, ids_crc32): token ids with an id 0 after them, cut where they exceed the capacity.

    All pieces of a cut document are full but the first, which takes the rest.
    """
    path = vocabulary or default_vocabulary()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            index, rows = [], []
            for i, text in enumerate(batch.column(1)):  # one text in Python at a time
                ids = np.array([*encode(text.as_py() or ""), 0], "<u4")
                start = 0
                for k, stop in enumerate(range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)):
                    index.append(i)
                    rows.append((k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start = stop
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int32())), *(pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64())))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str | None = None, nodes: float = NODES, width: float = WIDTH, steps: float = STEPS, exact: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row a piece.

    A null or empty text is one piece, its end mark. Repeated rows are each packed;
    rows without doc_id too. Other columns are ignored; an empty table gives none.
    nodes, width, steps and exact are those of pack_histogram.
    """
    cut = written(pieces(docs, capacity, vocabulary=vocabulary), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = pack_histogram(counts, capacity, nodes=nodes, width=width, steps=steps, exact=exact)
    plan: dict[int, list[tuple[int, int, int]]] = {}  # by length: first rank, sequence of that rank, offset
    given = dict.fromkeys(counts, 0)
    sequence = 0
    for items, times in patterns:
        offset = 0
        for s in items:
            plan.setdefault(s, []).append((given[s], sequence, offset))
            given[s] += times
            offset += s
        sequence += times
    shared = docs.sparkSession.sparkContext.broadcast({s: np.array(x, np.int64).T for s, x in plan.items()})
    salts = F.create_map(*[x for s, n in sorted(counts.items()) for x in (F.lit(s), F.lit(-(-n // RANKED)))]) if counts else F.lit(None).cast("map<bigint, int>")
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(salts, F.col("length"))))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "before")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("n", rank).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("n") - 1).alias("rank"))

    @releasing
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            where, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(length[order]) > 0, True]) if len(order) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                who = order[i:j]
                first, sequences, offsets = places[int(length[who[0]])]
                at = np.searchsorted(first, rank[who], "right") - 1
                where[who], offset[who] = sequences[at] + rank[who] - first[at], offsets[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(where), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    schema = ", ".join([*(f"{c} {t}" for c, t in cut.dtypes), "sequence_id long", "offset long"])
    return ranked.mapInArrow(place, schema)
