"""MinHash near-duplicate detection by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In round i every member of a set is hashed to one coordinate
and a value in [i, i + 1), and a coordinate keeps its least value; a set is done after the
first round in which all its coordinates have one. The first T rounds choose the coordinate
at random; round T + j sends every member to coordinate j, so that every coordinate is
filled after 2 T rounds at most, after one or two for large sets. Values of an earlier
round are smaller, so later rounds change nothing that is filled, and the share of equal
coordinates of two sets estimates their Jaccard likeness with the concentration of T
independent samples.

Sketches are cut into bands of a few coordinates, and sets that agree in a band are
candidates. With 40 bands of 4, sets of likeness 0.8 are no candidates with probability
(1 - 0.8^4)^40 = 7e-10, and more likely ones with less. Candidates are verified on their
full sets. Equal sets are one class; a bucket of a band first compares its classes with
one head, and after these links are merged only classes of different components meet, and
of these only pairs whose parity bitmaps allow a link: each shingle flips one bit, so the
bits that differ are at most the shingles that do. A pair that shares many buckets is
looked at in the first few of them, told by a byte of every band. No group of copies is
expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import BLOCK, BROADCAST_ROWS, components
from .jaccard_join import _named_sets, _verified, component_rows
from .shingles import mix, set_class, shingle_sets
from .store import discard, releasing, shuffle_partitions, written

BANDS, ROWS = 40, 4
#: Bits of the parity bitmap that a set takes to its buckets.
PARITY = 1024
#: Of the bands whose bytes are equal, those in which a pair is looked at. That the first of the common bands come after so many that only seem common has a probability of 3e-11 for sets of likeness 0.8.
FIRST = 4
#: Members sketched together.
RUN = 1 << 19
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def sketches(sizes: np.ndarray, members: np.ndarray, t: int) -> np.ndarray:
    """The sketches (a row a set, t columns) of sets of 64-bit hashes, given one after the other with their sizes; no set is empty."""
    found = np.full((len(sizes), t), _EMPTY)
    flat = found.reshape(-1)
    owner, rest = np.repeat(np.arange(len(sizes)), sizes), members
    seeds = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(rest):
                break
            h = mix(rest ^ seeds[i])
            value = np.uint64(i << 32) | (h & _LOW)
            if i < t:
                where = ((h >> _HALF) * np.uint64(t)) >> _HALF
                np.minimum.at(flat, owner * t + where.astype(np.int64), value)
            else:
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                who = owner[first]
                found[who, i - t] = np.minimum(found[who, i - t], np.minimum.reduceat(value, first))
            open_ = np.zeros(len(sizes), bool)
            left = np.unique(owner)
            open_[left] = (found[left] == _EMPTY).any(axis=1)
            keep = open_[owner]
            owner, rest = owner[keep], rest[keep]
    return found


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch; keys of different bands differ."""
    with np.errstate(over="ignore"):
        cut = found.reshape(len(found), bands, rows)
        keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(found), bands))
        for j in range(rows):
            keys = mix(keys * np.uint64(0xD1342543DE82EF95) + cut[:, :, j])
        return keys


def parity(members: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set of hashes, in longs."""
    odd = np.bincount((members & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_link(n: np.ndarray, m: np.ndarray, differing: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m members whose bitmaps differ in so many bits can have 100 * intersection >= percent * union."""
    least = -(-percent * (n + m) // (100 + percent))
    return (least <= np.minimum(n, m)) & (differing <= n + m - 2 * least)


def block_pairs(block: dict[str, np.ndarray], place: int, percent: int) -> Iterator[np.ndarray]:
    """Pairs (rows of the block) of members of different components that may link, in the first places that they seem to share.

    block: n, component, bits, bytes and side of the members; where there are members of
    side 1, pairs are of the two sides, else of members of side 0 among each other.
    """
    n, side = block["n"], block["side"]
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(y)
    y = x if within else y
    step = max(1, (1 << 17) // max(1, len(y)))
    for at in range(0, len(x), step):
        rows = x[at : at + step]
        fits = block["component"][rows, None] != block["component"][None, y]
        if within:
            fits &= rows[:, None] < y[None]
        i, j = np.nonzero(fits)
        i, j = rows[i], y[j]
        keep = may_link(n[i], n[j], np.bitwise_count(block["bits"][i] ^ block["bits"][j]).sum(axis=1, dtype=np.int64), percent)
        i, j = i[keep], j[keep]
        keep = (block["bytes"][i, :place] == block["bytes"][j, :place]).sum(axis=1) < FIRST
        yield np.stack([i[keep], j[keep]], 1)


def pairs_of_buckets(posts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """posts (band, place, cls, component) and sets (cls, n, bits, bytes), a set once or more -> distinct (a, b), a < b: members of one bucket that lie in different components and may link.

    Buckets within one component are left out. One of more than BLOCK members is cut into
    parts, and every two parts meet in a block of their own, so a task holds two parts of
    one bucket at most.
    """
    buckets = posts.groupBy("band").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    buckets = written(buckets.select("band", F.ceil(F.col("members") / BLOCK).cast("int").alias("parts")), "buckets")
    few = buckets.count() <= BROADCAST_ROWS
    dealt = posts.join(F.broadcast(buckets) if few else buckets, "band").withColumn("part", F.expr("cast(pmod(xxhash64(cls), parts) as int)"))
    dealt = written(dealt, "dealt")
    known = sets.join(dealt.select("cls").distinct(), "cls", "left_semi").select("cls", "n", "bits", "bytes").dropDuplicates(["cls"])
    # a part goes as side 0 to its own block and those of later parts, and as side 1 to those of earlier ones
    stops = F.expr("transform(sequence(0, parts - 1), k -> named_struct('i', least(k, part), 'j', greatest(k, part), 'side', cast(k < part as int)))")
    blocks = dealt.join(known, "cls").select("band", F.explode(stops).alias("stop"), "place", "cls", "n", "bits", "bytes", "component").select("band", "stop.*", "place", "cls", "n", "bits", "bytes", "component")
    key = ["band", "i", "j"]
    rows = blocks.repartition(shuffle_partitions(posts.sparkSession), *key).sortWithinPartitions(*key, "side", "cls")

    @releasing
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            lists = lambda name: whole.column(name).combine_chunks().flatten().to_numpy().reshape(len(whole), -1)
            block = {c: whole.column(c).to_numpy() for c in ("n", "component", "side")} | {"bits": lists("bits").view(np.uint64), "bytes": lists("bytes").view(np.uint8)}
            cls = whole.column("cls").to_numpy()
            for found in block_pairs(block, whole.column("place")[0].as_py(), percent):
                ends = np.sort(cls[found], axis=1)
                if len(ends):
                    yield pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in key])
            cut = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            for first, last in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                if now != (now := tuple(keys[:, first])) and held:
                    yield from flush()
                    held = []
                held.append(batch.slice(first, last - first))
        if held:
            yield from flush()

    pairs = written(rows.mapInArrow(meet, "a long, b long").distinct(), "pairs")
    discard(buckets, dealt)
    return pairs


def _banded(docs: DataFrame, k: int, bands: int, rows: int, clashes: frozenset[int]) -> DataFrame:
    """(cls, n, bits array, bytes array, bands array): a row for each set, again where several tasks have it."""

    @releasing
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in held], np.int64)
            keys = band_keys(sketches(sizes, np.concatenate(held), bands * rows), bands, rows)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64)))
            ends = np.zeros((len(keys), -(-bands // 8) * 8), np.uint8)
            ends[:, :bands] = keys & np.uint64(255)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes), lists(np.stack([parity(s) for s in held])), lists(ends.view(np.int64)), lists(keys)], names=["cls", "n", "bits", "bytes", "bands"])

        seen: set[int] = set()
        held, names, size = [], [], 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                if not len(s) or (cls := set_class(s, clashes)) in seen:
                    continue
                seen.add(cls)
                held.append(s)
                names.append(cls)
                size += len(s)
                if size >= RUN:
                    yield flush()
                    held, names, size = [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(sketched, "cls long, n long, bits array<long>, bytes array<long>, bands array<long>")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, n_shingles, component_id, kept), a row a document.

    Words are runs of non-white-space with A-Z lower-cased; a set holds the distinct
    ``shingle``-word sequences of the whole text (a shorter text: its whole sequence).
    Candidates are the sets that agree in a band; documents link when 100 * intersection
    >= percent * union of their full sets; component_id is the smallest doc_id reachable
    by links, and kept tells whether it is the document's own.

    Null and empty texts have an empty set and link with nothing. Repeated rows are each
    returned. A row without doc_id is returned with a null component_id and a null kept,
    and names no component. Other columns are ignored. An empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classes, nodes, clashes = _named_sets(docs, shingle)
    known = docs.where("doc_id is not null")
    posts = written(_banded(known, shingle, bands, rows, clashes), "bands")
    each = posts.select("cls", F.posexplode("bands").alias("place", "band"))
    buckets = each.groupBy("band").agg(F.min("cls").alias("head"), F.max("cls").alias("last")).where("head <> last")
    heads = written(buckets.select("band", "head"), "heads")
    few = heads.count() <= BROADCAST_ROWS
    met = written(each.join(F.broadcast(heads) if few else heads, "band").distinct(), "met")
    edges = _links(met, posts, known, nodes, shingle, percent, clashes)
    discard(posts, heads)
    found = component_rows(classes, nodes, edges)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _links(met: DataFrame, sets: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, clashes: frozenset[int]) -> DataFrame:
    """Links between classes that share a bucket (band, place, cls, head), enough of them to join all that are linked."""
    pairs = written(met.where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct(), "pairs")
    edges = _verified(pairs, docs, nodes, k, percent, clashes)
    parts = components(edges)
    posts = met.join(parts, met.cls == parts.node, "left").select("band", "place", "cls", F.coalesce("component", "cls").alias("component"))
    across = pairs_of_buckets(posts, sets, percent)
    seen = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = written(across.join(seen, ["a", "b"], "left_anti"), "more")
    discard(pairs, across, parts, met)
    if more.isEmpty():
        return edges
    found = _verified(more, docs, nodes, k, percent, clashes)
    discard(more)
    return edges.union(found)
