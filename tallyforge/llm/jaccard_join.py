"""N-gram Jaccard join: an exact set-similarity self-join by T-occurrence search.

Two documents link when they share at least T shingles, T following from their set
sizes and the threshold. DivideSkip answers that question by merging the short
inverted lists with a lowered threshold T - L and probing the L long lists. Here the
cluster does the first half: every set contributes the postings of its rarest
shingles (the prefix that must meet that of any partner) and the shuffle brings a
shingle's list together. Within a query and its candidates ``divide_skip`` merges
short lists with a heap, probes the long ones, and keeps those that reach T.

No group is expanded into all its pairs: equal sets collapse to one class first;
then each list only compares its members with its head, and after those links are
merged into components only pairs between different components are looked at, if
the places of a common shingle leave both enough shingles to reach T. Before the
sets of a pair are fetched their parity bitmaps, a bit or two a shingle, are
compared: each shingle flips a bit, so the bits that differ are at most the shingles
that do, and a pair with more of them than a link allows can be left out.
Members of a long list meet in blocks of two parts of it. Sets have 63-bit names;
where two different sets get the same one, told by a second name, all sets of that name
go by the second. The result is exact up to collisions of single 64-bit shingle hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, pairs_across
from .shingles import mix, set_class, set_names, shingle_sets
from .store import discard, releasing, shuffle_partitions, small_batches, written

#: A shingle in more classes than this sorts after the others; it rises so that at most MAX_FREQUENT exist.
FREQUENT, MAX_FREQUENT = 64, 1 << 20
#: Postings of one frequent shingle that are kept together; candidates of one query in one task.
SUBLIST = 4096
#: Rows up to which the identifiers of the texts to fetch are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Hashes gathered before a task hands on its packed postings.
FLUSH = 1 << 19


def required_overlap(n: int, m: int, percent: int) -> int:
    """The least intersection of sets of n and m with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """In any global order, two linked sets share one of their first this many members."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def divide_skip(query: np.ndarray, candidates: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(index, overlap) of the candidates that reach the required overlap with the query; all are sorted distinct hashes."""
    needed = [required_overlap(len(query), len(c), percent) for c in candidates]
    sizes = np.array([len(c) for c in candidates], np.int64)
    flat = np.concatenate(candidates)
    owner = np.repeat(np.arange(len(candidates)), sizes)
    at = np.searchsorted(query, flat)
    at[at == len(query)] = 0
    hit = query[at] == flat if len(query) else np.zeros(len(flat), bool)
    token, owner = at[hit], owner[hit]
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    lists = sorted(np.split(owner, first[1:]) if len(first) else [], key=len)
    least = min(needed)
    if least <= 0 or len(lists) < least:
        return []
    longest = len(lists[-1])
    n_long = min(int(least / (0.0085 * math.log2(longest + 1) + 1)), least - 1, len(lists))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    counts: dict[int, int] = {}
    heap = [(int(x[0]), i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while heap:
        who, i, j = heap[0]
        counts[who] = counts.get(who, 0) + 1
        if j + 1 < len(short[i]):
            heapq.heapreplace(heap, (int(short[i][j + 1]), i, j + 1))
        else:
            heapq.heappop(heap)
    alive = np.array(sorted(k for k, c in counts.items() if c >= needed[k] - n_long), np.int64)
    if not len(alive):
        return []
    total = np.array([counts[k] for k in alive.tolist()], np.int64)
    for x in long:
        place = np.searchsorted(x, alive)
        place[place == len(x)] = 0
        total += x[place] == alive
    return [(k, t) for k, t in zip(alive.tolist(), total.tolist(), strict=True) if t >= needed[k]]


def parity(members: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set of hashes: as many bits as the power of two from its size up, at least 64, in longs."""
    n_bits = 1 << max(6, (len(members) - 1).bit_length())
    odd = np.bincount((members & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _classes(docs: DataFrame, k: int, clashes: frozenset[int]) -> DataFrame:
    """(doc_id, n, cls, other, bits): each document's set size, the name of its set, a second name and the parity bitmap."""

    @releasing
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, other, bits = [], [], [], []
            for _, s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                cls.append(set_class(s, clashes) if len(s) else None)
                other.append(set_names(s)[1] if len(s) else None)
                bits.append(parity(s) if len(s) else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(other, pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "cls", "other", "bits"])

    return docs.mapInArrow(sets, "doc_id long, n long, cls long, other long, bits array<long>")


def _named_sets(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """(documents with the names of their sets, one row a different set, names that stood for different sets at first)."""
    clashes: frozenset[int] = frozenset()
    while True:
        classes = written(_classes(docs, k, clashes), "classes")
        named = classes.where("cls is not null and doc_id is not null")
        counted = named.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("bits").alias("bits"), F.min("other").alias("lo"), F.max("other").alias("hi"))
        nodes = written(counted, "nodes")
        found = frozenset(r["cls"] for r in nodes.where("lo <> hi").select("cls").collect())
        if not found:
            return classes.drop("other", "bits"), nodes.drop("lo", "hi"), clashes
        clashes |= found
        discard(classes, nodes)


def _packed(tokens: np.ndarray, *columns: np.ndarray, buckets: int, salt: np.ndarray | None = None) -> Iterator[tuple]:
    """(bucket, token bytes, bytes of each column), the bucket following from the token and its salt."""
    where = mix(tokens + salt * np.uint64(0x9E3779B97F4A7C15)) if salt is not None else tokens
    bucket = ((where >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    for i, j in zip(cut, np.r_[cut[1:], len(bucket)], strict=True):
        part = order[i:j]
        yield int(bucket[i]), tokens[part].tobytes(), *(c[part].tobytes() for c in columns)


def _unpacked(batches: Iterator[pa.RecordBatch], *kinds: type) -> list[np.ndarray]:
    """The columns after the first, each as one array."""
    held = list(batches)
    return [np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for batch in held for x in batch.column(i + 1))]) for i, kind in enumerate(kinds)]


def _frequent(docs: DataFrame, k: int, percent: int, buckets: int, more_than: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in more than so many classes, with their counts, in the order of their hashes.

    Without ``known``, those that come early in some set are counted. With it, the
    other shingles of the sets that have so many known ones early that their prefix
    reaches further; known ones are returned as well.
    """
    before = docs.sparkSession.sparkContext.broadcast(known)

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            rows = list(_packed(tokens, n.astype(np.uint32), buckets=buckets))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "tokens", "counts"])

        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                if len(s) and (c := hash(s.tobytes())) not in seen:
                    seen.add(c)
                    p = prefix_length(len(s), percent)
                    early = s[: 3 * p // 2 + 4]
                    if before.value is not None:
                        if len(s) == len(early) or len(early) - np.isin(early, before.value[0], assume_unique=True).sum() >= p:
                            continue
                        early = s[len(early) :]
                    held.append(early)
                    size += len(early)
                if size >= FLUSH:
                    yield from flush()
                    held, seen, size = [], set(), 0
        if held:
            yield from flush()

    @releasing
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, n = _unpacked(batches, np.uint64, np.uint32)
        if len(tokens):
            order = np.argsort(tokens)
            tokens, n = tokens[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            n = np.add.reduceat(n, first)
            many = n > more_than
            yield pa.record_batch([pa.array(tokens[first][many].view(np.int64)), pa.array(n[many])], names=["token", "df"])

    counted = docs.select("text").mapInArrow(count, "bucket int, tokens binary, counts binary")
    with small_batches(docs.sparkSession):
        found = counted.repartition(buckets // 4, "bucket").mapInArrow(total, "token long, df long").toArrow()
    tokens, df = found.column("token").to_numpy().view(np.uint64), found.column("df").to_numpy()
    if known is not None:
        fresh = ~np.isin(tokens, known[0])
        tokens, df = np.r_[known[0], tokens[fresh]], np.r_[known[1], df[fresh]]
    order = np.argsort(tokens)
    return tokens[order], df[order]


def _lists(docs: DataFrame, k: int, percent: int, buckets: int, frequent: tuple[np.ndarray, np.ndarray], clashes: frozenset[int]) -> DataFrame:
    """What the inverted lists of prefix shingles give: (kind, token, a, b, n, pos).

    kind 0: a pair of classes to compare, each list's head with each other one that
    is near enough; 1: a posting a of a list of three or more, b lists being equal to
    this one; 2: the head a of a part of a frequent shingle's list that is kept in
    several parts. n is a's set size, pos the shingle's place in a's order. The head
    is the class with the fewest rarer shingles before: in a family of edited copies,
    the one closest to the others.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    names, kinds = ["bucket", "tokens", "classes", "sizes", "places", "salts"], (pa.int32(), *[pa.binary()] * 5)

    @releasing
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, df = known.value

        def flush() -> Iterator[pa.RecordBatch]:
            token, cls, n, pos, salt = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = list(_packed(token, cls, n, pos, salt, buckets=buckets, salt=salt.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], names=names)

        held, seen, size = [], set(), 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                if not len(s) or (cls := set_class(s, clashes)) in seen:
                    continue
                seen.add(cls)
                p, n = prefix_length(len(s), percent), len(s)
                salt = np.zeros(p, np.uint32)
                if len(often):
                    at = np.searchsorted(often, s)
                    at[at == len(often)] = 0
                    hot = often[at] == s
                    first = np.flatnonzero(~hot)[:p]
                    if len(first) < p:
                        late = np.flatnonzero(hot)
                        late = late[np.lexsort((s[late], df[at[late]]))][: p - len(first)]
                        parts = -(-df[at[late]] // SUBLIST)
                        salt[len(first) :] = np.where(parts > 1, cls % parts + 1, 0)
                        first = np.r_[first, late]
                    s = s[first]
                else:
                    s = s[:p]
                held.append((s, np.full(p, cls, np.int64), np.full(p, n, np.uint32), np.arange(p, dtype=np.uint32), salt))
                size += p
                if size >= FLUSH:
                    yield from flush()
                    held, seen, size = [], set(), 0
        if held:
            yield from flush()

    @releasing
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(kind: int, token: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
            columns = [np.ascontiguousarray(c, np.int64) for c in (token.view(np.int64), *columns)]
            return pa.record_batch([pa.array(np.full(len(token), kind, np.int32)), *map(pa.array, columns)], names=["kind", "token", "a", "b", "n", "pos"])

        token, cls, n, pos, salt = _unpacked(batches, np.uint64, np.int64, np.uint32, np.uint32, np.uint32)
        if not len(token):
            return
        order = np.lexsort((cls, pos, salt, token))
        token, cls, salt = token[order], cls[order], salt[order]
        n, pos = n[order].astype(np.int64), pos[order].astype(np.int64)
        del order
        same = lambda x: x[1:] == x[:-1]
        keep = np.r_[True, ~(same(token) & same(salt) & same(cls))]
        token, cls, n, pos, salt = (x[keep] for x in (token, cls, n, pos, salt))
        first = np.flatnonzero(np.r_[True, ~(same(token) & same(salt))])
        size = np.diff(np.r_[first, len(token)])
        head = np.repeat(first, size)
        least = -(-percent * (n[head] + n) // (100 + percent))
        near = np.flatnonzero((cls[head] != cls) & (pos[head] <= n[head] - least) & (pos <= n - least))
        if len(near):
            pairs = np.unique(np.stack([cls[head[near]], cls[near]], 1), axis=0)
            none = np.zeros(len(pairs), np.int64)
            yield made(0, none.view(np.uint64), pairs[:, 0], pairs[:, 1], none, none)
        parted = first[salt[first] > 0]
        if len(parted):
            yield made(2, token[parted], cls[parted], parted * 0, n[parted], pos[parted])
        # equal lists of unparted shingles are kept once, by their earliest shingle and with their number
        total = np.add.reduceat(mix(cls.view(np.uint64)), first)
        whole = np.flatnonzero((size >= 3) & (salt[first] == 0))
        by = whole[np.lexsort((pos[first[whole]], size[whole], total[whole]))]
        new = np.flatnonzero(np.r_[True, ~(same(total[by]) & same(size[by]))]) if len(by) else by
        times = np.zeros(len(first), np.int64)
        times[by[new]] = np.diff(np.r_[new, len(by)])
        times[salt[first] > 0] = 1
        weight = np.repeat(times, size)
        post = weight > 0
        if post.any():
            yield made(1, token[post], cls[post], weight[post], n[post], pos[post])

    packed = docs.select("text").mapInArrow(postings, "bucket int, tokens binary, classes binary, sizes binary, places binary, salts binary")
    return packed.repartition(buckets // 4, "bucket").mapInArrow(merged, "kind int, token long, a long, b long, n long, pos long")


def _dealt(pairs: DataFrame) -> DataFrame:
    """(a, part, b): the candidates of a query in parts of bounded size."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    return pairs.join(counts, "a").select("a", F.expr(f"pmod(xxhash64(b), cast(ceil(n / {SUBLIST // 4}) as int))").alias("part"), "b")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity bitmaps, the longer folded onto the shorter, differ in no more bits than the sets of a link can."""
    dealt = _dealt(pairs)
    asked = dealt.select("a", "part").distinct().join(nodes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), "a")
    given = dealt.join(nodes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), "b")
    fold = lambda bits, other: (
        f"case when size({bits}) > size({other}) then zip_with(slice({bits}, 1, size({other})), slice({bits}, size({other}) + 1, size({other})), (p, q) -> p ^ q) else {bits} end"
    )
    least = f"(({percent} * (na + nb) + {99 + percent}) div {100 + percent})"
    differing = f"aggregate(zip_with({fold('x', 'y')}, {fold('y', 'x')}, (p, q) -> bit_count(p ^ q)), 0, (t, d) -> t + d)"
    # bitmaps further apart than one fold, possible below half, are not judged
    within = f"case when greatest(size(x), size(y)) <= 2 * least(size(x), size(y)) then {differing} <= na + nb - 2 * {least} else true end"
    return given.join(asked, ["a", "part"]).where(f"{least} <= least(na, nb)").where(within).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, clashes: frozenset[int]) -> DataFrame:
    """The pairs (a, b) of classes that link, found by DivideSkip with a as the query and its partners as candidates."""
    pairs = written(_likely(pairs, nodes, percent), "likely")
    ids = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    ids = written(nodes.join(ids, "cls", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "needed")
    few = ids.count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    @releasing
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(set_class(s, clashes), s.tobytes()) for _, s in shingle_sets(batch.column(0), k) if len(s)]
            yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["cls", "members"])

    sets_of = wanted.select("text").mapInArrow(sets, "cls long, members binary")
    dealt = _dealt(pairs)
    queries = dealt.select("a", "part").distinct().join(sets_of, F.col("a") == F.col("cls")).select("a", "part", F.lit(None).cast("long").alias("b"), "members")
    candidates = dealt.join(sets_of, F.col("b") == F.col("cls")).select("a", "part", "b", "members")
    rows = queries.union(candidates).repartition(shuffle_partitions(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    @releasing
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                found = divide_skip(query, [s for _, s in held], percent)
                yield pa.record_batch([pa.array([now[0]] * len(found), pa.int64()), pa.array([held[i][0] for i, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["a", "b", "overlap"])

        now, query, held, size = None, np.zeros(0, np.uint64), [], 0
        for batch in batches:
            for a, part, b, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, part) != now or size > 4 * FLUSH:
                    yield from flush()
                    now, held, size = (a, part), [], 0
                if b is None:
                    query = np.frombuffer(members, np.uint64)
                elif not held or held[-1][0] != b:
                    held.append((b, np.frombuffer(members, np.uint64)))
                    size += len(held[-1][1])
        yield from flush()

    links = written(rows.mapInArrow(search, "a long, b long, overlap long").select("a", "b"), "links")
    discard(pairs, ids)
    return links


def jaccard_components(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, n_shingles, component_id), a row a document.

    Words are runs of non-white-space with A-Z lower-cased; a set holds the distinct
    ``shingle``-word sequences of the whole text (a shorter text: its whole
    sequence). Documents link when 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable by links.

    Null and empty texts have an empty set and link with nothing. Repeated rows are
    each returned. A row without doc_id is returned with a null component_id and
    names no component. Other columns are ignored. An empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classes, nodes, clashes = _named_sets(docs, shingle)
    shingles_in_all = nodes.agg(F.sum("n")).first()[0] or 0
    docs = docs.where("doc_id is not null")
    edges = None
    if shingles_in_all:
        share = (100 - percent) / 100
        buckets = 4 * max(shuffle_partitions(spark), math.ceil(1.5 * share * shingles_in_all / 4e6))
        more_than = max(FREQUENT, math.ceil(1.5 * share * shingles_in_all / MAX_FREQUENT))
        frequent = _frequent(docs, shingle, percent, buckets, more_than)
        if len(frequent[0]):
            frequent = _frequent(docs, shingle, percent, buckets, more_than, frequent)
        lists = written(_lists(docs, shingle, percent, buckets, frequent, clashes), "lists")
        edges = _links(lists, docs, nodes, shingle, percent, clashes)
        discard(lists)
    return component_rows(classes, nodes, edges)


def component_rows(classes: DataFrame, nodes: DataFrame, edges: DataFrame | None) -> DataFrame:
    """(doc_id, n_shingles, component_id) from the tables of _named_sets() and the links between classes."""
    if edges is None:
        grouped = nodes.select("cls", F.col("rep").alias("component_id"))
    else:
        parts = components(edges)
        joined = nodes.join(parts, nodes.cls == parts.node, "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
        least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
        grouped = joined.join(least, "component").select("cls", "component_id")
    return classes.join(grouped, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def _links(lists: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, clashes: frozenset[int]) -> DataFrame:
    """Links between classes, enough of them to join all that are linked."""
    least = lambda x, y: f"(({percent} * ({x} + {y}) + {99 + percent}) div {100 + percent})"
    heads = lists.where("kind = 2").select("token", "a", F.col("n").alias("na"), F.col("pos").alias("pa"))
    tops = heads.groupBy("token").agg(F.min(F.struct("pa", "a", "na")).alias("top")).select("token", "top.*")
    across = heads.select("token", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("pa").alias("pb")).join(tops, "token")
    across = across.where(f"a <> b and pa <= na - {least('na', 'nb')} and pb <= nb - {least('na', 'nb')}").select("a", "b")
    pairs = written(lists.where("kind = 0").select("a", "b").union(across).distinct(), "pairs")
    edges = _verified(pairs, docs, nodes, k, percent, clashes)
    # Second look: pairs between components that no list's head has covered.
    parts = components(edges)
    posts = lists.where("kind = 1").select("token", F.col("a").alias("cls"), "n", "pos")
    posts = posts.join(parts, posts.cls == parts.node, "left").select("token", "cls", "n", "pos", F.coalesce("component", "cls").alias("component"))
    most = least("a_n", "b_n")
    met = pairs_across(posts, ["token"], f"a_pos <= a_n - {most} and b_pos <= b_n - {most}")
    seen = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = written(met.join(seen, ["a", "b"], "left_anti"), "more")
    discard(pairs, met, parts)
    if more.isEmpty():
        return edges
    found = _verified(more, docs, nodes, k, percent, clashes)
    discard(more)
    return edges.union(found)
