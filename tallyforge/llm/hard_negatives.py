"""Hard-negative mining with a multiway hyperplane tree of near-neighbour ranges (GNAT).

Scores are integer inner products. Vectors x are lifted to (x, sqrt(M^2 - |x|^2)), M being
the largest norm, and a query a to (a, 0), so that their distance follows from the score
alone: d^2 = |a|^2 + M^2 - 2 a.x. A window of scores is a ring of distances, an annulus.

A node has split points, and each of its vectors belongs to the nearest one. For every two
split points i, j it keeps the range of the distances from i to what belongs to j. A query
with distance d to i and an annulus [near, far] can have results in j only if that range
meets [max(d - far, near - d), d + far]; where it does not, j's subtree is left out. What
remains is scored exactly in the leaves, so results are exact. The tree is fitted on a
bounded sample; all vectors are assigned to its leaves and measured into its ranges.

In the cluster a leaf is dealt in parts of bounded size, queries travel to the parts that
they cannot leave out, and a task holds one part at a time while its queries stream by.
Vectors that lie in no clusters, such as random ones of many dimensions, are hardly left
out by any such index: then each query meets all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, shuffle_partitions, written

#: Vectors that the tree is fitted on at most; split points of a node; rows of one part of a leaf.
SAMPLE, ARITY, PART = 20_000, 16, 1024
#: Least vectors of the sample in a node that is split, so that a tree has at most about SAMPLE / FEWEST leaves.
FEWEST = 8
#: Queries scored against a part together.
CHUNK = 512


def usable(vector: Column) -> Column:
    """Whether a vector is there and every component, and 256 times it, is a finite number."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * 256) < float("inf"), F.lit(False))), F.lit(False))


@dataclass
class Tree:
    """nodes[k]: (rows of splits, children); a child c >= 0 is a node, else leaf -c - 1. A tree of one leaf has no nodes."""

    splits: np.ndarray
    nodes: list[tuple[np.ndarray, list[int]]] = field(default_factory=list)
    leaves: int = 1
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors as rows with the coordinate that gives all of them the norm sqrt(most)."""
    return np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))]


def fit(sample: np.ndarray, leaf: int, arity: int = ARITY) -> Tree:
    """A tree over lifted vectors, nodes of more than ``leaf`` of them being split by points far apart from each other."""
    splits: list[np.ndarray] = []
    tree = Tree(np.zeros((0, sample.shape[1])), leaves=0)

    def grow(rows: np.ndarray) -> int:
        chosen = _far_apart(sample[rows[: 3 * arity]], arity) if len(rows) > max(leaf, arity) else []
        if len(chosen) < 2:
            tree.leaves += 1
            return -tree.leaves
        at, k = np.arange(len(splits), len(splits) + len(chosen)), len(tree.nodes)
        splits.extend(sample[rows[chosen]])
        tree.nodes.append((at, []))
        nearest = _distances(sample[rows], sample[rows[chosen]]).argmin(axis=1)
        tree.nodes[k] = (at, [grow(rows[nearest == j]) for j in range(len(chosen))])
        return k

    grow(np.arange(len(sample)))
    if splits:
        tree.splits = np.array(splits)
    return tree


def _far_apart(points: np.ndarray, many: int) -> list[int]:
    """Greedily, each next one farthest from those chosen; equal points are chosen once."""
    chosen, gap = [0], _distances(points, points[:1])[:, 0]
    while len(chosen) < many and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(points, points[chosen[-1:]])[:, 0])
    return chosen


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T), 0))


def leaves_of(tree: Tree, x: np.ndarray, ranges: dict | None = None) -> np.ndarray:
    """The leaf of each lifted vector. ranges, if given, takes (node, i, j) -> [least, largest] distance from split point i to what belongs to j."""
    found = np.zeros(len(x), np.int64)
    open_ = [(0, np.arange(len(x)))] if tree.nodes else []
    while open_:
        k, rows = open_.pop()
        if not len(rows):
            continue
        at, children = tree.nodes[k]
        d = _distances(x[rows], tree.splits[at])
        nearest = d.argmin(axis=1)
        for j, child in enumerate(children):
            mine = nearest == j
            if not mine.any():
                continue
            if ranges is not None:
                for i, (a, b) in enumerate(zip(d[mine].min(axis=0), d[mine].max(axis=0), strict=True)):
                    old = ranges.get((k, i, j), (a, b))
                    ranges[k, i, j] = (min(a, old[0]), max(b, old[1]))
            if child >= 0:
                open_.append((child, rows[mine]))
            else:
                found[rows[mine]] = -child - 1
    return found


def reached(tree: Tree, queries: np.ndarray, near: np.ndarray, far: np.ndarray, most: float) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, queries that cannot leave it out): queries as rows, near and far as annuli() gives them (a column a window)."""
    slack = 1e-5 * np.sqrt(most) + 1e-9
    norms = (queries * queries).sum(axis=1)
    rows = np.flatnonzero((far >= near - slack).any(axis=1))
    if not tree.nodes:
        yield 0, rows
        return
    open_ = [(0, rows)]
    while open_:
        k, rows = open_.pop()
        if not len(rows):
            continue
        at, children = tree.nodes[k]
        d = np.sqrt(np.maximum(norms[rows, None] + most - 2 * (queries[rows] @ tree.splits[at, :-1].T), 0))[:, :, None]
        least = np.maximum(d - far[rows, None], near[rows, None] - d) - slack
        largest = d + far[rows, None] + slack
        for j, child in enumerate(children):
            # a window is alive if the ranges of all split points meet it
            alive = ((tree.low[k][None, :, j, None] <= largest) & (tree.high[k][None, :, j, None] >= least)).all(axis=1).any(axis=1)
            if child >= 0:
                open_.append((child, rows[alive]))
            elif alive.any():
                yield -child - 1, rows[alive]


def annuli(norms: np.ndarray, low: np.ndarray, high: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest distances of scores low to high, from queries with these squared norms; the largest is NaN for windows that no vector can be in."""
    whole = norms[:, None] + most
    near, far = whole - 2 * high, whole - 2 * low
    return np.sqrt(np.maximum(near, 0)), np.where(far < -1e-6 * whole, np.nan, np.sqrt(np.maximum(far, 0)))


def best_in_part(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of each query's k best allowed columns; of equal scores the earlier column is better."""
    n = scores.shape[1]
    ranks = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), -np.inf) if scores.dtype != object else np.where(allowed, scores, -np.inf)
    if scores.dtype == object:  # numbers beyond exact doubles
        order = np.array([sorted(range(n), key=lambda c: (-r[c], c))[:k] for r in ranks]).reshape(len(ranks), -1)
    else:
        order = np.argpartition(-ranks, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), (len(ranks), n))
    keep = np.take_along_axis(allowed, order, axis=1)
    who = np.broadcast_to(np.arange(len(order))[:, None], order.shape)
    return who[keep], order[keep]


class Index:
    """The tree with its ranges, the vectors by leaf and part, and what tasks need to use them."""

    def __init__(self, points: DataFrame, size: int, kind: str, most: float):
        """points (label, v, ids): different (label, v), v a vector's ``size`` components in bytes; most: the largest squared norm."""
        self.spark, self.size, self.kind, self.most = points.sparkSession, size, kind, most
        self.exact = most * PART * 2 < 2**53
        n = points.count()
        sample = points.select("v").orderBy(F.xxhash64("v", "label")).limit(SAMPLE).toArrow().column("v")
        leaf = max(FEWEST, int(min(n, SAMPLE) * PART / max(n, 1)))
        self.tree = fit(lifted(_matrix(sample, size, kind), most), leaf)
        shared = self.spark.sparkContext.broadcast(self.tree)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = lifted(_matrix(batch.column("v"), size, kind), most)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves_of(shared.value, x).astype(np.int32))], names=["label", "v", "ids", "leaf"])

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranges: dict = {}
            for batch in batches:
                leaves_of(shared.value, lifted(_matrix(batch.column(0), size, kind), most), ranges)
            yield pa.record_batch([pa.array([key[i] for key in ranges], pa.int32()) for i in range(3)] + [pa.array([r[i] for r in ranges.values()], pa.float64()) for i in range(2)], names=["node", "i", "j", "low", "high"])

        self.placed = written(points.mapInArrow(assign, "label int, v binary, ids array<long>, leaf int"), "placed")
        self._measured(self.placed.select("v").mapInArrow(measure, "node int, i int, j int, low double, high double"))
        counts = {r["leaf"]: r["n"] for r in self.placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a number a leaf
        self.parts = {leaf: -(-n // PART) for leaf, n in counts.items()}

    def _measured(self, ranges: DataFrame) -> None:
        """Put the ranges of all vectors into the tree: a number for two split points of a node."""
        for at, _ in self.tree.nodes:
            self.tree.low.append(np.full((len(at), len(at)), np.inf))
            self.tree.high.append(np.full((len(at), len(at)), -np.inf))
        for r in ranges.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            self.tree.low[r["node"]][r["i"], r["j"]], self.tree.high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]

    def search(self, queries: DataFrame, k: int, same: bool, *, home: bool = False) -> DataFrame:
        """queries (qid, label, v, lows, highs) -> (qid, window, score, id): the k best of each window of scores, by score and then id, among points of the same or of other labels.

        home: only one part of the leaf in which the query itself lies, for a first bound.
        """
        size, kind, most, exact, parts = self.size, self.kind, self.most, self.exact, self.parts
        shared = self.spark.sparkContext.broadcast(self.tree)

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _matrix(batch.column("v"), size, kind)
                if home:
                    leaves = leaves_of(shared.value, np.c_[q, np.zeros(len(q))])
                    stops = [(leaf, np.flatnonzero(leaves == leaf)) for leaf in np.unique(leaves)]
                else:
                    low, high = (_windows(batch.column(c), end) for c, end in (("lows", -np.inf), ("highs", np.inf)))
                    stops = reached(shared.value, q, *annuli((q * q).sum(axis=1), low, high, most), most)
                for leaf, rows in stops:
                    there = batch.take(pa.array(rows))
                    for part in range(parts.get(int(leaf), 0)):
                        some = there.filter(pa.array(there.column("qid").to_numpy() % parts[int(leaf)] == part)) if home else there
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), leaf, np.int32)), pa.array(np.full(len(some), part, np.int32)), *some.columns], names=["leaf", "part", "qid", "label", "v", "lows", "highs"])

        asked = queries.select("qid", "label", "v", "lows", "highs").mapInArrow(sent, "leaf int, part int, qid long, label int, v binary, lows array<long>, highs array<long>")
        table = self.spark.createDataFrame(sorted((int(a), int(b)) for a, b in self.parts.items()), "leaf int, parts int")
        members = self.placed.join(F.broadcast(table), "leaf")
        none = F.lit(None)
        members = members.select("leaf", F.expr("cast(pmod(xxhash64(v, label), parts) as int)").alias("part"), none.cast("long").alias("qid"), "label", "v", none.cast("array<long>").alias("lows"), none.cast("array<long>").alias("highs"), "ids")
        rows = members.unionByName(asked.withColumn("ids", none.cast("array<long>")))
        rows = rows.repartition(shuffle_partitions(self.spark), "leaf", "part").sortWithinPartitions("leaf", "part", F.col("qid").asc_nulls_first(), F.element_at("ids", 1))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, part = None, [], None
            for batch in batches:
                key = np.stack([batch.column("leaf").to_numpy(), batch.column("part").to_numpy()])
                cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]) if batch.num_rows else []
                for first, last in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                    piece = batch.slice(first, last - first)
                    if now != tuple(key[:, first]):
                        now, held, part = tuple(key[:, first]), [], None
                    n_members = piece.column("qid").null_count
                    if n_members:
                        held.append(piece.slice(0, n_members))
                    for start in range(n_members, len(piece), CHUNK):
                        if part is None and held:
                            part = _Part(pa.Table.from_batches(held), size, kind, exact)
                        if part is not None:
                            yield from part.answers(piece.slice(start, min(CHUNK, len(piece) - start)), k, same)

        found = rows.select("leaf", "part", "qid", "label", "v", "lows", "highs", "ids").mapInArrow(scored, "qid long, window int, score long, id long")
        return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best ids of each query and window; what no task needs is left out before the shuffle."""
    place = F.row_number().over(Window.partitionBy("qid", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


class _Part:
    """The members of one part of a leaf, ordered by their smallest id."""

    def __init__(self, members: pa.Table, size: int, kind: str, exact: bool):
        self.size, self.kind, self.exact = size, kind, exact
        self.x = _typed(_matrix(members.column("v"), size, kind), exact)
        self.labels = members.column("label").to_numpy()
        self.ids = members.column("ids").to_pylist()

    def answers(self, queries: pa.RecordBatch, k: int, same: bool) -> Iterator[pa.RecordBatch]:
        q = _typed(_matrix(queries.column("v"), self.size, self.kind), self.exact)
        scores = q @ self.x.T
        fits = (queries.column("label").to_numpy()[:, None] == self.labels[None]) == same
        low, high = (_windows(queries.column(c), end, self.exact) for c, end in (("lows", -np.inf), ("highs", np.inf)))
        qids = queries.column("qid").to_numpy()
        for w in range(low.shape[1]):
            who, col = best_in_part(scores, fits & (scores >= low[:, w, None]) & (scores <= high[:, w, None]), k)
            if not len(who):
                continue
            lists = [self.ids[c] for c in col]
            many = [len(x) for x in lists]
            found = np.repeat(scores[who, col], many)
            columns = [pa.array(np.repeat(qids[who], many)), pa.array(np.full(len(found), w, np.int32)), pa.array(found.astype(np.int64) if self.exact else found.tolist(), pa.int64()), pa.array([i for x in lists for i in x], pa.int64())]
            yield pa.record_batch(columns, names=["qid", "window", "score", "id"])


def _typed(x: np.ndarray, exact: bool) -> np.ndarray:
    """Doubles where products are exact in them, else Python's integers."""
    return x if exact else np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)


def _matrix(column: pa.Array | pa.ChunkedArray, size: int, kind: str) -> np.ndarray:
    """Vectors in bytes as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([np.zeros((0, size)), *(_matrix(c, size, kind) for c in column.chunks)])
    flat = np.frombuffer(b"".join(v.as_py() for v in column), kind)
    return flat.reshape(len(column), size).astype(np.float64)


def _windows(column: pa.Array, end: float, exact: bool = True) -> np.ndarray:
    """Lists of bounds as rows, a null bound being ``end``; shorter lists are filled up with windows that hold nothing."""
    lists = column.to_pylist()
    found = np.full((len(lists), max([1, *map(len, lists)])), -end, np.float64 if exact else object)
    for i, x in enumerate(lists):
        found[i, : len(x)] = [end if b is None else b for b in x]
    return found


def _packed(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """(vec_id, label, v, norm): floor(256 * x) of each component in bytes, filled up with zeros to one size, and their squared norm."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            flat, x = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False)), np.zeros((len(lists), size))
            for i in range(len(lists)):
                x[i, : ends[i + 1] - ends[i]] = flat[ends[i] : ends[i + 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array((x * x).sum(axis=1))], names=["vec_id", "label", "v", "norm"])

    return rows.mapInArrow(pack, "vec_id long, label int, v binary, norm double")


def mine(vectors: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """vectors (vec_id, label, vector) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which the condition on vec_id holds. Components count as
    floor(256 * x), and a row's score is its integer inner product with the anchor. An
    anchor's positives are its best other rows of the same label; for each of them the
    negatives are the best rows of other labels with least_percent * positive_score <=
    100 * negative_score <= 100 * positive_score. Higher scores are better, then smaller
    ids; where there are fewer, all count. Exact, whatever the tree leaves out.

    Rows without id, label or vector, and those with a null or non-finite component
    (256 times it included), take no part. A shorter vector counts as filled up with
    zeros. Of several rows with one vec_id that of the smallest label, then of the
    smallest vector in bytes, counts. Points are different (label, vector); of equal rows
    only the smallest ids are carried, which are all that can be among the best. Other
    columns are ignored; an empty table gives none. Scores beyond a long are an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    told = rows.agg(F.max(F.size("vector")).alias("size"), F.max(F.array_max(F.transform("vector", F.abs))).alias("largest")).first()
    if told["size"] is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    size, kind = told["size"], "<i2" if 256 * (told["largest"] or 0) < 32767 else "<f8"
    once = F.min(F.struct("label", "v", "norm")).alias("row")
    packed = written(_packed(rows, size, kind).groupBy("vec_id").agg(once).select("vec_id", "row.*"), "packed")
    most = packed.agg(F.max("norm")).first()[0]
    firsts = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    some = packed.select("vec_id", "label", "v").withColumn("place", firsts).where(F.col("place") <= max(positives + 1, negatives))
    points = written(some.groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    index = Index(points, size, kind, most)

    asked = packed.where(anchors).select(F.col("vec_id").alias("anchor_id"), "label", "v")
    queries = written(asked.select("label", "v").distinct().withColumn("qid", F.monotonically_increasing_id()), "queries")
    unbounded = F.array(F.lit(None).cast("long"))
    first = index.search(queries.withColumns({"lows": unbounded, "highs": unbounded}), positives + 1, True, home=True)
    bound = written(first.where(F.col("place") == positives + 1).select("qid", "score"), "bound")
    best = index.search(queries.join(bound, "qid", "left").withColumns({"lows": F.array("score"), "highs": unbounded}), positives + 1, True)
    best = written(best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("best")), "best")
    scores = F.array_distinct(F.filter(F.transform("best", lambda p: -p["less"]), lambda s: s >= 0))
    ringed = queries.join(best.select("qid", scores.alias("highs")), "qid").where(F.size("highs") > 0)
    ringed = written(ringed.withColumn("lows", F.expr(f"transform(highs, s -> (s * {least_percent} + 99) div 100)")), "ringed")
    hard = index.search(ringed, negatives, False).join(ringed.select("qid", "highs"), "qid").withColumn("positive_score", F.col("highs")[F.col("window")])
    hard = hard.groupBy("qid").agg(F.collect_list(F.struct("positive_score", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))).alias("hard"))
    results = written(queries.join(best, "qid").join(hard, "qid").select("label", "v", "best", "hard"), "results")
    discard(points, queries, bound, best, ringed, index.placed)

    others = F.slice(F.filter("best", lambda p: p["id"] != F.col("anchor_id")), 1, positives)
    each = asked.join(results, ["label", "v"]).select("anchor_id", F.explode(others).alias("positive"), "hard").select("anchor_id", F.col("positive.id").alias("positive_id"), (-F.col("positive.less")).alias("score"), "hard")
    return each.select("anchor_id", "positive_id", F.inline(F.filter("hard", lambda h: h["positive_score"] == F.col("score")))).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
