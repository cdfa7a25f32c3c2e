"""Connected components by graph contraction, and pairs within lists of any length, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, written


#: Members of a list that meet each other in one block.
BLOCK = 4096
#: Rows up to which a table of a few numbers a row is broadcast.
BROADCAST_ROWS = 1_000_000


def pairs_across(posts: DataFrame, keys: list[str], near: str) -> DataFrame:
    """posts (keys, cls, component, others) -> distinct (a, b), a < b: members of one list that lie in different components and are near.

    near is an expression on a_x and b_x, the columns x of the two members. Lists whose
    members all lie in one component are left out. A longer list than BLOCK is cut into
    parts, and every two parts meet in a block of their own, so no task has more than
    two parts of one list and all pairs are looked at.
    """
    lists = posts.groupBy(*keys).agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    lists = written(lists.select(*keys, F.ceil(F.col("members") / BLOCK).cast("int").alias("parts")), "lists")
    few = lists.count() <= BROADCAST_ROWS
    dealt = posts.join(F.broadcast(lists) if few else lists, keys).withColumn("part", F.expr("cast(pmod(xxhash64(cls), parts) as int)"))
    dealt = written(dealt, "dealt")
    others = [c for c in posts.columns if c not in keys]
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in others]
    x = dealt.select(*keys, F.col("part").alias("i"), F.explode(F.expr("sequence(part, parts - 1)")).alias("j"), *side("a"))
    y = dealt.select(*keys, F.explode(F.expr("sequence(0, part)")).alias("i"), F.col("part").alias("j"), *side("b"))
    met = x.join(y, [*keys, "i", "j"]).where(f"(i < j or a_cls < b_cls) and a_component <> b_component and {near}")
    pairs = written(met.select(F.least("a_cls", "b_cls").alias("a"), F.greatest("a_cls", "b_cls").alias("b")).distinct(), "pairs")
    discard(lists, dealt)
    return pairs


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component), component being the smallest node reached; nodes without edges are absent.

    Each round points every node at its smallest neighbour, follows pointers twice
    and contracts the graph, which at least halves the nodes that still have edges.
    Null ends and loops are ignored; repeated and reversed edges count once. While
    pointers are few they are broadcast, so the edges of a node that has most of them
    stay where they are.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "nearest")
        few, to = near.count() <= BROADCAST_ROWS, near
        for _ in range(2):
            via = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            to = to.join(F.broadcast(via) if few else via, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        to = written(to, "pointers")
        if labels is None:
            labels = to.select("node", F.col("to").alias("component"))
        else:
            via = to.select(F.col("node").alias("component"), F.col("to").alias("next"))
            labels = labels.join(F.broadcast(via) if few else via, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        before, labels = labels, written(labels, "labels")
        a = to.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        if few:
            a, b = F.broadcast(a), F.broadcast(b)
        moved = edges.join(a, "a").join(b, "b").where("x <> y")
        done, edges = edges, written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(before, to, done, near)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
