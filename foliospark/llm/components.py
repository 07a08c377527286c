"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import cut_lineage, stored

# Edges that one task reduces to the star forest of its part of the graph, before parts meet in rounds.
BLOCK = 100_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, smallest node that the task's edges reach from it)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = [x for x in up if up[x] != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of the edges (a, b) that is not its component's smallest node, with that node.

    Nulls and loops are ignored.  Blocks of ``BLOCK`` edges are first reduced to star forests, each in a task of its own; if one
    block holds all edges, that is the result, and no round of shuffles is spent on it.  A step joins each node with the minimum of its neighbours; minima are combined before
    the shuffle, so a node with very many neighbours costs no more than its edges.  The number of rounds grows with the
    logarithm of the longest chain.  Every round is checkpointed in the shared folder.
    """
    edges = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    blocks = max(1, -(-edges.count() // BLOCK))
    edges = cut_lineage(edges.repartition(blocks).mapInArrow(_forest, "a long, b long"))
    if blocks == 1:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        edges = cut_lineage(_small(_large(edges)))
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def led_pairs(members: DataFrame, close: str) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) to verify, bundles (key, node, further columns, lead)) of nodes that share a key.

    ``members`` holds distinct (key, node) and what ``close``, a condition on two rows named a and b, compares; it is tested
    where rows lie beside the smallest node of their key.  The nodes close to that one are its bundle and paired with it; the
    others are paired with all close nodes of the key.  What remains are pairs inside a bundle, see :func:`bundle_pairs`; a
    bundle of two nodes has none and is left out.
    """
    rest = [c for c in members.columns if c not in ("key", "node")]
    own = Window.partitionBy("key")
    rows = members.select("key", F.struct("node", *rest).alias("a"))
    rows = rows.withColumn("b", F.first("a").over(own.orderBy("a.node")))
    rows = rows.withColumn("loose", ~F.expr(f"a.node = b.node or ({close})"))
    rows = rows.withColumns({"apart": F.max("loose").over(own), "nodes": F.sum(F.expr("if(loose, 0, 1)")).over(own)})
    # Rows whose pair with the lead is all there is to say keep nothing else.
    again = F.expr("apart or nodes > 2")
    rows = rows.where(again | F.expr("a.node <> b.node")).select(
        F.when(again, F.col("key")).alias("key"), F.col("a.node").alias("node"), *(F.when(again, F.col(f"a.{c}")).alias(c) for c in rest),
        F.col("b.node").alias("lead"), "loose", "apart", "nodes",
    )
    rows = stored(rows)
    every = rows.where("apart").drop("apart", "nodes", "lead")
    found = every.where("loose").alias("a").join(every.alias("b"), F.expr(f"a.key = b.key and a.node <> b.node and (not b.loose or a.node > b.node) and {close}"))
    star = rows.where("not loose and node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    return star.union(found.select("a.node", "b.node")).distinct(), rows.where("not loose and nodes > 2").select("key", "node", *rest, "lead")


def bundle_pairs(bundles: DataFrame, groups: DataFrame, close: str) -> DataFrame:
    """Close pairs (a, b) inside bundles, without the lead, that ``groups`` (node, component) does not join: those outside the
    largest group of a bundle with all nodes of other groups.  A bundle on which all agree gives none."""
    placed = bundles.join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node")).drop("component")
    sizes = placed.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("nodes"))
    mixed = sizes.groupBy("key").agg(F.max_by("grp", "nodes").alias("major"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    placed = cut_lineage(placed.join(mixed, "key").where("node <> lead").drop("lead"))
    cond = F.expr(f"a.key = b.key and a.grp <> b.grp and (b.grp = b.major or a.node < b.node) and {close}")
    return placed.where("grp <> major").alias("a").join(placed.alias("b"), cond).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
