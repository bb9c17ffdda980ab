"""Merging of tracks that must not meet: heaviest links first, never two that are kept apart; and what leads up to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.sources.shared import stored


def kept_apart(obs: DataFrame) -> DataFrame:
    """(seq_id, a, b): pairs of tracks (a < b) that share a frame."""
    a = obs.select("seq_id", "frame_idx", F.col("track_id").alias("a"))
    return a.join(a.withColumnRenamed("a", "b"), ["seq_id", "frame_idx"]).where("a < b").select("seq_id", "a", "b").distinct()


def merged_apart(nodes: DataFrame, links: DataFrame, apart: DataFrame) -> DataFrame:
    """(seq_id, node, root): groups of ``nodes`` (seq_id, node) by ``links`` (seq_id, a, b, weight), heaviest first, ties by a and b.

    A link joins two groups unless a pair of ``apart`` (seq_id, a, b) lies between them. In a round every group picks the heaviest link that it may still
    use, and two that pick each other merge: no other link could have come before theirs, so this is the outcome of taking links one
    after another. What keeps groups apart is kept by group, and links that have become impossible go. The root is the smallest node.
    """
    roots = stored(nodes.select("seq_id", "node", F.col("node").alias("root")).distinct())
    left = stored(links.select("seq_id", F.col("a").alias("ra"), F.col("b").alias("rb"), F.struct(-F.col("weight"), "a", "b").alias("rank")).where("ra != rb"))
    both = apart.select("seq_id", F.col("a").alias("ra"), F.col("b").alias("rb"))
    wall = stored(both.unionByName(both.select("seq_id", F.col("rb").alias("ra"), F.col("ra").alias("rb"))).distinct())
    while True:
        left = left.join(wall, ["seq_id", "ra", "rb"], "left_anti")
        ends = left.select("seq_id", F.col("ra").alias("g"), F.col("rb").alias("h"), "rank").unionByName(left.select("seq_id", F.col("rb").alias("g"), F.col("ra").alias("h"), "rank"))
        pick = ends.groupBy("seq_id", "g").agg(F.min_by("h", "rank").alias("h"))
        pick = stored(pick.join(pick.select("seq_id", F.col("g").alias("h"), F.col("h").alias("g")), ["seq_id", "g", "h"]).where("g < h"))
        if pick.isEmpty():
            return roots
        named = lambda df, c: df.join(pick.select("seq_id", F.col("h").alias(c), F.col("g").alias("_to")), ["seq_id", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        roots = stored(named(roots, "root"))
        left = stored(named(named(left, "ra"), "rb").where("ra != rb").select("seq_id", "ra", "rb", "rank"))
        wall = stored(named(named(wall, "ra"), "rb").select("seq_id", "ra", "rb").distinct())


def layers(edges: DataFrame, nodes: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, node, layer): nodes after all that lead to them, from 0; edges (key, a, b) say a before b.

    In each round the nodes without an edge into them go. Where only circles are left, the node goes that wins more edges than it loses by most (of
    equals the smaller): so every node has a layer.
    """
    left = stored(nodes.select(key, "node").distinct())
    edges = stored(edges.where("a != b").select(key, "a", "b").distinct())
    found, layer = None, 0
    while not left.isEmpty():
        into = edges.select(key, F.col("b").alias("node")).distinct()
        free = left.join(into, [key, "node"], "left_anti")
        stuck = left.join(free.select(key).distinct(), key, "left_anti")
        won, lost = (edges.groupBy(key, F.col(c).alias("node")).agg(F.count("*").alias(n)) for c, n in (("a", "won"), ("b", "lost")))
        rank = F.struct(F.coalesce("lost", F.lit(0)) - F.coalesce("won", F.lit(0)), F.col("node"))
        first = stuck.join(won, [key, "node"], "left").join(lost, [key, "node"], "left").groupBy(key).agg(F.min_by("node", rank).alias("node"))
        out = stored(free.unionByName(first.select(key, "node")).withColumn("layer", F.lit(layer)))
        found = out if found is None else found.unionByName(out)
        gone = out.select(key, "node")
        left = stored(left.join(gone, [key, "node"], "left_anti"))
        for c in ("a", "b"):
            edges = edges.join(gone.withColumnRenamed("node", c), [key, c], "left_anti")
        edges, layer = stored(edges), layer + 1
    return found if found is not None else left.withColumn("layer", F.lit(0))
