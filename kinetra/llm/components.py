"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each end of a link (a, b) the smallest node it reaches; links with itself or null are none.

    Each round points neighbours at the smallest one near them, by an aggregate and a merge join, so that no node's
    neighbours are ever gathered and nothing is broadcast; the rounds needed grow with the logarithm of the number of
    nodes. A round's edges are written to the shared folder, which cuts the lineage.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if now == before or not now[0]:
            break
        before = now
        # Large star: each node's larger neighbours go to the smallest node next to it.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: each node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least.hint("merge"), "u").select("m", F.explode(F.array("u", "v")).alias("u"))
        edges = written(moved.where("u != m").select("u", F.col("m").alias("v")).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
