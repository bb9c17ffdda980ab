"""Groups of linked things, without gathering a group anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.sources.shared import written


def groups(links: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, node, root): for each end of a link (key, a, b) the smallest node that it reaches within its key.

    Each round a node takes the smallest root among itself and its neighbours, and then that root's own root, so
    paths halve; it ends when no root changes. Links with themselves or null are none.
    """
    edges = links.where("a != b").select(key, "a", "b")
    both = written(edges.union(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = written(both.groupBy(key, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(roots.select(key, F.col("node").alias("b"), F.col("root").alias("near")), [key, "b"]).groupBy(key, F.col("a").alias("node")).agg(F.min("near").alias("near"))
        met = roots.join(near, [key, "node"]).select(key, "node", "root", F.least("root", "near").alias("next"))
        far = roots.select(key, F.col("node").alias("next"), F.col("root").alias("far"))
        moved = written(met.join(far, [key, "next"]).select(key, "node", F.col("root").alias("was"), F.least("next", "far").alias("root")))
        roots = moved.select(key, "node", "root")
        if moved.where("was != root").isEmpty():
            return roots
