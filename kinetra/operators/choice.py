"""Choices whose outcome depends on order, made in rounds of joins and aggregates over a sparse table of conflicts or links.

A round decides, for all groups at once, whatever no undecided row can change any more; the tables shrink from round to
round, and no group is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.sources.shared import stored


def suppressed(conflicts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node): what an ordered suppression takes out.

    A row of ``conflicts`` (keys, first, then) says that ``first`` comes first and takes ``then`` out, unless it is taken out
    itself; nothing comes before itself. In each round the nodes that nothing undecided precedes stay, and what they take out goes.
    """
    left = stored(conflicts.select(*keys, "first", "then").distinct())
    node = lambda side: left.select(*keys, F.col(side).alias("node"))
    gone = None
    while not left.isEmpty():
        kept = node("first").subtract(node("then"))
        out = left.join(kept.withColumnRenamed("node", "first"), [*keys, "first"], "left_semi").select(*keys, F.col("then").alias("node")).distinct()
        out = stored(out)
        gone = out if gone is None else gone.unionByName(out)
        decided = out.unionByName(kept)
        left = stored(left.join(decided.withColumnRenamed("node", "first"), [*keys, "first"], "left_anti").join(out.withColumnRenamed("node", "then"), [*keys, "then"], "left_anti"))
    return gone if gone is not None else left.select(*keys, F.col("first").alias("node"))


def accepted(links: DataFrame, keys: list[str], a_likes: list[Column | str], b_likes: list[Column | str]) -> DataFrame:
    """(keys, a, b): one-to-one pairs by deferred acceptance over ``links`` (keys, a, b and what both go by, smaller first).

    Each a asks the b that it likes best of those that have not turned it down; each b holds the one it likes best of those that
    ask and turns down all that it likes less. It ends when nobody is turned down. If all b like the a's alike,
    as by their order, this is what they get by choosing one after another; if both sides go by the same
    costs, the pairs are those of taking the cheapest link left, again and again. Ties go to smaller ids.
    """
    order = lambda likes, last: F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"_{k}") for k, c in enumerate(likes)], F.col(last).alias("last"))
    left = stored(links.select(*keys, "a", "b", order(a_likes, "b").alias("_a"), order(b_likes, "a").alias("_b")).distinct())
    n = left.count()
    while True:
        asked = left.groupBy(*keys, "a").agg(F.min_by(F.struct("b", "_b"), "_a").alias("best")).select(*keys, "best.b", F.col("best._b").alias("_held"))
        held = asked.groupBy(*keys, "b").agg(F.min("_held").alias("_held"))
        now = stored(left.join(held, [*keys, "b"], "left").where(F.col("_held").isNull() | (F.col("_b") <= F.col("_held"))).drop("_held"))
        if (m := now.count()) == n:
            return now.groupBy(*keys, "a").agg(F.min_by("b", "_a").alias("b"))
        left, n = now, m


def compressed(links: DataFrame, keys: list[str], most: float, cost: str = "cost") -> DataFrame:
    """Links of a cost under ``most``; what has none left on its side is no longer there."""
    return links.where(F.col(cost) < most).select(*keys, "a", "b", cost)
