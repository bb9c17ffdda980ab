"""Whether two tracks came out of an encounter under each other's names: their poses before held against their poses after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.functions import geometry as g
from kinetra.operators.pose import POSE, SIGMAS, wide
from kinetra.sources.shared import written

EVENT = ["seq_id", "a", "b", "entry_frame", "exit_frame"]


def likeness(a: Column, b: Column, scale: Column) -> Column:
    """Object keypoint similarity of two poses (arrays of x, y, s by joint); 0 where they share no visible joint."""
    seen = F.zip_with(a, b, lambda p, q: (p["s"] > 0.01) & (q["s"] > 0.01))
    far2 = F.zip_with(a, b, lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))
    each = F.zip_with(far2, F.array(*[F.lit(v * v) for v in SIGMAS]), lambda d, v: F.exp(-d / (2 * scale * v + 1e-9)))
    total = F.aggregate(F.zip_with(each, seen, lambda k, v: F.when(v, k).otherwise(0.0)), F.lit(0.0), lambda t, k: t + k)
    return F.coalesce(total / F.nullif(F.size(F.filter(seen, lambda v: v)), F.lit(0)), F.lit(0.0))


def _next_to(asked: DataFrame, frames: DataFrame, keys: list[str], at: str, most: int, earlier: bool) -> DataFrame:
    """``asked`` with the ``most`` of its ``frames`` (keys, frame_idx) that are the last ones before ``at``, or else the first ones from it on: a row for each.

    Both go through one window in order of frames, each frame with those next to it, so no event meets all frames of its track.
    """
    order = (lambda c: F.col(c).asc()) if earlier else (lambda c: F.col(c).desc())
    near = F.collect_list("frame_idx").over(Window.partitionBy(*keys).orderBy(order("frame_idx")).rowsBetween(1 - most, 0))
    # Of a frame and an event at it the event comes first if the frame is not to count for it.
    known = frames.select(*keys, F.col("frame_idx").alias("_at"), F.lit(int(earlier)).alias("_kind"), near.alias("_near"), F.lit(None).cast(asked.schema.simpleString()).alias("_asked"))
    ask = asked.select(*keys, F.col(at).alias("_at"), F.lit(int(not earlier)).alias("_kind"), F.lit(None).cast("array<bigint>").alias("_near"), F.struct(*asked.columns).alias("_asked"))
    last = F.last("_near", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return known.unionByName(ask).withColumn("_near", last).where("_asked is not null").select("_asked.*", F.explode("_near").alias("frame_idx"))


def temporal_audit(events: DataFrame, kp: DataFrame, boxes: DataFrame, clean: float = 0.3, before: int = 5, after: int = 5, margin: float = 0.05) -> DataFrame:
    """Per ended event (seq_id, a, b, entry_frame, exit_frame): standard, swapped and swap.

    The last ``before`` clean poses of each track ahead of the entry meet its first ``after`` ones from the exit on, in frames that have both
    tracks; clean poses have 17 joints and a mean score of ``clean`` or more. ``standard`` is the sum over both tracks of the mean likeness to
    its own later poses, ``swapped`` to the other's; the names are to be exchanged (``swap``) if that is larger by ``margin``. Null where a
    track has no clean pose on one side.
    """
    ended = written(events.where("exit_frame is not null").select(*EVENT))
    area = boxes.select(*POSE, F.greatest(g.area(), F.lit(1.0)).alias("area"))
    poses = wide(kp).where((F.size("kp") >= 17) & (F.aggregate("kp", F.lit(0.0), lambda t, k: t + k["s"]) / 17 >= clean)).join(area, [*POSE])
    sides = ended.select(*EVENT, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("track_id"), F.col("b").alias("other")), F.struct(F.lit("b").alias("side"), F.col("b").alias("track_id"), F.col("a").alias("other")))).alias("s"))
    sides = sides.select(*EVENT, "s.*")
    whole = poses.select(*POSE)
    there = boxes.select("seq_id", F.col("track_id").alias("other"), "frame_idx")
    shared = whole.join(sides.select("seq_id", "track_id", "other").distinct(), ["seq_id", "track_id"]).join(there, ["seq_id", "other", "frame_idx"], "left_semi")
    pre = _next_to(sides, whole, ["seq_id", "track_id"], "entry_frame", before, earlier=True).join(poses, [*POSE])
    post = _next_to(sides, shared, ["seq_id", "track_id", "other"], "exit_frame", after, earlier=False).join(poses, [*POSE])
    both = pre.select(*EVENT, "side", F.col("kp").alias("p"), F.col("area").alias("pa")).join(post.select(*EVENT, F.col("side").alias("later"), F.col("kp").alias("q"), F.col("area").alias("qa")), EVENT)
    told = both.groupBy(*EVENT, "side", "later").agg(F.avg(likeness(F.col("p"), F.col("q"), F.greatest("pa", "qa"))).alias("like"))
    told = told.groupBy(*EVENT).agg(*[F.sum(F.when(c, F.col("like"))).alias(n) for n, c in (("standard", F.expr("side = later")), ("swapped", F.expr("side != later")))], F.count("*").alias("n"))
    full = ended.join(told.where("n = 4").drop("n"), EVENT, "left")
    return full.withColumn("swap", F.col("swapped") > F.col("standard") + margin)
