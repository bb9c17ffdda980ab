"""Operators on keypoints (seq_id, track_id, frame_idx, j, x, y, s; joints 0 to 16)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.functions import geometry as g
from kinetra.operators import choice
from kinetra.sources.shared import stored

#: Joints (end, vertex, end) of each angle; an end of two joints is the middle between them.
HIPS = (11, 12)
ANGLES = {"left_shoulder": (7, 5, HIPS), "right_shoulder": (8, 6, HIPS), "left_elbow": (5, 7, 9), "right_elbow": (6, 8, 10), "left_knee": (11, 13, 15), "right_knee": (12, 14, 16)}
#: Spread of each joint in object keypoint similarity.
SIGMAS = (0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089)
LOWER, TORSO, SHOULDERS = (13, 14, 15, 16), (5, 6, 11, 12), (5, 6)
LEAST_SCORE = 0.3
TRACK = ("seq_id", "track_id")
POSE = (*TRACK, "frame_idx")


def wide(kp: DataFrame) -> DataFrame:
    """One row for each pose: array ``kp`` of (x, y, s) by joint."""
    rows = kp.groupBy(*POSE).agg(F.sort_array(F.collect_list(F.struct("j", "x", "y", "s"))).alias("kp"))
    return rows


def _at(j: int, c: str) -> Column:
    return F.col("kp")[j][c]


def joint_angles(kp: DataFrame) -> DataFrame:
    """(seq_id, track_id, frame_idx, joint, angle): null where one of the joints scores under 0.3 or an arm has no length."""
    place = lambda j, c: (_at(j[0], c) + _at(j[1], c)) / 2 if isinstance(j, tuple) else _at(j, c)
    angles = []
    for name, ends in ANGLES.items():
        joints = [k for j in ends for k in (j if isinstance(j, tuple) else (j,))]
        sure = F.least(*[_at(j, "s") for j in joints]) >= LEAST_SCORE
        value = g.angle(*[place(j, v) for j in ends for v in "xy"])
        angles.append(F.struct(F.lit(name).alias("joint"), F.when(sure, value).alias("angle")))
    return wide(kp).select(*POSE, F.explode(F.array(*angles)).alias("r")).select(*POSE, "r.joint", "r.angle")


def consensus(angles: DataFrame, half: int = 2) -> DataFrame:
    """Per sequence, frame and joint: circular mean (period 180 degrees) over tracks, and its centred median over frames."""
    twice = F.radians(F.col("angle") * 2)
    mean = F.degrees(F.atan2(F.avg(F.sin(twice)), F.avg(F.cos(twice)))) / 2
    per = angles.where("angle is not null").groupBy("seq_id", "frame_idx", "joint").agg(F.pmod(mean + 180, F.lit(180.0)).alias("circular_mean"), F.stddev_pop("angle").alias("ripple"))
    near = Window.partitionBy("seq_id", "joint").orderBy("frame_idx").rowsBetween(-half, half)
    return per.withColumn("truth", F.percentile("circular_mean", F.lit(0.5)).over(near))


def deviations(angles: DataFrame, truth: DataFrame, most_ripple: float = 30.0) -> DataFrame:
    """Distance of each angle from the consensus (period 180), none where the group itself disagrees."""
    d = F.abs(F.col("angle") - F.col("truth"))
    dev = F.when(F.col("ripple") <= most_ripple, F.least(d, 180 - d))
    return angles.join(truth, ["seq_id", "frame_idx", "joint"]).select(*POSE, "joint", dev.alias("deviation"))


def summaries(dev: DataFrame) -> DataFrame:
    """Per track: mean deviation, synchronisation score and its three worst joints."""
    per = dev.groupBy(*TRACK, "joint").agg(F.round(F.avg("deviation"), 6).alias("d")).where("d is not null")
    worst = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("d")).alias("d"), "joint"))), 1, 3)
    joints = per.groupBy(*TRACK).agg(F.array_join(F.transform(worst, lambda r: r["joint"]), ",").alias("worst_joints"))
    mean = dev.groupBy(*TRACK).agg(F.avg("deviation").alias("mean_deviation"))
    return mean.join(joints, [*TRACK]).select(*TRACK, "mean_deviation", F.round(F.greatest(F.lit(0.0), 100 - 2 * F.col("mean_deviation")), 1).alias("sync_score"), "worst_joints")


def facts(kp: DataFrame, unseen: float = 0.1, unsure: float = 0.15, sure: float = 0.5, most_gap: int = 2) -> DataFrame:
    """Per track what the pose rules ask: scores by part of the body, movement of a joint between frames at most two apart, first and last pose."""
    s, w = F.col("s"), Window.partitionBy(*TRACK, "j").orderBy("frame_idx")
    part = lambda joints: F.when(F.col("j").isin(*joints), s)
    moved = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2)))
    near = F.when(F.col("frame_idx") - F.lag("frame_idx").over(w) <= most_gap, moved)
    joints = kp.withColumn("moved", near).groupBy(*TRACK).agg(F.percentile(part(LOWER), F.lit(0.95)).alias("lower_p95"), F.avg(part(SHOULDERS)).alias("shoulders"), F.avg("moved").alias("mean_move"))
    frames = kp.groupBy(*POSE).agg(F.avg("s").alias("m"), F.avg(part(LOWER)).alias("lower"), F.avg(part(TORSO)).alias("torso"))
    share = lambda c: F.avg(c.cast("double"))
    poses = frames.groupBy(*TRACK).agg(
        F.count("*").alias("n_poses"), F.min("frame_idx").alias("first_pose"), F.max("frame_idx").alias("last_pose"), F.percentile("m", F.lit(0.75)).alias("score_p75"),
        F.avg("lower").alias("lower_mean"), share(F.col("lower") < unseen).alias("lower_unseen"), share(F.col("lower") < LEAST_SCORE).alias("lower_low"),
        share(F.col("torso") >= sure).alias("torso_share"), share(F.col("m") < unsure).alias("unsure_share"),
    )
    return poses.join(joints, [*TRACK])


def legacy_mirrors(facts: DataFrame, most: float = 0.5) -> DataFrame:
    """Tracks whose lower body scores under 0.3 in more than ``most`` of their poses."""
    return facts.where(F.col("lower_low") > most).select(*TRACK)


def smoothed(kp: DataFrame, radius: int = 2) -> DataFrame:
    """Positions averaged over frames at most ``radius`` apart, weighted by score over one plus the distance in frames."""
    near = kp.select(*TRACK, "j", F.explode(F.sequence(F.col("frame_idx") - radius, F.col("frame_idx") + radius)).alias("frame_idx"), F.col("frame_idx").alias("f"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("s").alias("ns"))
    w = F.col("ns") / (1 + F.abs(F.col("f") - F.col("frame_idx")))
    sums = near.groupBy(*TRACK, "j", "frame_idx").agg(F.sum(w).alias("w"), F.sum(w * F.col("nx")).alias("wx"), F.sum(w * F.col("ny")).alias("wy"))
    out = kp.join(sums, [*TRACK, "j", "frame_idx"])
    return out.select(*POSE, "j", *[F.when(F.col("w") > 0, F.col(f"w{c}") / F.col("w")).otherwise(F.col(c)).alias(c) for c in "xy"], "s")


def similarity(kp: DataFrame, boxes: DataFrame) -> DataFrame:
    """Object keypoint similarity of the poses of two tracks (a < b) in a frame, over joints that both see.

    The scale is the mean area of both boxes (``boxes``: seq_id, track_id, frame_idx, x1, y1, x2, y2), one at least.
    """
    rows = kp.join(boxes.select(*POSE, g.area().alias("area")), [*POSE])
    a, b = (rows.select("seq_id", "frame_idx", "j", F.col("track_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("x", "y", "s", "area")]) for s in "ab")
    pairs = a.join(b, ["seq_id", "frame_idx", "j"]).where("a < b and a_s > 0.01 and b_s > 0.01")
    sigma = F.element_at(F.array(*[F.lit(x) for x in SIGMAS]), F.col("j") + 1)
    d2 = F.pow(F.col("a_x") - F.col("b_x"), F.lit(2)) + F.pow(F.col("a_y") - F.col("b_y"), F.lit(2))
    scale = F.greatest((F.col("a_area") + F.col("b_area")) / 2, F.lit(1.0))
    return pairs.groupBy("seq_id", "frame_idx", "a", "b").agg(F.avg(F.exp(-d2 / (2 * scale * sigma * sigma + 1e-9))).alias("oks"), F.count("*").alias("n_joints"))


def low_sync(angles: DataFrame, truth: DataFrame, least: int = 15) -> DataFrame:
    """Per track: the largest absolute correlation of a joint's angle with the consensus, over joints with enough frames."""
    both = angles.join(truth.select("seq_id", "frame_idx", "joint", "truth"), ["seq_id", "frame_idx", "joint"]).where("angle is not null")
    per = both.groupBy(*TRACK, "joint").agg(F.count("*").alias("n"), F.corr("angle", "truth").alias("r"), F.stddev_pop("angle").alias("sd"), F.stddev_pop("truth").alias("sd_truth"))
    return per.where((F.col("n") >= least) & (F.col("sd") >= 1e-6) & (F.col("sd_truth") >= 1e-6)).groupBy(*TRACK).agg(F.max(F.abs("r")).alias("best_r"))


@dataclass(frozen=True)
class Duplicates:
    """When two poses of a frame are one person twice. Distances are shares of the taller box's height (a pixel at least)."""

    joints: float = 0.26
    centres: float = 0.5
    overlap: float = 0.12
    tight: float = 0.20
    torso: float = 0.24
    oks: float = 0.68

    def conflicts(self, kp: DataFrame, boxes: DataFrame, protected: DataFrame | None = None, counts: bool = True) -> DataFrame:
        """(seq_id, frame_idx, a, b, loser) of duplicates, a < b.

        Boxes do not contain each other (0.7: two people at different depths), median joint and torso distances are small,
        the poses alike, and boxes overlap or joints are tight; centres are near unless joints are tight. The track with fewer
        observations loses, of equals the larger id; with ``counts`` off the lower mean score loses. ``protected``
        (seq_id, track_id) tracks lose only to what is clearly the same, and not by joints alone against a track of thrice their length.
        Poses with fewer than 17 joints are not compared.
        """
        box = boxes.select(*POSE, *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
        n = boxes.groupBy(*TRACK).agg(F.count("*").alias("n"))
        rows = wide(kp).where(F.size("kp") >= 17).join(box, [*POSE]).join(n, [*TRACK])
        known = protected.select(*TRACK, F.lit(True).alias("safe")).distinct() if protected is not None else None
        rows = rows.join(known, [*TRACK], "left").withColumn("safe", F.coalesce("safe", F.lit(False))) if known is not None else rows.withColumn("safe", F.lit(False))
        a, b = (rows.select("seq_id", "frame_idx", F.col("track_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("kp", "n", "safe", "x1", "y1", "x2", "y2")]) for s in "ab")
        p = a.join(b, ["seq_id", "frame_idx"]).where("a < b")
        # Boxes first: what they rule out needs no joints.
        near = F.greatest(g.containment("a_", "b_"), g.containment("b_", "a_")) <= 0.7
        p = p.where(near).withColumns({"iou": F.coalesce(g.iou("a_", "b_"), F.lit(0.0)), "tall": F.greatest(g.height("a_"), g.height("b_"), F.lit(1.0)), "apart": g.distance("a_", "b_")})
        far2 = F.zip_with("a_kp", "b_kp", lambda x, y: (x["x"] - y["x"]) * (x["x"] - y["x"]) + (x["y"] - y["y"]) * (x["y"] - y["y"]))
        p = p.withColumn("far2", far2).withColumn("far", F.array_sort(F.transform("far2", F.sqrt)))
        p = p.withColumn("joints", F.element_at("far", 9)).where(F.col("joints") <= self.joints * F.col("tall"))
        torso = F.array_sort(F.array(*[F.sqrt(F.get("far2", j)) for j in TORSO]))
        scale = F.greatest((F.greatest(g.area("a_"), F.lit(1.0)) + F.greatest(g.area("b_"), F.lit(1.0))) / 2, F.lit(1.0))
        seen = F.zip_with("a_kp", "b_kp", lambda x, y: (x["s"] > 0.01) & (y["s"] > 0.01))
        like = F.zip_with("far2", F.array(*[F.lit(x * x) for x in SIGMAS]), lambda d, v: F.exp(-d / (2 * scale * v + 1e-9)))
        alike = F.aggregate(F.zip_with(like, seen, lambda k, v: F.when(v, k).otherwise(0.0)), F.lit(0.0), lambda t, k: t + k)
        tight, taller = F.col("joints") < self.tight * F.col("tall"), F.col("tall")
        p = p.where(
            ((F.col("iou") >= self.overlap) | tight) & ((torso[1] + torso[2]) / 2 <= self.torso * taller) & (tight | (F.col("apart") <= self.centres * taller))
            & (F.coalesce(alike / F.nullif(F.size(F.filter(seen, lambda v: v)), F.lit(0)), F.lit(0.0)) >= self.oks)
        )
        strict, loose = (F.col("iou") > 0.5) & (F.col("joints") < 0.25 * taller), F.col("joints") < 0.12 * taller
        safe = F.col("a_safe") | F.col("b_safe")
        outlasted = (F.col("a_safe") & (F.col("b_n") >= 3 * F.col("a_n"))) | (F.col("b_safe") & (F.col("a_n") >= 3 * F.col("b_n")))
        p = p.where(~(safe & ~strict & ~loose))
        p = p.where(~(loose & ~strict & outlasted)) if counts else p
        mean = lambda side: F.aggregate(f"{side}_kp", F.lit(0.0), lambda t, k: t + k["s"]) / 17
        by_length = F.when(F.col("a_n") < F.col("b_n"), F.col("a")).otherwise(F.col("b"))
        by_score = F.when((F.abs(mean("a") - mean("b")) < 1e-5) | (mean("a") >= mean("b")), F.col("b")).otherwise(F.col("a"))
        return p.select("seq_id", "frame_idx", "a", "b", (by_length if counts else by_score).alias("loser"))


def suppressed_duplicates(conflicts: DataFrame) -> DataFrame:
    """(seq_id, frame_idx, track_id) that go: tracks take their turns in order of their ids.

    A track whose turn comes while it is still there takes out each later one that loses to it, and goes itself if it loses to a later
    one that is still there; it ends its turn all the same.
    """
    keys = ["seq_id", "frame_idx"]
    ahead = stored(conflicts.where("loser = b").select(*keys, F.col("a").alias("first"), F.col("b").alias("then")))
    early = stored(choice.suppressed(ahead, keys))  # gone before their own turn
    turn = ahead.join(early.withColumnRenamed("node", "first"), [*keys, "first"], "left_anti").groupBy(*keys, F.col("then").alias("b")).agg(F.min("first").alias("turn"))
    back = conflicts.where("loser = a").join(early.withColumnRenamed("node", "a"), [*keys, "a"], "left_anti")
    late = back.join(turn, [*keys, "b"], "left").where("turn is null or turn > a").select(*keys, F.col("a").alias("node"))
    return early.unionByName(late).distinct().withColumnRenamed("node", "track_id")
