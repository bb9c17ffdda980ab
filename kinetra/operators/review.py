"""Operators for review and scoring: anchors, overlays, peaks, visibility, isolation, resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.functions import geometry as g
from kinetra.operators import tiles
from kinetra.operators.pairs import BOX
from kinetra.operators.pose import POSE, TRACK

#: Joint pairs of the bones.
BONES = ((5, 7), (7, 9), (6, 8), (8, 10), (11, 13), (13, 15), (12, 14), (14, 16), (5, 6), (11, 12), (5, 11), (6, 12))
EXTREMITIES = (9, 10, 15, 16)


def anchor_tracks(obs: DataFrame, anchors: DataFrame, most: float) -> DataFrame:
    """Per anchor (anchor_id, seq_id, frame_idx, x, y): the smallest box that holds it, else the nearest centre within ``most``.

    A frame's anchors meet its boxes in one task, a stripe of anchors at a time, and only the best of each leaves it.
    """

    def run(mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or rows.empty:
            return pd.DataFrame({c: [] for c in (*at, "out", "size", "track_id")})
        rows = rows.sort_values("track_id")
        boxes, ids, found = rows[list(BOX)].to_numpy(float), rows["track_id"].to_numpy(), []
        area = (boxes[:, 2] - boxes[:, 0]) * tiles.tall(boxes)
        for part in tiles.stripes(len(mine)):
            here = mine.iloc[part]
            x, y = here["x"].to_numpy(float)[:, None], here["y"].to_numpy(float)[:, None]
            inside = (x >= boxes[:, 0]) & (x <= boxes[:, 2]) & (y >= boxes[:, 1]) & (y <= boxes[:, 3])
            dx, dy = (boxes[:, 0] + boxes[:, 2]) / 2 - x, (boxes[:, 1] + boxes[:, 3]) / 2 - y
            dist = np.sqrt(dx * dx + dy * dy)
            size = np.where(inside.any(axis=1)[:, None], np.where(inside, area, np.inf), np.where(dist <= most, dist, np.inf))
            best, some = size.argmin(axis=1), np.arange(len(here))
            found.append((~inside[some, best], size[some, best], ids[best]))
        out, size, track = (np.concatenate(c) for c in zip(*found, strict=True))
        told = np.isfinite(size)
        return mine.loc[told, at].assign(out=out[told], size=size[told], track_id=track[told])

    frame, at = ["seq_id", "frame_idx"], ["seq_id", "frame_idx", "x", "y"]
    anchors = anchors.withColumns({c: F.col(c).cast("double") for c in "xy"})
    places = anchors.select(*at).distinct().groupBy(*frame)
    met = places.cogroup(obs.select(*frame, "track_id", *BOX).groupBy(*frame)).applyInPandas(run, "seq_id long, frame_idx long, x double, y double, out boolean, size double, track_id long")
    found = anchors.select("anchor_id", *at).join(met, at).groupBy("anchor_id").agg(F.min(F.struct("out", "size", "track_id")).alias("m"))
    return anchors.join(found, "anchor_id", "left").select("anchor_id", F.col("m.track_id").alias("track_id"), (~F.col("m.out")).alias("inside"))


def overlay(pruned: DataFrame, obs: DataFrame) -> DataFrame:
    """Boxes of pruned entries (rule, seq_id, track_id, first, last) on each of their frames."""
    frames = pruned.withColumn("frame_idx", F.explode(F.sequence("first", "last"))).drop("first", "last")
    return frames.join(obs, ["seq_id", "track_id", "frame_idx"]).select("rule", "seq_id", "track_id", "frame_idx", *BOX)


def pruned_boxes(log: DataFrame, posed: DataFrame, raw: DataFrame, after: DataFrame) -> DataFrame:
    """Boxes of pruned tracks for review: of those pruned after posing (``after``) from the posed frames, of those in the log that were never posed from the raw tracks.

    ``log``: seq_id, track_id, rule; a track's last entry names its rule, else it is ``post_pose``.
    """
    key = ["seq_id", "track_id"]
    rule = log.groupBy(*key).agg(F.max_by("rule", "place").alias("rule"))
    late = posed.join(after.select(*key), key, "left_semi").join(rule, key, "left")
    early = raw.join(rule, key).join(posed.select(*key).distinct(), key, "left_anti").join(posed.select("seq_id", "frame_idx").distinct(), ["seq_id", "frame_idx"], "left_semi")
    columns = [*key, "frame_idx", *BOX]
    return late.select(*columns, F.coalesce("rule", F.lit("post_pose")).alias("rule")).unionByName(early.select(*columns, "rule"))


def between_keyframes(frames: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Value at each frame (seq_id, frame_idx) from keyframes (seq_id, frame_idx, value): linear between, held before the first and after the last."""
    rows = frames.select("seq_id", "frame_idx", F.lit(None).cast("double").alias("value"), F.lit(True).alias("asked")).unionByName(keyframes.select("seq_id", "frame_idx", "value", F.lit(False).alias("asked")))
    w = Window.partitionBy("seq_id").orderBy("frame_idx")
    before, after = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    at = F.when(~F.col("asked"), F.struct(F.col("frame_idx").alias("f"), "value"))
    found = rows.withColumns({"lo": F.last(at, ignorenulls=True).over(before), "hi": F.first(at, ignorenulls=True).over(after)}).where("asked")
    share = (F.col("frame_idx") - F.col("lo.f")) / F.nullif(F.col("hi.f") - F.col("lo.f"), F.lit(0))
    mixed = F.col("lo.value") + F.coalesce(share, F.lit(0.0)) * (F.col("hi.value") - F.col("lo.value"))
    return found.select("seq_id", "frame_idx", F.coalesce(mixed, "lo.value", "hi.value").alias("value"))


def dropped(before: DataFrame, between: DataFrame, after: DataFrame) -> DataFrame:
    """Observations that went between three stages, with the step that took them."""
    key = ["seq_id", "track_id", "frame_idx"]
    one = before.join(between, key, "left_anti").select(*key, F.lit(1).alias("step"))
    return one.unionByName(between.join(after, key, "left_anti").select(*key, F.lit(2).alias("step")))


def acceleration_flags(obs: DataFrame, share: float = 0.5) -> DataFrame:
    """Observations whose centre moved more than ``share`` of the height from the one at most two frames before."""
    w = Window.partitionBy("seq_id", "track_id").orderBy("frame_idx")
    moved = F.sqrt(F.pow(g.cx() - F.lag(g.cx()).over(w), F.lit(2)) + F.pow(g.cy() - F.lag(g.cy()).over(w), F.lit(2)))
    flagged = obs.withColumns({"moved": moved, "step": F.col("frame_idx") - F.lag("frame_idx").over(w)})
    return flagged.where((F.col("step") <= 2) & (F.col("moved") > share * g.height())).select("seq_id", "track_id", "frame_idx", "moved")


def _nearest(x: np.ndarray, y: np.ndarray) -> float:
    """The least distance of two of some points; inf for fewer than two.

    Points in order of x are tried with the next ones, one step farther each time, until no step along x alone is less.
    """
    order = np.argsort(x, kind="stable")
    x, y, least = x[order], y[order], np.inf
    left = np.arange(len(x) - 1)
    for step in range(1, len(x)):
        left = left[left + step < len(x)]
        dx = x[left + step] - x[left]
        left, dx = left[dx <= least], dx[dx <= least]
        if not len(left) or least == 0:
            break
        dy = y[left + step] - y[left]
        least = min(least, np.sqrt(dx * dx + dy * dy).min())
    return float(least)


def enrolment_frame(obs: DataFrame, every: int = 3, most: int = 300, apart: float = 80.0) -> DataFrame:
    """Per sequence the frame with the largest (smallest distance of two tracks) times (tracks), if they are apart enough; a task takes a frame."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        d = _nearest(rows["x"].to_numpy(float), rows["y"].to_numpy(float))
        return rows[["seq_id", "frame_idx"]].head(int(np.isfinite(d))).assign(n=len(rows), d=d)

    looked = obs.where((F.col("frame_idx") % every == 0) & (F.col("frame_idx") < most)).select("seq_id", "frame_idx", g.cx().alias("x"), g.cy().alias("y"))
    d = looked.groupBy("seq_id", "frame_idx").applyInPandas(run, "seq_id long, frame_idx long, n long, d double")
    scored = d.where(F.col("d") >= apart).withColumn("score", F.round(F.col("d") * F.col("n"), 6))
    return scored.groupBy("seq_id").agg(F.max_by(F.struct("frame_idx", "n", "score"), F.struct("score", -F.col("frame_idx"))).alias("m")).select("seq_id", "m.frame_idx", "m.n", "m.score")


def _covered(boxes: np.ndarray, ids: np.ndarray, most: float) -> np.ndarray:
    """For each box of a frame the largest share of it, over ``most``, that another with lower feet contains; nan where none does.

    Boxes are tried in order of their left sides, outwards from each, until no width that is left could give a larger share.
    """
    order = np.argsort(boxes[:, 0], kind="stable")
    (x1, y1, x2, y2), ids, n = boxes[order].T, ids[order], len(order)
    tall, area, reach = np.maximum(y2 - y1, 0.0), np.maximum((x2 - x1) * (y2 - y1), 1e-6), np.fmax.accumulate(x2)
    best, step, left = np.full(n, most), 0, {1: np.arange(n), -1: np.arange(n)}
    while any(len(at) for at in left.values()):
        step += 1
        for side, at in left.items():
            at = at[at + step < n] if side > 0 else at[at >= step]
            by = at + side * step
            widest = np.maximum(x2[at] - x1[by] if side > 0 else reach[by] - x1[at], 0.0)
            may = widest * tall[at] / area[at] > best[at]
            at, by = at[may], by[may]
            both = np.maximum(0.0, np.minimum(x2[at], x2[by]) - np.maximum(x1[at], x1[by])) * np.maximum(0.0, np.minimum(y2[at], y2[by]) - np.maximum(y1[at], y1[by]))
            share = np.where((y2[by] > y2[at]) & (ids[by] != ids[at]), both / area[at], 0.0)
            best[at], left[side] = np.fmax(best[at], share), at
    found = np.empty(n)
    found[order] = np.where(best > most, best, np.nan)
    return found


def visibility(obs: DataFrame, most: float = 0.85) -> DataFrame:
    """Per observation: one, or where a box of its frame with lower feet contains more than ``most`` of it, one less the largest such share.

    A task takes one frame.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        share = _covered(rows[list(BOX)].to_numpy(float), rows["track_id"].to_numpy(), most)
        share = pd.Series(share, index=rows.index).groupby(rows["track_id"]).transform("max")
        return rows[["seq_id", "track_id", "frame_idx"]].assign(visible=1 - share.fillna(0.0), hidden=share.notna())

    return obs.select("seq_id", "track_id", "frame_idx", *BOX).groupBy("seq_id", "frame_idx").applyInPandas(run, "seq_id long, track_id long, frame_idx long, visible double, hidden boolean")


def isolated(obs: DataFrame, share: float = 1.5) -> DataFrame:
    """Observations with no other centre of their frame within ``share`` of their height."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        boxes, near = rows[list(BOX)].to_numpy(float), np.zeros(len(rows))
        rest = tiles.lonely(boxes, lambda a, b: tiles.distance(a, b) <= share * tiles.tall(a))
        for part in tiles.stripes(len(rest)):
            apart = tiles.distance(boxes[rest[part]][:, None], boxes[None])
            apart[np.arange(len(apart)), rest[part]] = np.inf
            near[rest[part]] = apart.min(axis=1)
        kept = rest[near[rest] > share * tiles.tall(boxes[rest])]
        return rows.iloc[kept][["seq_id", "track_id", "frame_idx"]].assign(d=near[kept])

    found = obs.select("seq_id", "track_id", "frame_idx", *BOX).groupBy("seq_id", "frame_idx").applyInPandas(run, "seq_id long, track_id long, frame_idx long, d double")
    return found.withColumn("d", F.nullif("d", F.lit(float("inf"))))


def held(obs: DataFrame, total_frames: int) -> DataFrame:
    """Every frame from a track's first on, boxes held from its last observation."""
    spine = obs.groupBy("seq_id", "track_id").agg(F.min("frame_idx").alias("f0")).where(F.col("f0") < total_frames).select("seq_id", "track_id", F.explode(F.sequence(F.col("f0"), F.lit(total_frames - 1).cast("long"))).alias("frame_idx"))
    w = Window.partitionBy("seq_id", "track_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    full = spine.join(obs, ["seq_id", "track_id", "frame_idx"], "left")
    return full.select("seq_id", "track_id", "frame_idx", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in BOX])


def resampled(obs: DataFrame, ratio: float, total: int) -> DataFrame:
    """Boxes at output frame t, interpolated between frames floor(t * ratio) and the next where both are observed."""
    # Each observed frame gives the output frames that start at it: one or a few by arithmetic, without a join with the output's frames.
    first, t = F.ceil(F.col("lo") / ratio - 1).cast("long"), F.col("t")
    lo = obs.select("seq_id", "track_id", F.col("frame_idx").alias("lo"), *[F.col(c).alias(f"a_{c}") for c in BOX])
    hi = obs.select("seq_id", "track_id", (F.col("frame_idx") - 1).alias("lo"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    near = F.sequence(F.greatest(first, F.lit(0).cast("long")), F.floor((F.col("lo") + 1) / ratio + 1).cast("long"))
    both = lo.join(hi, ["seq_id", "track_id", "lo"]).withColumn("t", F.explode(near)).where((t >= 0) & (t < total) & (F.floor(t * ratio) == F.col("lo")))
    both = both.withColumn("alpha", t * ratio - F.floor(t * ratio))
    return both.select("seq_id", "track_id", "t", *[(F.col(f"a_{c}") * (1 - F.col("alpha")) + F.col(f"b_{c}") * F.col("alpha")).alias(c) for c in BOX])


def scaled(p: Column, temperature: float) -> Column:
    """A probability with its logit divided by a temperature."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return 1 / (1 + F.exp(-F.log(q / (1 - q)) / temperature))


def bone_lengths(kp: DataFrame) -> DataFrame:
    """Per track and bone: the median length."""
    bones = F.explode(F.array(*[F.struct(F.lit(a).alias("p"), F.lit(b).alias("q")) for a, b in BONES]))
    ends = kp.select(*POSE, "j", "x", "y")
    spec = kp.select(*POSE).distinct().select(*POSE, bones.alias("bone")).select(*POSE, "bone.p", "bone.q")
    a = spec.join(ends.withColumnRenamed("j", "p").withColumnsRenamed({"x": "px", "y": "py"}), [*POSE, "p"])
    both = a.join(ends.withColumnRenamed("j", "q").withColumnsRenamed({"x": "qx", "y": "qy"}), [*POSE, "q"])
    length = F.sqrt(F.pow(F.col("px") - F.col("qx"), F.lit(2)) + F.pow(F.col("py") - F.col("qy"), F.lit(2)))
    return both.groupBy(*TRACK, "p", "q").agg(F.median(length).alias("length"))


def motion_peaks(kp: DataFrame) -> DataFrame:
    """Per track: the frame in which its hands and feet move most since its frame before, and by how much on average."""
    w = Window.partitionBy(*TRACK, "j").orderBy("frame_idx")
    moved = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2)))
    per = kp.where(F.col("j").isin(*EXTREMITIES)).withColumn("moved", moved).groupBy(*POSE).agg(F.round(F.avg("moved"), 6).alias("m")).where("m is not null")
    return per.groupBy(*TRACK).agg(F.max_by("frame_idx", F.struct("m", -F.col("frame_idx"))).alias("peak_frame"), F.max("m").alias("peak"))


def movement_peaks(kp: DataFrame, factor: float = 1.5) -> DataFrame:
    """Frames whose mean movement is a local maximum above ``factor`` times the track's median."""
    w = Window.partitionBy(*TRACK, "j").orderBy("frame_idx")
    moved = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2)))
    per = kp.withColumn("moved", moved).groupBy(*POSE).agg(F.avg("moved").alias("m")).where("m is not null")
    t = Window.partitionBy(*TRACK).orderBy("frame_idx")
    mid = per.groupBy(*TRACK).agg(F.median("m").alias("mid"))
    tested = per.withColumns({"before": F.lag("m").over(t), "after": F.lead("m").over(t)}).join(mid, [*TRACK])
    return tested.where((F.col("m") > F.col("before")) & (F.col("m") > F.col("after")) & (F.col("m") > factor * F.col("mid"))).select(*POSE, "m")


def formation_error(kp: DataFrame, first: int) -> DataFrame:
    """Per track: mean distance of its centre from its mean place in the first ``first`` frames, relative to the group's centre."""
    centre = kp.groupBy(*POSE).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    group = Window.partitionBy("seq_id", "frame_idx")
    rel = centre.select(*POSE, (F.col("x") - F.avg("x").over(group)).alias("rx"), (F.col("y") - F.avg("y").over(group)).alias("ry"))
    home = rel.where(F.col("frame_idx") < first).groupBy(*TRACK).agg(F.avg("rx").alias("hx"), F.avg("ry").alias("hy"))
    d = F.sqrt(F.pow(F.col("rx") - F.col("hx"), F.lit(2)) + F.pow(F.col("ry") - F.col("hy"), F.lit(2)))
    return rel.join(home, [*TRACK]).groupBy(*TRACK).agg(F.avg(d).alias("error"))
