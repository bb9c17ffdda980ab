"""Operators on track observations (seq_id, track_id, frame_idx, x1, y1, x2, y2, conf)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.functions import geometry as g

TRACK = ("seq_id", "track_id")


def _by_frame() -> Window:
    return Window.partitionBy(*TRACK).orderBy("frame_idx")


def survival(obs: DataFrame, total_frames: int, share: float = 0.2, floor: int = 30, still: float = 0.02) -> DataFrame:
    """Per track: frames, span, movement, whether it lasts, the group's median height, and whether it lasts and moves enough.

    Enough frames: the larger of min(floor, possible) and int(share * possible) + 1, where possible counts from the
    first frame to the end. Enough movement: the standard deviations of its centre in x and y, squared and summed, are at
    least ``still`` times the median height of all boxes of the sequence's tracks that last. A sequence without
    such boxes has no survivors; a track that starts past the end does not last.
    """
    track = Window.partitionBy(*TRACK)
    n, possible = F.count("*").over(track), F.lit(total_frames) - F.min("frame_idx").over(track)
    least = F.greatest(F.least(F.lit(floor), possible), F.floor(possible * share).cast("long") + 1)
    rows = obs.withColumn("lasts", (possible > 0) & (n >= least))
    heights = rows.where(F.col("lasts") & (g.height() > 0)).groupBy("seq_id").agg(F.median(g.height()).alias("median_h"))
    stats = rows.groupBy(*TRACK).agg(
        F.count("*").alias("n_frames"),
        F.min("frame_idx").alias("first_frame"),
        (F.max("frame_idx") - F.min("frame_idx") + 1).alias("span"),
        F.sqrt(F.var_pop(g.cx()) + F.var_pop(g.cy())).alias("movement_std"),
        F.first("lasts").alias("lasts"),
    )
    moves = F.coalesce(F.col("movement_std") >= still * F.col("median_h"), F.lit(False))
    return stats.join(heights, "seq_id", "left").withColumn("survives", F.col("lasts") & moves)


def quality(obs: DataFrame) -> DataFrame:
    """Over all tracks of a sequence: counts and percentiles of their lengths."""
    per = obs.groupBy(*TRACK).agg(F.count("*").alias("n"))
    return per.groupBy("seq_id").agg(
        F.count("*").alias("n_tracks"), F.sum("n").alias("n_obs"), F.median("n").alias("median_len"),
        F.percentile("n", F.lit(0.1)).alias("p10_len"), F.percentile("n", F.lit(0.9)).alias("p90_len"), F.min("n").alias("min_len"), F.max("n").alias("max_len"),
    )


def jumps(obs: DataFrame, stride: int = 1) -> DataFrame:
    """Per track: gaps longer than max(3 * stride, 5) frames, and the longest gap."""
    gap = F.col("frame_idx") - F.lag("frame_idx").over(_by_frame())
    return obs.withColumn("gap", gap).groupBy(*TRACK).agg(F.count_if(F.col("gap") > max(3 * stride, 5)).alias("n_jumps"), F.max("gap").alias("longest_gap"))


def fill_gaps(obs: DataFrame, longest: int) -> DataFrame:
    """Linear boxes (confidence 0.5) for the frames between two observations at most ``longest`` frames apart."""
    w = _by_frame()
    nexts = obs.withColumns({f"n_{c}": F.lead(c).over(w) for c in ("frame_idx", "x1", "y1", "x2", "y2")})
    gaps = nexts.where((F.col("n_frame_idx") - F.col("frame_idx") > 1) & (F.col("n_frame_idx") - F.col("frame_idx") <= longest))
    rows = gaps.withColumn("f", F.explode(F.sequence(F.col("frame_idx") + 1, F.col("n_frame_idx") - 1)))
    t = (F.col("f") - F.col("frame_idx")) / (F.col("n_frame_idx") - F.col("frame_idx"))
    return rows.select(*TRACK, F.col("f").alias("frame_idx"), *[(F.col(c) + t * (F.col(f"n_{c}") - F.col(c))).alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(0.5).alias("conf"))


def tail_velocity(obs: DataFrame, n: int = 5) -> DataFrame:
    """Per track: centre movement per frame over its last ``n`` observations (null for a single frame)."""
    last = obs.withColumn("rn", F.row_number().over(Window.partitionBy(*TRACK).orderBy(F.desc("frame_idx")))).where(F.col("rn") <= n)
    ends = last.groupBy(*TRACK).agg(
        *[f("frame_idx").alias(a) for f, a in ((F.min, "f0"), (F.max, "f1"))],
        *[f(v, "frame_idx").alias(f"{a}_{c}") for f, a in ((F.min_by, "first"), (F.max_by, "last")) for v, c in ((g.cx(), "x"), (g.cy(), "y"))],
    )
    dt = F.nullif(F.col("f1") - F.col("f0"), F.lit(0))
    return ends.select(*TRACK, ((F.col("last_x") - F.col("first_x")) / dt).alias("vx"), ((F.col("last_y") - F.col("first_y")) / dt).alias("vy"))


def presence_islands(obs: DataFrame) -> DataFrame:
    """Runs of consecutive frames of each track: first frame, last frame, length."""
    run = F.col("frame_idx") - F.row_number().over(_by_frame())
    return obs.withColumn("run", run).groupBy(*TRACK, "run").agg(F.min("frame_idx").alias("run_start"), F.max("frame_idx").alias("run_end"), F.count("*").alias("run_len")).drop("run")


def smoothness(obs: DataFrame) -> DataFrame:
    """Per track: mean size of the third central difference of the centre's x (jerk) by order of observations."""
    w = _by_frame()
    x = g.cx()
    jerk = (F.lead(x, 2).over(w) - 2 * F.lead(x, 1).over(w) + 2 * F.lag(x, 1).over(w) - F.lag(x, 2).over(w)) / 2
    return obs.withColumn("jerk", jerk).groupBy(*TRACK).agg(F.avg(F.abs("jerk")).alias("mean_jerk"), F.count("jerk").alias("n"))


def mot_lines(obs: DataFrame) -> DataFrame:
    """Text lines of the multiple-object-tracking format, frames from 1; decimals are rounded half up."""
    line = F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,%.4f,1,1", F.col("frame_idx") + 1, F.col("track_id"), *[F.round(v, 6) for v in (F.col("x1"), F.col("y1"), g.width(), g.height())], F.round("conf", 8))
    return obs.select("seq_id", (F.col("frame_idx") + 1).alias("frame"), F.col("track_id").alias("id"), line.alias("line"))


def per_frame(obs: DataFrame, total_frames: int) -> DataFrame:
    """One row for each frame of each sequence, also empty ones: its number of tracks and their ids in order."""
    spine = obs.select("seq_id").distinct().select("seq_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total_frames - 1).cast("long"))).alias("frame_idx"))
    found = obs.groupBy("seq_id", "frame_idx").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("track_id")).cast("array<string>"), ",").alias("ids"))
    return spine.join(found, ["seq_id", "frame_idx"], "left").select("seq_id", "frame_idx", F.coalesce("n", F.lit(0)).cast("long").alias("n_tracks"), F.coalesce("ids", F.lit("")).alias("track_ids"))


def reverse(obs: DataFrame, total_frames: int) -> DataFrame:
    """Frames of a reversed pass mapped back."""
    return obs.withColumn("frame_idx", F.lit(total_frames - 1) - F.col("frame_idx"))


def swap_interval(obs: DataFrame, a: int, b: int, first: int, last: int) -> DataFrame:
    """Exchanges the ids a and b on the frames first to last."""
    other = F.when(F.col("track_id") == a, b).when(F.col("track_id") == b, a).otherwise(F.col("track_id"))
    return obs.withColumn("track_id", F.when(F.col("frame_idx").between(first, last), other).otherwise(F.col("track_id")).cast("long"))


def lifecycle(obs: DataFrame, total_frames: int, lost: int) -> DataFrame:
    """Per track and frame from its first on: ACTIVE when observed, else DORMANT, or LOST after more than ``lost`` frames."""
    spans = obs.groupBy(*TRACK).agg(F.min("frame_idx").alias("f0")).where(F.col("f0") < total_frames)
    spine = spans.withColumn("frame_idx", F.explode(F.sequence("f0", F.lit(total_frames - 1).cast("long")))).drop("f0")
    seen = spine.join(obs.select(*TRACK, "frame_idx", F.lit(1).alias("here")), [*TRACK, "frame_idx"], "left")
    last = F.max(F.when(F.col("here") == 1, F.col("frame_idx"))).over(_by_frame().rowsBetween(Window.unboundedPreceding, 0))
    away = F.col("frame_idx") - last
    return seen.withColumn("away", away).select(*TRACK, "frame_idx", F.when(F.col("away") == 0, "ACTIVE").when(F.col("away") <= lost, "DORMANT").otherwise("LOST").alias("state"))


def gates(states: DataFrame) -> DataFrame:
    """Which steps run for a track in its state: pose and critique when seen at all, the gallery only when fully."""
    seen = F.col("state").isin("ACTIVE", "PARTIAL")
    return states.select(*TRACK, "frame_idx", seen.alias("run_pose"), (F.col("state") == "ACTIVE").alias("update_gallery"), seen.alias("run_critique"))


def absences(states: DataFrame) -> DataFrame:
    """Runs of frames in which a track is away (DORMANT or LOST): first and last frame, length and the last state."""
    away = states.where(F.col("state").isin("DORMANT", "LOST"))
    run = F.col("frame_idx") - F.row_number().over(_by_frame())
    out = away.withColumn("run", run).groupBy(*TRACK, "run").agg(F.min("frame_idx").alias("gap_start"), F.max("frame_idx").alias("gap_end"), F.count("*").alias("gap_len"), F.max_by("state", "frame_idx").alias("state"))
    return out.drop("run")


def tail_frames(obs: DataFrame, n: int) -> DataFrame:
    """The last ``n`` frames of each sequence, by number."""
    last = obs.groupBy("seq_id").agg(F.max("frame_idx").alias("last"))
    return obs.join(last, "seq_id").where(F.col("frame_idx") > F.col("last") - n).drop("last")


def one_each(rows: DataFrame) -> DataFrame:
    """One row for each track and frame: the one with the highest confidence, then the leftmost."""
    best = F.max_by(F.struct("x1", "y1", "x2", "y2", "conf"), F.struct("conf", -F.col("x1"))).alias("m")
    return rows.groupBy(*TRACK, "frame_idx").agg(best).select(*TRACK, "frame_idx", "m.*")


def medians(obs: DataFrame) -> DataFrame:
    """Per track: axis-wise median centre, height and width."""
    return obs.groupBy(*TRACK).agg(F.median(g.cx()).alias("mx"), F.median(g.cy()).alias("my"), F.median(g.height()).alias("mh"), F.median(g.width()).alias("mw"), F.count("*").alias("n"))


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def edge_share(obs: DataFrame, frame_width: float, edge: float = 0.15) -> DataFrame:
    """Per track: share of observations whose centre is in the outer ``edge`` of the frame's width."""
    x = g.cx()
    return obs.groupBy(*TRACK).agg(_share((x < edge * frame_width) | (x > (1 - edge) * frame_width)).alias("edge_share"))
