"""Pruning rules over one row of facts for each track; a chain applies them to what is left.

``facts`` reads the observations once. A rule is a condition on a track's facts, with group statistics as windows over
the tracks of its sequence that are still alive, so a chain of any length scans the observations no more often.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.functions import geometry as g
from kinetra.operators import tracks

KEY = ["seq_id", "track_id"]
#: A rule gets the condition under which a track counts (alive) and gives the condition under which it goes.
Rule = Callable[[Column], Column]

#: Weights of the rules that vote, and the sum that rejects (strictly above it).
VOTE_WEIGHTS = {"low_sync": 0.7, "smart_mirror": 0.9, "completeness": 0.6, "head_only": 0.8, "low_confidence": 0.5, "jitter": 0.5}
VOTE_LIMIT = 0.65
#: Outer shares of the frame that count as edge for entrants, for mirrors, and as corner.
ENTRY_EDGE, MIRROR_EDGE, CORNER_X, CORNER_Y = 0.08, 0.15, 0.15, 0.20
#: Least spread of a group as a share of the frame; from this share of the height on a track is in front; how much more it may deviate.
LEAST_SPREAD, FRONT, FRONT_FACTOR = 0.05, 0.65, 1.25


@dataclass(frozen=True)
class Frame:
    """Size of the picture and number of frames."""

    width: float
    height: float
    total: int


def _rule(make: Callable[..., Rule]) -> Callable[..., Rule]:
    """A rule's columns are made when it is applied, so that rules can be named without a session."""

    @wraps(make)
    def named(*args: object, **options: object) -> Rule:
        return lambda alive: make(*args, **options)(alive)

    return named


def facts(obs: DataFrame, frame: Frame, early: int = 120, mirror_edge: float = MIRROR_EDGE) -> DataFrame:
    """Per track: counts, first place, medians (whole, first and last quarter, before frame ``early``), velocity and edge shares, survival."""
    ordered, whole = Window.partitionBy(*KEY).orderBy("frame_idx"), Window.partitionBy(*KEY)
    x, y, w, h = g.cx(), g.cy(), g.width(), g.height()
    rows = obs.withColumns({"rn": F.row_number().over(ordered), "n": F.count("*").over(whole), "bx": F.lag(x).over(ordered), "bf": F.lag("frame_idx").over(ordered)})
    rn, n = F.col("rn"), F.col("n")
    quarter = F.greatest(F.lit(1), F.floor(n / 4))
    first, last, moved = rn <= quarter, rn > n - quarter, F.col("bf").isNotNull()
    edge = (x <= mirror_edge * frame.width) | (x >= (1 - mirror_edge) * frame.width)
    corner = ((x <= CORNER_X * frame.width) | (x >= (1 - CORNER_X) * frame.width)) & ((y <= CORNER_Y * frame.height) | (y >= (1 - CORNER_Y) * frame.height))
    mid = lambda v, when=None: F.median(v if when is None else F.when(when, v))
    share = lambda c, when=None: F.avg((c if when is None else F.when(when, c)).cast("double"))
    stats = rows.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min("frame_idx").alias("f0"), F.max("frame_idx").alias("f1"),
        mid(x).alias("mx"), mid(y).alias("my"), mid(F.col("y2")).alias("feet"), mid(h, h > 0).alias("mh"), mid(w, w > 0).alias("mw"), mid(w / h, h > 0).alias("wh"),
        F.max(F.when(rn == 1, x)).alias("first_x"), F.max(F.when(rn == 1, y)).alias("first_y"), F.max(F.when(rn == F.least(n, F.lit(15)), x)).alias("later_x"),
        mid(x, first).alias("early_x"), mid(y, first).alias("early_y"), mid(x, last).alias("late_x"), mid(y, last).alias("late_y"),
        mid(x, F.col("frame_idx") < early).alias("start_x"), mid(y, F.col("frame_idx") < early).alias("start_y"),
        F.avg((x - F.col("bx")) / (F.col("frame_idx") - F.col("bf"))).alias("vx"), share(edge, moved).alias("moving_edge"), share(edge).alias("edge"), share(corner).alias("corner"),
    )
    lives = tracks.survival(obs, frame.total).select(*KEY, "survives")
    return stats.join(lives, KEY)


def _group(alive: Column, value: Column, how: Callable[[Column], Column]) -> Column:
    return how(F.when(alive, value)).over(Window.partitionBy("seq_id"))


def _count(alive: Column, value: Column | None = None) -> Column:
    return _group(alive, F.lit(1) if value is None else value, F.count)


@_rule
def short_lived() -> Rule:
    """Does not last or does not move (see ``tracks.survival``)."""
    return lambda alive: ~F.col("survives")


@_rule
def outside_polygon(corners: list[tuple[float, float]]) -> Rule:
    """Median feet (middle of the box's bottom) outside the stage."""
    return lambda alive: ~g.in_polygon(F.col("mx"), F.col("feet"), corners)


def deviation(alive: Column, frame: Frame) -> Column:
    """Distance of the median centre from the group's median, the larger of both axes in standard deviations of the group."""
    axis = lambda v, size: F.abs(F.col(v) - _group(alive, F.col(v), F.median)) / F.greatest(_group(alive, F.col(v), F.stddev_pop), F.lit(LEAST_SPREAD * size))
    return F.greatest(axis("mx", frame.width), axis("my", frame.height))


def _approaches(alive: Column) -> Column:
    """Its last quarter is nearer to the group than 0.7 times its first one; four observations at least."""
    gx, gy = (_group(alive, F.col(v), F.median) for v in ("mx", "my"))
    away = lambda p: F.sqrt(F.pow(F.col(f"{p}_x") - gx, F.lit(2)) + F.pow(F.col(f"{p}_y") - gy, F.lit(2)))
    return (F.col("n") >= 4) & (away("late") < 0.7 * away("early"))


@_rule
def spatial_outliers(frame: Frame, factor: float = 2.0) -> Rule:
    """Farther from the group than ``factor`` deviations (more in front), unless it comes nearer; three tracks at least."""
    most = F.when(F.col("my") >= FRONT * frame.height, factor * FRONT_FACTOR).otherwise(F.lit(factor))
    return lambda alive: (_count(alive) >= 3) & (deviation(alive, frame) > most) & ~_approaches(alive)


def _enters_at_edge(frame: Frame) -> Column:
    x, y = F.col("first_x"), F.col("first_y")
    return (x <= ENTRY_EDGE * frame.width) | (x >= frame.width - ENTRY_EDGE * frame.width) | (y <= ENTRY_EDGE * frame.height) | (y >= frame.height - ENTRY_EDGE * frame.height)


@_rule
def short_share(frame: Frame, share: float = 0.15, floor: int = 30) -> Rule:
    """Fewer frames than int(share * all); one that enters at an edge may stay if it is cut off by the end, or lasts for its time and moves inwards."""
    possible, n = F.lit(frame.total) - F.col("f0"), F.col("n")
    net, x = F.col("later_x") - F.col("first_x"), F.col("first_x")
    inwards = ((x <= ENTRY_EDGE * frame.width) & (net > 0)) | ((x >= frame.width - ENTRY_EDGE * frame.width) & (net < 0))
    lasts = (possible > 0) & (n >= F.greatest(F.lit(floor), F.floor(possible * share)))
    stays = _enters_at_edge(frame) & ((F.col("f1") >= int(frame.total * 0.95)) | (lasts & inwards))
    return lambda alive: (n < int(frame.total * share)) & ~stays


@_rule
def audience(frame: Frame) -> Rule:
    """Median centre of the early observations in the lower right corner."""
    return lambda alive: F.coalesce((F.col("start_x") >= 0.75 * frame.width) & (F.col("start_y") >= 0.70 * frame.height), F.lit(False))


@_rule
def late_and_short(frame: Frame) -> Rule:
    """Starts after 35 % of the frames, spans under 17 %, and does not enter from the outer 8 % on any side."""
    late = (F.col("f0") >= int(frame.total * 0.35)) & (F.col("f1") - F.col("f0") + 1 < int(frame.total * 0.17))
    return lambda alive: late & ~_enters_at_edge(frame)


@_rule
def size_outliers(frame: Frame, low: float = 0.4, high: float = 2.0) -> Rule:
    """Median height beyond ``low`` to ``high`` times the group's median (more in front); three tracks at least."""
    most = F.when(F.col("my") >= FRONT * frame.height, high * FRONT_FACTOR).otherwise(F.lit(high))

    def test(alive: Column) -> Column:
        ratio = F.col("mh") / _group(alive, F.col("mh"), F.median)
        return (_count(alive, F.col("mh")) >= 3) & F.coalesce((ratio < low) | (ratio > most), F.lit(False))

    return test


@_rule
def wide_boxes(most: float = 2.5) -> Rule:
    """Median width over height above ``most``; three tracks at least."""
    return lambda alive: (_count(alive) >= 3) & F.coalesce(F.col("wh") > most, F.lit(False))


def _against(alive: Column, least: float) -> Column:
    """Moves against a group that moves; two tracks at least."""
    group = _group(alive, F.col("vx"), F.median)
    return (_count(alive) >= 2) & F.coalesce((F.abs(group) >= least) & (F.col("vx") * group < 0), F.lit(False))


@_rule
def mirrors(share: float = 0.30, least: float = 1.0) -> Rule:
    """Often at an edge while it moves, and moving against the group."""
    return lambda alive: _against(alive, least) & F.coalesce(F.col("moving_edge") >= share, F.lit(False))


@_rule
def smart_mirrors(share: float = 0.30, least: float = 1.0, lower: float = 0.3) -> Rule:
    """A mirror whose lower body is hardly seen (``lower_mean`` of the pose facts; none counts as 0)."""
    return lambda alive: mirrors(share, least)(alive) & (F.coalesce("lower_mean", F.lit(0.0)) < lower)


@_rule
def low_confidence(least: float = 0.45) -> Rule:
    """75th percentile of the frames' mean keypoint scores under ``least``; three tracks at least."""
    return lambda alive: (_count(alive) >= 3) & F.coalesce(F.col("score_p75") < least, F.lit(False))


@_rule
def jitter(most: float = 0.10) -> Rule:
    """Mean movement of a joint over the median height above ``most``; three tracks at least."""
    return lambda alive: (_count(alive) >= 3) & F.coalesce(F.col("mean_move") / F.col("mh") > most, F.lit(False))


@_rule
def completeness(low: float = 0.35, shoulders: float = 0.35, corner_low: float = 0.45, corner_shoulders: float = 0.25) -> Rule:
    """Shoulders that are seen over a lower body that never is; other limits for tracks mostly in a corner."""
    corner = F.col("corner") >= 0.5
    hit = (F.col("lower_p95") < F.when(corner, corner_low).otherwise(low)) & (F.col("shoulders") > F.when(corner, corner_shoulders).otherwise(shoulders))
    return lambda alive: F.coalesce(hit, F.lit(False))


@_rule
def head_only(frame: Frame, size: float = 0.4, share: float = 0.9, far: float = 2.0) -> Rule:
    """Small, its lower body unseen in nearly all frames, and in a corner or far from the group; three tracks at least."""

    def test(alive: Column) -> Column:
        small = F.col("mh") < size * _group(alive, F.col("mh"), F.median)
        away = (F.col("corner") >= 0.5) | (deviation(alive & F.col("mh").isNotNull(), frame) > far)
        return (_count(alive, F.col("mh")) >= 3) & F.coalesce(small & (F.col("lower_unseen") >= share) & away, F.lit(False))

    return test


@_rule
def low_sync(frame: Frame, least: float = 0.10) -> Rule:
    """No joint's angle goes with the group's (``best_r``; none counts as 0), but for late entrants with under 100 frames; three tracks at least."""
    late = (F.col("f0") >= 0.25 * frame.total) & (F.col("n") < 100)
    return lambda alive: (_count(alive) >= 3) & ~late & F.col("score_p75").isNotNull() & (F.coalesce("best_r", F.lit(0.0)) < least)


def confirmed(frame: Frame, share: float = 0.40, span: float = 0.10, edge: float = 0.20) -> Column:
    """Tier A: a sure torso in enough frames, over enough time, and seldom at an edge."""
    lasts = (F.col("last_pose") - F.col("first_pose")) / max(frame.total, 1) >= span
    return F.coalesce((F.col("torso_share") >= share) & lasts & (F.col("edge") <= edge), F.lit(False))


def no_skeleton(share: float = 0.80) -> Column:
    """Tier C: hardly any score in most pose frames, or no pose at all."""
    return F.coalesce(F.col("unsure_share") >= share, F.lit(True))


def hits(facts: DataFrame, rule: Rule) -> DataFrame:
    """The tracks (seq_id, track_id) that a single rule takes from all."""
    return facts.withColumn("hit", rule(F.lit(True))).where("hit").select(*KEY)


def chain(facts: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """``facts`` with the rule that takes a track (null: it stays): each rule judges what the rules before it have left."""
    out = facts.withColumn("rule", F.lit(None).cast("string"))
    for name, rule in rules.items():
        alive = F.col("rule").isNull()
        out = out.withColumn("rule", F.when(alive & rule(alive), F.lit(name)).otherwise(F.col("rule")))
    return out


def pruned(facts: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """(rule, seq_id, track_id) of the tracks that a chain takes."""
    return chain(facts, rules).where("rule is not null").select("rule", *KEY)


def votes(facts: DataFrame, rules: dict[str, Rule], weights: dict[str, float] = VOTE_WEIGHTS) -> DataFrame:
    """``facts`` with ``hits`` (rules that hit) and ``votes`` (their weights' sum): all rules judge all tracks."""
    each = {f"_{name}": rule(F.lit(True)) for name, rule in rules.items()}
    out = facts.withColumns(each)
    total = sum((F.when(F.col(f"_{name}"), weights.get(name, 0.0)).otherwise(0.0) for name in rules), F.lit(0.0))
    names = F.filter(F.array(*[F.when(F.col(f"_{name}"), F.lit(name)) for name in rules]), lambda x: x.isNotNull())
    return out.withColumns({"hits": F.array_join(names, ","), "votes": F.round(total, 4)}).drop(*each)


def tiers(facts: DataFrame, rules: dict[str, Rule], frame: Frame, limit: float = VOTE_LIMIT) -> DataFrame:
    """Per track: tier C (no skeleton), A (confirmed), B (voted out) or null, whether it goes (C or B), hits and votes.

    Tier C goes first; the others vote among themselves; confirmed tracks are never voted out.
    """
    gone = facts.where(no_skeleton()).select(*KEY, F.lit("C").alias("tier"), F.lit(True).alias("goes"), F.lit("").alias("hits"), F.lit(0.0).alias("votes"))
    voted = votes(facts.where(~no_skeleton()), rules).withColumn("sure", confirmed(frame))
    tier = F.when(F.col("sure"), "A").when(F.col("votes") > limit, "B")
    rest = voted.select(*KEY, tier.alias("tier"), F.coalesce(tier == "B", F.lit(False)).alias("goes"), "hits", "votes")
    return gone.unionByName(rest)


def _half_up(value: Column, places: int) -> Column:
    """Rounded as the double times a power of ten, half away from zero; Spark's ``round`` to places goes by the shortest decimal text, whose last 5 the double may not reach."""
    return F.round(value * float(10**places)) / float(10**places)


def info(facts: DataFrame, frame: Frame) -> DataFrame:
    """A record of each track for the prune log: counts, range, median box, position in percent, share of the video."""
    x, y, w, h = F.col("mx"), F.col("my"), F.coalesce("mw", F.lit(0.0)), F.coalesce("mh", F.lit(0.0))
    whole = (w > 0) & (h > 0)
    box = F.when(whole, F.array(_half_up(x - w / 2, 1), _half_up(y - h / 2, 1), _half_up(x + w / 2, 1), _half_up(y + h / 2, 1)))
    return facts.select(
        *KEY, F.col("n").alias("n_frames"), F.col("f0").alias("first_frame"), F.col("f1").alias("last_frame"), _half_up(x, 1).alias("median_x"), _half_up(y, 1).alias("median_y"),
        _half_up(h, 1).alias("median_h"), _half_up(w, 1).alias("median_w"), F.when(h > 0, _half_up(w / h, 2)).alias("aspect_ratio"), box.alias("median_box"),
        _half_up((F.col("f1") - F.col("f0")) / frame.total, 4).alias("frames_in_video"), _half_up(100 * x / frame.width, 1).alias("pos_x"), _half_up(100 * y / frame.height, 1).alias("pos_y"),
    )
