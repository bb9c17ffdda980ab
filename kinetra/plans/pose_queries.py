"""Queries on the derived keypoints, and the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.operators import pose, prune
from kinetra.plans.rounding import half_up_sql, rounded
from kinetra.plans.rounding import rounded_sql as _r
from kinetra.plans.track_queries import _G, _GROUP, FRAME, _facts
from kinetra.sources.derived import KEYPOINTS_SQL, OBS_SQL, keypoints, obs


def _angles(spark: SparkSession, sf: str) -> DataFrame:
    return pose.joint_angles(keypoints(spark, sf))


def _deviations(spark: SparkSession, sf: str) -> DataFrame:
    a = _angles(spark, sf)
    return pose.deviations(a, pose.consensus(a), 60.0)


def _best_r(spark: SparkSession, sf: str) -> DataFrame:
    a = _angles(spark, sf)
    return pose.low_sync(a, pose.consensus(a), 3)


def _all_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of boxes, poses and synchrony for each track; poses may be missing."""
    boxes, poses = prune.facts(obs(spark, sf), FRAME), pose.facts(keypoints(spark, sf), unseen=0.5, unsure=0.45)
    return boxes.join(poses, prune.KEY, "left").join(_best_r(spark, sf), prune.KEY, "left")


def _crowd(spark: SparkSession, sf: str) -> DataFrame:
    """All poses in two sequences, drawn together around four places, so that poses of a frame are near copies."""
    kp = keypoints(spark, sf)
    return kp.withColumns({"seq_id": F.col("track_id") % 2, "x": 100.0 * (F.col("track_id") % 4) + 3.0 * F.floor(F.col("track_id") / 4) + 0.3 * (F.col("x") - 500), "y": 300.0 + 5.0 * F.floor(F.col("track_id") / 4) + 0.5 * (F.col("y") - 300)})


def _extents(kp: DataFrame) -> DataFrame:
    return kp.groupBy(*pose.POSE).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))


DUPLICATES = pose.Duplicates(joints=0.4, centres=0.25, overlap=0.3, tight=0.3, torso=0.4, oks=0.02)


def _duplicates(spark: SparkSession, sf: str, counts: bool) -> DataFrame:
    kp = _crowd(spark, sf)
    protected = kp.where("track_id in (2, 11)").select("seq_id", "track_id").distinct()
    return pose.suppressed_duplicates(DUPLICATES.conflicts(kp, _extents(kp), protected, counts))


#: The six rules of the vote, with limits at which these tables' random poses give hits of each.
VOTERS = {
    "low_sync": prune.low_sync(FRAME, 0.6),
    "smart_mirror": prune.smart_mirrors(0.0, 0.0, 0.55),
    "completeness": prune.completeness(1.01, 0.5, 1.01, 0.5),
    "head_only": prune.head_only(FRAME, 1.05, 0.3, 1.0),
    "low_confidence": prune.low_confidence(0.57),
    "jitter": prune.jitter(0.6),
}


def _rule(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: prune.hits(_all_facts(s, d), VOTERS[name])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "keypoints": lambda s, d: rounded(keypoints(s, d)),
    "joint_angles": lambda s, d: rounded(_angles(s, d)),
    "pose_consensus": lambda s, d: rounded(pose.consensus(_angles(s, d)), 4),
    "pose_deviation": lambda s, d: rounded(_deviations(s, d), 4),
    "pose_summaries": lambda s, d: rounded(pose.summaries(_deviations(s, d)).drop("worst_joints"), 4),
    "worst_joints": lambda s, d: pose.summaries(_deviations(s, d)).select(*pose.TRACK, "worst_joints"),
    "pose_facts": lambda s, d: rounded(pose.facts(keypoints(s, d))),
    "pose_legacy_mirrors": lambda s, d: pose.legacy_mirrors(pose.facts(keypoints(s, d)), 0.1),
    "pose_correlation": lambda s, d: rounded(_best_r(s, d)),
    **{f"pose_{name}": _rule(name) for name in VOTERS},
    "pose_confirmed": lambda s, d: _all_facts(s, d).where(prune.confirmed(FRAME, 0.4, 0.01, 0.5)).select(*prune.KEY),
    "pose_no_skeleton": lambda s, d: _all_facts(s, d).where(prune.no_skeleton(0.3)).select(*prune.KEY),
    "pose_smoothing": lambda s, d: rounded(pose.smoothed(keypoints(s, d))),
    "pose_similarity": lambda s, d: rounded(pose.similarity(keypoints(s, d), obs(s, d))),
    "duplicate_poses": lambda s, d: _duplicates(s, d, True),
    "duplicate_poses_by_score": lambda s, d: _duplicates(s, d, False),
    "pose_vote": lambda s, d: rounded(prune.tiers(_all_facts(s, d), VOTERS, FRAME)),
}



def _place(j: int | tuple[int, int], c: str) -> str:
    return f"((k[{j[0] + 1}].{c} + k[{j[1] + 1}].{c}) / 2)" if isinstance(j, tuple) else f"k[{j + 1}].{c}"


def _angle(name: str, ends: tuple) -> str:
    """SQL of one joint's angle over ``wide`` (poses with an array k of joints)."""
    joints = [k for j in ends for k in (j if isinstance(j, tuple) else (j,))]
    (ax, ay), (bx, by), (cx, cy) = ((_place(j, "x"), _place(j, "y")) for j in ends)
    dot = f"({ax} - {bx}) * ({cx} - {bx}) + ({ay} - {by}) * ({cy} - {by})"
    size = f"sqrt(power({ax} - {bx}, 2) + power({ay} - {by}, 2)) * sqrt(power({cx} - {bx}, 2) + power({cy} - {by}, 2))"
    sure = f"least({', '.join(f'k[{j + 1}].s' for j in joints)}) >= 0.3"
    return f"select seq_id, track_id, frame_idx, '{name}' as joint, case when {sure} then degrees(acos(greatest(-1.0, least(1.0, ({dot}) / nullif({size}, 0))))) end as angle from wide"


_WIDE = "wide as (select seq_id, track_id, frame_idx, list({x: x, y: y, s: s, j: j} order by j) as k from kp group by all)"
_ANGLES = f"{_WIDE}, an as (" + " union all ".join(_angle(n, e) for n, e in pose.ANGLES.items()) + ")"
_TRUTH = """
t0 as (
  select seq_id, frame_idx, joint, degrees(atan2(avg(sin(radians(angle * 2))), avg(cos(radians(angle * 2))))) / 2 as c, stddev_pop(angle) as ripple
  from an where angle is not null group by all),
t1 as (select seq_id, frame_idx, joint, ripple, (c + 180) - 180 * floor((c + 180) / 180) as circular_mean from t0),
tr as (select *, quantile_cont(circular_mean, 0.5) over (partition by seq_id, joint order by frame_idx rows between 2 preceding and 2 following) as truth from t1),
dv as (
  select an.seq_id, an.track_id, an.frame_idx, an.joint, case when ripple <= 60 then least(abs(angle - truth), 180 - abs(angle - truth)) end as deviation
  from an join tr using (seq_id, frame_idx, joint)),
br0 as (select an.seq_id, track_id, joint, count(*) as n, corr(angle, truth) as r, stddev_pop(angle) as sa, stddev_pop(truth) as st from an join tr using (seq_id, frame_idx, joint) where angle is not null group by all),
br as (select seq_id, track_id, max(abs(r)) as best_r from br0 where n >= 3 and sa >= 1e-6 and st >= 1e-6 group by all)
"""


def _pose_facts(unseen: float, unsure: float) -> str:
    return f"""
pl as (select *, case when frame_idx - lag(frame_idx) over w <= 2 then sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) end as moved from kp window w as (partition by seq_id, track_id, j order by frame_idx)),
pj as (select seq_id, track_id, quantile_cont(s, 0.95) filter (j >= 13) as lower_p95, avg(s) filter (j in (5, 6)) as shoulders, avg(moved) as mean_move from pl group by all),
pm as (select seq_id, track_id, frame_idx, avg(s) as m, avg(s) filter (j >= 13) as lower, avg(s) filter (j in (5, 6, 11, 12)) as torso from kp group by all),
pp as (
  select seq_id, track_id, count(*) as n_poses, min(frame_idx) as first_pose, max(frame_idx) as last_pose, quantile_cont(m, 0.75) as score_p75, avg(lower) as lower_mean,
    avg(case when lower < {unseen} then 1.0 else 0.0 end) as lower_unseen, avg(case when lower < 0.3 then 1.0 else 0.0 end) as lower_low,
    avg(case when torso >= 0.5 then 1.0 else 0.0 end) as torso_share, avg(case when m < {unsure} then 1.0 else 0.0 end) as unsure_share from pm group by all),
pf as (select * from pp join pj using (seq_id, track_id))"""


_SIGMA = "[" + ", ".join(map(str, pose.SIGMAS)) + "]"
_HEAD = "with " + KEYPOINTS_SQL.strip()
_FULL = f"{_HEAD}, {OBS_SQL.strip()}, {_G.strip()}, {_facts()}, {_ANGLES}, {_TRUTH.strip()}, {_pose_facts(0.5, 0.45).strip()}, al as (select * from fa left join pf using (seq_id, track_id) left join br using (seq_id, track_id))"
_DEVIATES = "greatest(abs(mx - gx) / sx, abs(my - gy) / sy)"
_VOTER = {
    "low_sync": "k >= 3 and not (f0 >= 0.25 * 60 and n < 100) and score_p75 is not null and coalesce(best_r, 0.0) < 0.6",
    "smart_mirror": "k >= 2 and vx * gv < 0 and moving_edge >= 0 and coalesce(lower_mean, 0.0) < 0.55",
    "completeness": "lower_p95 < 1.01 and shoulders > 0.5",
    "head_only": f"k >= 3 and mh < 1.05 * gh and lower_unseen >= 0.3 and (corner >= 0.5 or {_DEVIATES} > 1.0)",
    "low_confidence": "k >= 3 and score_p75 < 0.57",
    "jitter": "k >= 3 and mean_move / mh > 0.6",
}


def _voter(name: str) -> str:
    return f"{_FULL}, w as (select *, {_GROUP} from al window s as (partition by seq_id)) select seq_id, track_id from w where {_VOTER[name]}"


_HITS = [f"coalesce({_VOTER[name]}, false)" for name in VOTERS]
_VOTED = " + ".join(f"case when {h} then {prune.VOTE_WEIGHTS[n]} else 0 end" for n, h in zip(VOTERS, _HITS, strict=True))
_NAMED = ", ".join(f"case when {h} then '{n}' end" for n, h in zip(VOTERS, _HITS, strict=True))

#: The crowd of ``_crowd`` in SQL.
_CROWD = """cr as (select * replace (track_id % 2 as seq_id, 100.0::double * (track_id % 4) + 3.0 * (track_id // 4) + 0.3::double * (x - 500) as x, 300.0::double + 5.0 * (track_id // 4) + 0.5::double * (y - 300) as y) from kp)"""


def _duplicates_sql(counts: bool) -> str:
    """Turns one after another: a step is the next track of each frame, with the list of those gone so far."""
    area = lambda s: f"greatest(({s}.x2 - {s}.x1) * ({s}.y2 - {s}.y1), 1.0)"
    both = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
    loser = "case when an < bn then a else b end" if counts else "case when abs(aconf - bconf) < 1e-5 or aconf >= bconf then b else a end"
    outlasted = "joints < 0.12::double * tall and not (iou > 0.5 and joints < 0.25::double * tall) and ((asafe and bn >= 3 * an) or (bsafe and an >= 3 * bn))" if counts else "false"
    return f"""{_HEAD.replace("with ", "with recursive ", 1)},
{_CROWD},
po as (
  select seq_id, track_id, frame_idx, list({{x: x, y: y, s: s}} order by j) as k, min(x) as x1, min(y) as y1, max(x) as x2, max(y) as y2, list_sum(list(s order by j)) / 17 as conf,
    track_id in (2, 11) as safe, count(*) over (partition by seq_id, track_id) as n from cr group by seq_id, track_id, frame_idx),
pp as (
  select a.seq_id, a.frame_idx, a.track_id as a, b.track_id as b, a.n as an, b.n as bn, a.safe as asafe, b.safe as bsafe, a.conf as aconf, b.conf as bconf, a.k as ak, b.k as bk,
    coalesce({both} / nullif((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {both}, 0), 0) as iou, greatest(a.y2 - a.y1, b.y2 - b.y1, 1.0) as tall,
    greatest({both} / greatest((a.x2 - a.x1) * (a.y2 - a.y1), 1e-6), {both} / greatest((b.x2 - b.x1) * (b.y2 - b.y1), 1e-6)) as inside, ({area("a")} + {area("b")}) / 2 as scale,
    sqrt(power((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + power((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) as apart
  from po a join po b on a.seq_id = b.seq_id and a.frame_idx = b.frame_idx and a.track_id < b.track_id),
fa as (select *, list_transform(range(1, 18), lambda i: power(ak[i].x - bk[i].x, 2) + power(ak[i].y - bk[i].y, 2)) as d2, list_filter(range(1, 18), lambda i: ak[i].s > 0.01 and bk[i].s > 0.01) as seen from pp),
ga as (
  select *, sqrt(list_median(d2)) as joints, list_median([sqrt(d2[6]), sqrt(d2[7]), sqrt(d2[12]), sqrt(d2[13])]) as torso,
    coalesce(list_sum(list_transform(seen, lambda i: exp(-d2[i] / (2 * scale * power({_SIGMA}[i], 2) + 1e-9)))) / nullif(len(seen), 0), 0) as oks from fa),
ed as (
  select *, {loser} as loser from ga where inside <= 0.7 and joints <= 0.4::double * tall and (iou >= 0.3 or joints < 0.3::double * tall) and torso <= 0.4::double * tall and oks >= 0.02
    and (joints < 0.3::double * tall or apart <= 0.25::double * tall) and not ((asafe or bsafe) and not (iou > 0.5 and joints < 0.25::double * tall) and not joints < 0.12::double * tall) and not ({outlasted})),
el as (select seq_id, frame_idx, a, list({{b: b, loser: loser}} order by b) as es, row_number() over (partition by seq_id, frame_idx order by a) as turn from ed group by seq_id, frame_idx, a),
go(seq_id, frame_idx, turn, gone) as (
  select seq_id, frame_idx, 0::bigint, []::bigint[] from el group by seq_id, frame_idx
  union all
  select go.seq_id, go.frame_idx, el.turn, case when list_contains(gone, el.a) then gone else list_concat(gone, list_transform(list_filter(es, lambda e: not list_contains(gone, e.b)), lambda e: e.loser)) end
  from go join el on el.seq_id = go.seq_id and el.frame_idx = go.frame_idx and el.turn = go.turn + 1)
select distinct seq_id, frame_idx, unnest(gone) as track_id from go qualify turn = max(turn) over (partition by seq_id, frame_idx)"""


ORACLE_SQL: dict[str, str] = {
    "keypoints": f"{_HEAD} select seq_id, track_id, frame_idx, j, {_r('x', 'y', 's')} from kp",
    "joint_angles": f"{_HEAD}, {_ANGLES} select seq_id, track_id, frame_idx, joint, {_r('angle')} from an",
    "pose_consensus": f"{_HEAD}, {_ANGLES}, {_TRUTH} select seq_id, frame_idx, joint, {_r('circular_mean', 'ripple', 'truth', places=4)} from tr",
    "pose_deviation": f"{_HEAD}, {_ANGLES}, {_TRUTH} select seq_id, track_id, frame_idx, joint, {_r('deviation', places=4)} from dv",
    "pose_summaries": f"""{_HEAD}, {_ANGLES}, {_TRUTH}, m as (select seq_id, track_id, avg(deviation) as mean_deviation from dv group by all), j as (select distinct seq_id, track_id from dv where deviation is not null)
select seq_id, track_id, {_r('mean_deviation', places=4)}, {half_up_sql('round(greatest(0.0, 100 - 2 * m.mean_deviation), 1)', 4)} as sync_score from m semi join j using (seq_id, track_id)""",
    "worst_joints": f"""{_HEAD}, {_ANGLES}, {_TRUTH}, j as (select seq_id, track_id, joint, round(avg(deviation), 6) as d from dv group by all having avg(deviation) is not null),
k as (select *, row_number() over (partition by seq_id, track_id order by d desc, joint) as rn from j)
select seq_id, track_id, string_agg(joint, ',' order by rn) as worst_joints from k where rn <= 3 group by all""",
    "pose_facts": f"""{_HEAD}, {_pose_facts(0.1, 0.15).strip()} select seq_id, track_id, n_poses, first_pose, last_pose,
  {_r('score_p75', 'lower_mean', 'lower_unseen', 'lower_low', 'torso_share', 'unsure_share', 'lower_p95', 'shoulders', 'mean_move')} from pf""",
    "pose_legacy_mirrors": f"{_HEAD}, {_pose_facts(0.1, 0.15).strip()} select seq_id, track_id from pf where lower_low > 0.1",
    "pose_correlation": f"{_HEAD}, {_ANGLES}, {_TRUTH} select seq_id, track_id, {_r('best_r')} from br",
    **{f"pose_{name}": _voter(name) for name in VOTERS},
    "pose_confirmed": f"{_FULL} select seq_id, track_id from al where torso_share >= 0.4 and (last_pose - first_pose) / 60 >= 0.01 and edge <= 0.5",
    "pose_no_skeleton": f"{_FULL} select seq_id, track_id from al where coalesce(unsure_share >= 0.3, true)",
    "pose_smoothing": f"""{_HEAD}, n as (select a.seq_id, a.track_id, a.frame_idx, a.j, any_value(a.x) as ax, any_value(a.y) as ay, any_value(a.s) as s, sum(b.s / (1 + abs(a.frame_idx - b.frame_idx))) as w,
  sum(b.x * b.s / (1 + abs(a.frame_idx - b.frame_idx))) as wx, sum(b.y * b.s / (1 + abs(a.frame_idx - b.frame_idx))) as wy
  from kp a join kp b on a.track_id = b.track_id and a.j = b.j and b.frame_idx between a.frame_idx - 2 and a.frame_idx + 2 group by a.seq_id, a.track_id, a.frame_idx, a.j),
o as (select seq_id, track_id, frame_idx, j, case when w > 0 then wx / w else ax end as x, case when w > 0 then wy / w else ay end as y, s from n) select seq_id, track_id, frame_idx, j, {_r('x', 'y', 's')} from o""",
    "pose_similarity": f"""{_HEAD}, {OBS_SQL.strip()}, k as (select kp.*, (x2 - x1) * (y2 - y1) as area from kp join obs using (seq_id, track_id, frame_idx)),
o as (select a.seq_id, a.frame_idx, a.track_id as a, b.track_id as b, avg(exp(-(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / (2 * greatest((a.area + b.area) / 2, 1.0) * power({_SIGMA}[a.j + 1], 2) + 1e-9))) as oks, count(*) as n_joints
  from k a join k b on a.seq_id = b.seq_id and a.frame_idx = b.frame_idx and a.j = b.j and a.track_id < b.track_id and a.s > 0.01 and b.s > 0.01 group by all) select seq_id, frame_idx, a, b, {_r('oks')}, n_joints from o""",
    "pose_vote": f"""{_FULL}, w as (select *, {_GROUP} from al where not coalesce(unsure_share >= 0.8, true) window s as (partition by seq_id)),
v as (select seq_id, track_id, torso_share >= 0.4 and (last_pose - first_pose) / 60 >= 0.1 and edge <= 0.2 as sure, round({_VOTED}, 4)::double as votes, concat_ws(',', {_NAMED}) as hits from w),
o as (select seq_id, track_id, case when sure then 'A' when votes > 0.65 then 'B' end as tier, hits, votes from v union all select seq_id, track_id, 'C', '', 0.0 from al where coalesce(unsure_share >= 0.8, true))
select seq_id, track_id, tier, coalesce(tier in ('B', 'C'), false) as goes, hits, {_r('votes')} from o""",
    "duplicate_poses": _duplicates_sql(True),
    "duplicate_poses_by_score": _duplicates_sql(False),
}
