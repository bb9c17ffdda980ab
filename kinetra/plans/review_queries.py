"""Queries of review operators, and the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.operators import review
from kinetra.plans.rounding import rounded
from kinetra.plans.rounding import rounded_sql as _r
from kinetra.plans.track_queries import _G, _PAIRS
from kinetra.sources.derived import KEYPOINTS_SQL, OBS_SQL, keypoints, obs


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf)
    return o.select((F.col("track_id") * 100 + F.col("frame_idx")).alias("anchor_id"), "seq_id", "frame_idx", (F.col("x1") - 3).alias("x"), (F.col("y1") + 5).alias("y"))


def _pruned(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf)
    return o.groupBy("seq_id", "track_id").agg(F.min("frame_idx").alias("first"), (F.min("frame_idx") + 9).alias("last")).withColumn("rule", F.lit("first_ten"))


def _dropped(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf)
    return review.dropped(o, o.where("frame_idx % 5 != 0"), o.where("frame_idx % 5 != 0 and track_id % 3 != 0"))


def _pruned_boxes(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf)
    log = o.select("seq_id", "track_id").distinct().where("track_id % 3 != 1").select("seq_id", "track_id", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit("first").alias("rule")), F.struct(F.lit(1).alias("place"), F.concat(F.lit("rule"), F.col("track_id") % 2).alias("rule")))).alias("e"))
    posed = o.where("track_id % 3 != 2 and frame_idx % 4 != 0")
    return review.pruned_boxes(log.select("seq_id", "track_id", "e.place", "e.rule"), posed, o, o.where("track_id % 2 = 0"))


def _keyframes(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf).groupBy("seq_id", "frame_idx").agg(F.min("x1").alias("value"))
    return review.between_keyframes(o, o.where("frame_idx % 7 = 3"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "anchor_tracks": lambda s, d: review.anchor_tracks(obs(s, d), _anchors(s, d), 40.0).na.fill({"track_id": -1, "inside": False}),
    "prune_overlay": lambda s, d: rounded(review.overlay(_pruned(s, d), obs(s, d))),
    "dropped_overlay": _dropped,
    "pruned_boxes": lambda s, d: rounded(_pruned_boxes(s, d)),
    "between_keyframes": lambda s, d: rounded(_keyframes(s, d)),
    "acceleration_flags": lambda s, d: rounded(review.acceleration_flags(obs(s, d), 0.05)),
    "enrolment_frame": lambda s, d: rounded(review.enrolment_frame(obs(s, d), 3, 300, 1.0)),
    "visibility": lambda s, d: rounded(review.visibility(obs(s, d))),
    "isolated_observations": lambda s, d: rounded(review.isolated(obs(s, d), 0.3)),
    "held_boxes": lambda s, d: rounded(review.held(obs(s, d), 60)),
    "resampled_boxes": lambda s, d: rounded(review.resampled(obs(s, d), 0.4, 150), 9),
    "temperature_scaling": lambda s, d: rounded(obs(s, d).select("track_id", "frame_idx", review.scaled(F.col("conf"), 1.7).alias("p"))),
    "bone_lengths": lambda s, d: rounded(review.bone_lengths(keypoints(s, d))),
    "motion_peaks": lambda s, d: review.motion_peaks(keypoints(s, d)),
    "movement_peaks": lambda s, d: rounded(review.movement_peaks(keypoints(s, d), 1.05)),
    "formation_error": lambda s, d: rounded(review.formation_error(keypoints(s, d), 10)),
}

_O, _K = "with " + OBS_SQL.strip(), "with " + KEYPOINTS_SQL.strip()
_BONES = ", ".join(f"({a}, {b})" for a, b in review.BONES)
_MOVED = """mv as (select *, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as moved from kp window w as (partition by seq_id, track_id, j order by frame_idx))"""

ORACLE_SQL: dict[str, str] = {
    "anchor_tracks": f"""{_O},{_G}, an as (select track_id * 100 + frame_idx as anchor_id, seq_id, frame_idx, x1 - 3 as x, y1 + 5 as y from obs),
m as (select anchor_id, track_id, x between x1 and x2 and y between y1 and y2 as inside, w * h as area, sqrt(power(cx - x, 2) + power(cy - y, 2)) as dist from an join g using (seq_id, frame_idx)),
b as (select * from m where inside or dist <= 40 qualify row_number() over (partition by anchor_id order by inside desc, case when inside then area else dist end, track_id) = 1)
select an.anchor_id, coalesce(b.track_id, -1) as track_id, coalesce(b.inside, false) as inside from an left join b using (anchor_id)""",
    "prune_overlay": f"""{_O}, p as (select seq_id, track_id, min(frame_idx) as f from obs group by all) select 'first_ten' as rule, seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2')} from obs join p using (seq_id, track_id) where frame_idx between f and f + 9""",
    "dropped_overlay": f"{_O} select seq_id, track_id, frame_idx, case when frame_idx % 5 = 0 then 1 else 2 end as step from obs where frame_idx % 5 = 0 or track_id % 3 = 0",
    "pruned_boxes": f"""{_O}, p as (select * from obs where track_id % 3 <> 2 and frame_idx % 4 <> 0), r as (select *, case when track_id % 3 = 1 then 'post_pose' else 'rule' || track_id % 2 end as rule from p where track_id % 2 = 0
  union all select *, 'rule' || track_id % 2 from obs where track_id % 3 <> 1 and (seq_id, track_id) not in (select (seq_id, track_id) from p) and (seq_id, frame_idx) in (select (seq_id, frame_idx) from p)) select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2')}, rule from r""",
    "between_keyframes": f"""{_O}, o as (select seq_id, frame_idx, min(x1) as v from obs group by all), k as (select * from o where frame_idx % 7 = 3),
lo as (select o.seq_id, o.frame_idx, k.frame_idx as f0, k.v as v0 from o asof left join k on o.seq_id = k.seq_id and o.frame_idx >= k.frame_idx), hi as (select lo.*, k.frame_idx as f1, k.v as v1 from lo asof left join k on lo.seq_id = k.seq_id and lo.frame_idx <= k.frame_idx),
r as (select seq_id, frame_idx, case when f0 is null then v1 when f1 is null or f1 = f0 then v0 else v0 + (frame_idx - f0) / (f1 - f0) * (v1 - v0) end as value from hi) select seq_id, frame_idx, {_r('value')} from r""",
    "acceleration_flags": f"""{_O},{_G}, l as (select *, sqrt(power(cx - lag(cx) over w, 2) + power(cy - lag(cy) over w, 2)) as moved, frame_idx - lag(frame_idx) over w as step from g window w as (partition by seq_id, track_id order by frame_idx))
select seq_id, track_id, frame_idx, {_r('moved')} from l where step <= 2 and l.moved > 0.05 * h""",
    "enrolment_frame": f"""{_O},{_G},{_PAIRS}, d as (select seq_id, frame_idx, min(dist) as d from pr where frame_idx % 3 = 0 and frame_idx < 300 group by all), n as (select seq_id, frame_idx, count(*) as n from obs group by all),
s as (select seq_id, frame_idx, n, round(d * n, 6) as score from d join n using (seq_id, frame_idx) where d >= 1)
select seq_id, frame_idx, n, {_r('score')} from s qualify row_number() over (partition by seq_id order by s.score desc, frame_idx) = 1""",
    "visibility": f"""{_O},{_G}, c0 as (select a.seq_id, a.frame_idx, a.track_id, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / greatest(a.w * a.h, 1e-6) as c
  from g a join g b on a.seq_id = b.seq_id and a.frame_idx = b.frame_idx and a.track_id <> b.track_id and b.y2 > a.y2),
c as (select seq_id, frame_idx, track_id, max(c) as c from c0 where c > 0.85 group by all), v as (select seq_id, track_id, frame_idx, 1 - coalesce(c, 0) as visible, c is not null as hidden from obs left join c using (seq_id, frame_idx, track_id))
select seq_id, track_id, frame_idx, {_r('visible')}, hidden from v""",
    "isolated_observations": f"""{_O},{_G},{_PAIRS}, u as (select seq_id, frame_idx, a as track_id, dist from pr union all select seq_id, frame_idx, b, dist from pr), c as (select seq_id, frame_idx, track_id, min(dist) as d from u group by all),
o as (select seq_id, track_id, frame_idx, d, h from g left join c using (seq_id, frame_idx, track_id)) select seq_id, track_id, frame_idx, floor((o.d)::double * 1e5 + 0.5) / 1e5 as d from o where o.d is null or o.d > 0.3 * h""",
    "held_boxes": f"""{_O}, s as (select seq_id, track_id, unnest(range(min(frame_idx), 60)) as frame_idx from obs group by seq_id, track_id),
h as (select s.seq_id, s.track_id, s.frame_idx, o.x1, o.y1, o.x2, o.y2 from s asof join obs o on s.seq_id = o.seq_id and s.track_id = o.track_id and s.frame_idx >= o.frame_idx) select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2')} from h""",
    "resampled_boxes": f"""{_O}, t as (select t, floor(t * 0.4::double)::bigint as lo, t * 0.4::double - floor(t * 0.4::double) as al from range(150) as r(t)),
m as (select a.seq_id, a.track_id, t, a.x1 * (1 - al) + b.x1 * al as x1, a.y1 * (1 - al) + b.y1 * al as y1, a.x2 * (1 - al) + b.x2 * al as x2, a.y2 * (1 - al) + b.y2 * al as y2
  from t join obs a on a.frame_idx = lo join obs b on b.seq_id = a.seq_id and b.track_id = a.track_id and b.frame_idx = lo + 1) select seq_id, track_id, t, {_r('x1', 'y1', 'x2', 'y2', places=9)} from m""",
    "temperature_scaling": f"{_O}, q as (select track_id, frame_idx, greatest(1e-6, least(1 - 1e-6, conf)) as q from obs) select track_id, frame_idx, floor((1 / (1 + exp(-ln(q / (1 - q)) / 1.7)))::double * 1e5 + 0.5) / 1e5 as p from q",
    "bone_lengths": f"""{_K}, b(p, q) as (values {_BONES}), l as (select a.seq_id, a.track_id, b.p, b.q, median(sqrt(power(a.x - c.x, 2) + power(a.y - c.y, 2))) as length from b join kp a on a.j = b.p join kp c on c.j = b.q and c.track_id = a.track_id and c.frame_idx = a.frame_idx group by all)
select seq_id, track_id, p, q, {_r('length')} from l""",
    "motion_peaks": f"""{_K}, {_MOVED}, p as (select seq_id, track_id, frame_idx, round(avg(moved), 6) as m from mv where j in (9, 10, 15, 16) group by all having avg(moved) is not null)
select seq_id, track_id, frame_idx as peak_frame, m as peak from p qualify row_number() over (partition by seq_id, track_id order by m desc, frame_idx) = 1""",
    "movement_peaks": f"""{_K}, {_MOVED}, p as (select seq_id, track_id, frame_idx, avg(moved) as m from mv group by all having avg(moved) is not null),
t as (select *, lag(m) over w as before, lead(m) over w as after, median(m) over (partition by seq_id, track_id) as mid from p window w as (partition by seq_id, track_id order by frame_idx)) select seq_id, track_id, frame_idx, {_r('m')} from t where t.m > before and t.m > after and t.m > 1.05 * mid""",
    "formation_error": f"""{_K}, c as (select seq_id, track_id, frame_idx, avg(x) as x, avg(y) as y from kp group by all), r as (select seq_id, track_id, frame_idx, x - avg(x) over (partition by seq_id, frame_idx) as rx, y - avg(y) over (partition by seq_id, frame_idx) as ry from c),
h as (select seq_id, track_id, avg(rx) as hx, avg(ry) as hy from r where frame_idx < 10 group by all), e as (select seq_id, track_id, avg(sqrt(power(rx - hx, 2) + power(ry - hy, 2))) as error from r join h using (seq_id, track_id) group by all) select seq_id, track_id, {_r('error')} from e""",
}
