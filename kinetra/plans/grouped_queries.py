"""Queries of order-dependent operators and of evaluation, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.operators import evaluate, grouped, kalman, pose, review
from kinetra.plans.pose_queries import _ANGLES, _HEAD, _TRUTH
from kinetra.plans.review_queries import _BONES
from kinetra.plans.rounding import rounded
from kinetra.plans.rounding import rounded_sql as _r
from kinetra.sources.derived import KEYPOINTS_SQL, OBS_SQL, keypoints, obs


#: What the pretended tracker sees, and the ids it gives.
_SEEN = "(track_id + frame_idx) % 9 != 0"
_NAMED_SQL = "case when track_id % 5 = 0 and frame_idx >= 30 then track_id + 5000 else track_id end"


def _found(o: DataFrame) -> DataFrame:
    """A tracker's output to hold against ``o``: boxes moved, some missed, an id exchanged half way."""
    return o.where(_SEEN).select("seq_id", F.expr(_NAMED_SQL).alias("track_id"), "frame_idx", (F.col("x1") + 2).alias("x1"), "y1", (F.col("x2") + 2).alias("x2"), "y2", "conf")


def _clear(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf)
    f = _found(o)
    return evaluate.clear(o, f, evaluate.carried_matches(o, f))


def _shape(spark: SparkSession, sf: str) -> DataFrame:
    a = pose.joint_angles(keypoints(spark, sf))
    return grouped.shape_and_timing(a, pose.consensus(a))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Each track's first and last place as labelled events, held against a tracker's output."""
    o = obs(spark, sf)
    ids = o.where(_SEEN).select("seq_id", "frame_idx", F.col("track_id").alias("person"), F.expr(_NAMED_SQL).alias("id"))
    ends = o.groupBy("seq_id", F.col("track_id").alias("person")).agg(F.min("frame_idx").alias("p"), F.max("frame_idx").alias("q"))
    at = lambda e, side: ids.select("seq_id", "person", F.col("frame_idx").alias(e), F.col("id").alias(side))
    return ends.join(at("p", "before_id"), ["seq_id", "person", "p"], "left").join(at("q", "after_id"), ["seq_id", "person", "q"], "left")


def _joint_labels(spark: SparkSession, sf: str) -> DataFrame:
    return keypoints(spark, sf).select("seq_id", ((F.col("frame_idx") + F.col("j")) % 3 != 0).alias("visible"), F.when(F.col("j") % 5 != 0, F.col("s")).alias("score"))


#: What is known of each sequence.
EXPECTED = {"most_at_once": 20, "at_start": 21, "at_end": 22, "n_unique": 21, "late": 0}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "nms": lambda s, d: rounded(grouped.nms(obs(s, d), 0.5)),
    "diou_nms": lambda s, d: rounded(grouped.nms(obs(s, d), 0.4, distance=True)),
    "one_euro": lambda s, d: rounded(grouped.smooth_poses(keypoints(s, d))),
    "shape_and_timing": lambda s, d: rounded(_shape(s, d)),
    "clear_metrics": lambda s, d: rounded(_clear(s, d)),
    "identity_metrics": lambda s, d: rounded(evaluate.identity(obs(s, d), _found(obs(s, d)))),
    "hota_metrics": lambda s, d: rounded(evaluate.hota(obs(s, d), _found(obs(s, d)))),
    "lift_smoothing": lambda s, d: rounded(grouped.smooth_lift(keypoints(s, d), 40)),
    "reemergence": lambda s, d: rounded(evaluate.reemergence(_events(s, d))),
    "honesty": lambda s, d: rounded(evaluate.honesty(_joint_labels(s, d))),
    "bones_kept": lambda s, d: rounded(grouped.keep_bones(keypoints(s, d), review.bone_lengths(keypoints(s, d))), 3),
    "kalman_filtered": lambda s, d: rounded(kalman.filtered(obs(s, d))),
    "ground_truth_checks": lambda s, d: evaluate.checks(obs(s, d), EXPECTED, (320.0, 240.0), 10),
    "benchmark_metrics": lambda s, d: evaluate.benchmark(obs(s, d), 10),
}

_FOUND = """
fd as (select seq_id, case when track_id % 5 = 0 and frame_idx >= 30 then track_id + 5000 else track_id end as track_id, frame_idx, x1 + 2 as x1, y1, x2 + 2 as x2, y2 from obs where (track_id + frame_idx) % 9 <> 0)
"""


def _nms(threshold: float, distance: bool) -> str:
    """Suppression by recursion: frame by frame the boxes from the highest score down, each kept if no kept one overlaps it by the threshold."""
    both = "greatest(0.0, least(b.x2, o.x2) - greatest(b.x1, o.x1)) * greatest(0.0, least(b.y2, o.y2) - greatest(b.y1, o.y1))"
    areas = "((b.x2 - b.x1) * (b.y2 - b.y1) + (o.x2 - o.x1) * (o.y2 - o.y1))"
    measure = f"coalesce({both} / nullif({areas} - {both}, 0), 0)"
    if distance:
        near = "(power((b.x1 + b.x2 - o.x1 - o.x2) / 2, 2) + power((b.y1 + b.y2 - o.y1 - o.y2) / 2, 2))"
        measure += f" - {near} / (power(greatest(b.x2, o.x2) - least(b.x1, o.x1), 2) + power(greatest(b.y2, o.y2) - least(b.y1, o.y1), 2) + 1e-7)"
    box = "{track_id: track_id, x1: x1, y1: y1, x2: x2, y2: y2, conf: conf}"
    return f"""with recursive {OBS_SQL.strip()}, o as (select *, row_number() over (partition by seq_id, frame_idx order by conf desc, track_id) as k, {box} as me from obs),
r(seq_id, frame_idx, k, kept) as (select seq_id, frame_idx, k, [me] from o where k = 1
  union all select o.seq_id, o.frame_idx, o.k, case when len(list_filter(r.kept, lambda b: {measure} >= {threshold})) = 0 then list_append(r.kept, me) else r.kept end from r join o on r.seq_id = o.seq_id and r.frame_idx = o.frame_idx and o.k = r.k + 1),
y as (select seq_id, frame_idx, arg_max(kept, k) as kept from r group by all), z as (select seq_id, frame_idx, unnest(kept) as b from y), u as (select seq_id, b.track_id as track_id, frame_idx, b.x1 as x1, b.y1 as y1, b.x2 as x2, b.y2 as y2, b.conf as conf from z)
select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'conf')} from u"""


def _kalman() -> str:
    """The filter by recursion over each track's frames: places x, velocities v, variances a, c and covariance b of four axes, the noise's scale q and the last centres m."""
    each = lambda e: f"list_transform(range(1, 5), lambda i: {e})"
    return f"""with recursive {OBS_SQL.strip()},
z as (select seq_id, track_id, frame_idx as f, [(x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1] as z, lead(frame_idx) over (partition by seq_id, track_id order by frame_idx) as nf, row_number() over (partition by seq_id, track_id order by frame_idx) as k from obs),
last_seen as (select seq_id, track_id, max(frame_idx) as last from obs group by all),
r(seq_id, track_id, f, seen, p, x, v, a, b, c, q, m) as (
  select seq_id, track_id, f, true, z, z, [0.0, 0, 0, 0]::double[], [100.0, 100, 100, 100]::double[], [0.0, 0, 0, 0]::double[], [100.0, 100, 100, 100]::double[], 1.0::double, [{{x: z[1], y: z[2]}}] from z where k = 1
  union all
  select seq_id, track_id, g, z is not null, x1, case when z is null then x1 else {each("x1[i] + a1[i] / (a1[i] + 10) * (z[i] - x1[i])")} end, case when z is null then v else {each("v[i] + b1[i] / (a1[i] + 10) * (z[i] - x1[i])")} end,
    case when z is null then a1 else {each("(1 - a1[i] / (a1[i] + 10)) * a1[i]")} end, case when z is null then b1 else {each("(1 - a1[i] / (a1[i] + 10)) * b1[i]")} end,
    case when z is null then c1 else {each("c1[i] - b1[i] / (a1[i] + 10) * b1[i]")} end,
    case when len(m) < 3 then q when dx > 2 or dy > 2 then least(1 + sqrt(dx * dx + dy * dy) / 2, 10.0) else 1.0 end, case when z is null then m else list_slice(list_append(m, {{x: z[1], y: z[2]}}), -10, -1) end
  from (
    select *, abs(x1[1] - list_avg(list_transform(m, lambda e: e.x))) / (list_aggregate(list_transform(m, lambda e: e.x), 'stddev_pop') + 1e-6) as dx,
      abs(x1[2] - list_avg(list_transform(m, lambda e: e.y))) / (list_aggregate(list_transform(m, lambda e: e.y), 'stddev_pop') + 1e-6) as dy from (
      select r.* exclude (f, p, seen), r.f + 1 as g, o.z, {each("x[i] + v[i]")} as x1, {each("a[i] + 2 * b[i] + c[i] + 10 * q")} as a1, {each("b[i] + c[i]")} as b1, {each("c[i] + case when i <= 2 then 25 else 10 end * q")} as c1
      from r join last_seen l using (seq_id, track_id) left join z o on o.seq_id = r.seq_id and o.track_id = r.track_id and o.f = r.f + 1 where r.f < l.last))),
t as (
  select seq_id, track_id, f as frame_idx, p[1] - greatest(p[3], 1.0) / 2 as x1, p[2] - greatest(p[4], 1.0) / 2 as y1, p[1] + greatest(p[3], 1.0) / 2 as x2, p[2] + greatest(p[4], 1.0) / 2 as y2,
    x[1] as cx, x[2] as cy, x[3] as w, x[4] as h, v[1] as vx, v[2] as vy, q as scale from r where seen)
select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'cx', 'cy', 'w', 'h', 'vx', 'vy', 'scale')} from t"""


def _lift(total: int = 40, window: int = 11, order: int = 3) -> str:
    """Series filled on straight lines to every frame; a value is a row of the fitted polynomial's matrix times its window, at the ends the first or last window."""
    at = np.arange(window) - window // 2
    fit = np.vander(at, order + 1, increasing=True)
    rows = "[" + ", ".join("[" + ", ".join(f"{v!r}" for v in row) + "]" for row in (fit @ np.linalg.pinv(fit)).tolist()) + "]::double[][]"
    half = window // 2
    return f"""with {KEYPOINTS_SQL.strip()},
l as (select seq_id, track_id, j, max(frame_idx) as last, count(*) as k from kp group by all),
sp as (select seq_id, track_id, j, k, unnest(range(0, greatest({total}, last + 1))) as f from l),
fi as (
  select sp.*, kp.frame_idx is not null as here, kp.s, x, y, max(kp.frame_idx) over w as lo, min(kp.frame_idx) over v as hi, last_value(x ignore nulls) over w as lx, first_value(x ignore nulls) over v as hx, last_value(y ignore nulls) over w as ly, first_value(y ignore nulls) over v as hy
  from sp left join kp on kp.seq_id = sp.seq_id and kp.track_id = sp.track_id and kp.j = sp.j and kp.frame_idx = f
  window w as (partition by sp.seq_id, sp.track_id, sp.j order by f rows between unbounded preceding and current row), v as (partition by sp.seq_id, sp.track_id, sp.j order by f rows between current row and unbounded following)),
ln as (
  select *, case when lo is null then hx when hi is null or hi = lo then lx else lx + (hx - lx) * (f - lo) / (hi - lo)::double end as fx, case when lo is null then hy when hi is null or hi = lo then ly else ly + (hy - ly) * (f - lo) / (hi - lo)::double end as fy from fi),
se as (select seq_id, track_id, j, list(fx order by f) as xs, list(fy order by f) as ys, {rows} as m from ln group by all),
r as (
  select ln.*, xs, ys, m, case when f < {half} then 0 when f >= len(xs) - {half} then len(xs) - {window} else f - {half} end as a, case when f < {half} then f + 1 when f >= len(xs) - {half} then {window} - (len(xs) - f) + 1 else {half + 1} end as i
  from ln join se using (seq_id, track_id, j) where here),
o as (
  select seq_id, track_id, f as frame_idx, j, case when k < {window} then x else list_sum(list_transform(range(1, {window + 1}), lambda c: m[i][c] * xs[a + c])) end as x,
    case when k < {window} then y else list_sum(list_transform(range(1, {window + 1}), lambda c: m[i][c] * ys[a + c])) end as y, s from r)
select seq_id, track_id, frame_idx, j, {_r('x', 'y', 's')} from o"""


def _warped(frames: int = 30, band: int = 3) -> str:
    """Warping cell by cell: a step is the next cell of the band (``o`` from its left end), with the row before (``up``) and the one at hand (``row``); lags by all shifts."""
    wide, none = 2 * band + 1, "1e300::double"
    start = "[" + ", ".join("0.0" if k == band else "1e300" for k in range(wide)) + "]::double[]"
    return f"""{_HEAD.replace("with ", "with recursive ", 1)}, {_ANGLES}, {_TRUTH.strip()},
bo as (select an.seq_id, an.track_id, an.joint, an.frame_idx, an.angle, tr.truth, row_number() over (partition by an.seq_id, an.track_id, an.joint order by an.frame_idx desc) as back from an join tr on tr.seq_id = an.seq_id and tr.frame_idx = an.frame_idx and tr.joint = an.joint where angle is not null),
se as (select seq_id, track_id, joint, list(angle order by frame_idx) as a, list(truth order by frame_idx) as b, count(*) as n from bo where back <= {frames} group by all),
st(seq_id, track_id, joint, k, up, row) as (
  select seq_id, track_id, joint, 0::bigint, {start}, []::double[] from se
  union all
  select seq_id, track_id, joint, k + 1, case when o = {wide - 1} then list_append(row, c) else up end, case when o = {wide - 1} then []::double[] else list_append(row, c) end
  from (
    select *, case when j < 1 or j > n then {none} else abs(a[i] - b[j]) + least(case when o < {wide - 1} then up[o + 2] else {none} end, up[o + 1], case when o > 0 then row[o] else {none} end) end as c
    from (select st.*, se.a, se.b, se.n, st.k % {wide} as o, st.k // {wide} + 1 as i, st.k // {wide} + 1 - {band} + st.k % {wide} as j from st join se using (seq_id, track_id, joint) where st.k < se.n * {wide}))),
wc as (select st.seq_id, st.track_id, st.joint, up[{band + 1}] / se.n as shape_error from st join se using (seq_id, track_id, joint) where st.k = se.n * {wide}),
ce as (select *, list_transform(a, lambda v: v - list_avg(a)) as p, list_transform(b, lambda v: v - list_avg(b)) as q, list_aggregate(a, 'stddev_pop') = 0 or list_aggregate(b, 'stddev_pop') = 0 as flat from se),
la as (select seq_id, track_id, joint, flat, unnest(range(1 - n, n)) as lag, p, q, n from ce),
co as (select seq_id, track_id, joint, flat, lag, list_sum(list_transform(range(greatest(1, 1 - lag), least(n, n - lag) + 1), lambda t: p[t + lag] * q[t])) as v from la),
be as (select * from co qualify row_number() over (partition by seq_id, track_id, joint order by v desc, lag) = 1)
select seq_id, track_id, joint, {_r('shape_error')}, case when flat then 0 else lag end as timing_lag from wc join be using (seq_id, track_id, joint)"""


def _kept_bones(rounds: int = 28) -> str:
    """Bone after bone: a step moves both ends of the next one; at last the middle of the hips goes back."""
    moved = lambda c: f"list_transform(range(1, 18), lambda i: {c}[i] + case when i = p + 1 then m{c} when i = q + 1 then -m{c} else 0 end)"
    return f"""{_HEAD.replace("with ", "with recursive ", 1)}, b(p, q) as (values {_BONES}),
bl as (select a.seq_id, a.track_id, b.p, b.q, median(sqrt(power(a.x - c.x, 2) + power(a.y - c.y, 2))) as length from b join kp a on a.j = b.p join kp c on c.j = b.q and c.track_id = a.track_id and c.frame_idx = a.frame_idx group by all),
sp as (select seq_id, track_id, list({{p: p, q: q, length: length}} order by p, q) as bs from bl group by all),
po as (select seq_id, track_id, frame_idx, list(x order by j) as x, list(y order by j) as y, list(s order by j) as s from kp group by all),
st(seq_id, track_id, frame_idx, k, x, y) as (
  select seq_id, track_id, frame_idx, 0, x, y from po
  union all
  select seq_id, track_id, frame_idx, k + 1, {moved("x")}, {moved("y")}
  from (
    select *, dx * (1 - length / sqrt(dx * dx + dy * dy)) / 2 as mx, dy * (1 - length / sqrt(dx * dx + dy * dy)) / 2 as my
    from (select st.*, o.p, o.q, o.length, x[o.q + 1] - x[o.p + 1] as dx, y[o.q + 1] - y[o.p + 1] as dy
      from (select st.*, bs[k % len(bs) + 1] as o from st join sp using (seq_id, track_id) where k < {rounds} * len(bs)) st))),
en as (
  select e.seq_id, e.track_id, e.frame_idx, unnest(range(0, 17)) as j, e.x, e.y, po.x as x0, po.y as y0, po.s from (select * from st qualify k = max(k) over (partition by seq_id, track_id, frame_idx)) e join po using (seq_id, track_id, frame_idx)),
o as (
  select seq_id, track_id, frame_idx, j::int as j, x[j + 1] + (x0[12] + x0[13] - x[12] - x[13]) / 2 as x, y[j + 1] + (y0[12] + y0[13] - y[12] - y[13]) / 2 as y, s[j + 1] as s from en)
select seq_id, track_id, frame_idx, j, {_r('x', 'y', 's', places=3)} from o"""


def _one_euro() -> str:
    """The filter by recursion over each axis of a track's joint: last output (l), slope (d) and the frame of the last sure sample (t)."""
    rate = lambda c: f"(2 * pi() * {c} * dt / (2 * pi() * {c} * dt + 1))"
    return f"""with recursive {KEYPOINTS_SQL.strip()}, o as (
  select seq_id, track_id, frame_idx, j, a, v, s, row_number() over (partition by seq_id, track_id, j, a order by frame_idx) as k from (select *, 'x' as a, x as v from kp union all select *, 'y', y from kp)),
r(seq_id, track_id, j, a, k, frame_idx, l, d, t, out) as (
  select seq_id, track_id, j, a, k, frame_idx, case when s >= 0.3 then v end, 0.0::double, case when s >= 0.3 then frame_idx end, v from o where k = 1
  union all select seq_id, track_id, j, a, k, frame_idx, l3, d2, t2, coalesce(l3, v) from (
    select *, case when not sure then l when l is null then v else {rate('(1 + 0.7::double * abs(d2))')} * v + (1 - {rate('(1 + 0.7::double * abs(d2))')}) * l end as l3 from (
      select *, case when sure and l is not null then {rate('1')} * (v - l) / dt + (1 - {rate('1')}) * d else d end as d2 from (
        select o.seq_id, o.track_id, o.j, o.a, o.k, o.frame_idx, o.v, o.s >= 0.3 as sure, r.l, r.d, (o.frame_idx - r.t) / 30.0::double as dt, case when o.s >= 0.3 then o.frame_idx else r.t end as t2
        from r join o on o.seq_id = r.seq_id and o.track_id = r.track_id and o.j = r.j and o.a = r.a and o.k = r.k + 1)))),
w as (select seq_id, track_id, frame_idx, j, max(out) filter (a = 'x') as x, max(out) filter (a = 'y') as y from r group by all), q as (select w.*, kp.s from w join kp using (seq_id, track_id, frame_idx, j))
select seq_id, track_id, frame_idx, j, {_r('x', 'y', 's')} from q"""


#: Each reference box with the moved one that was made of it: at the sizes that the SQL is held against, no other matching of a frame is better.
_OWN = """
fo as (
  select seq_id, track_id as person, case when track_id % 5 = 0 and frame_idx >= 30 then track_id + 5000 else track_id end as id, frame_idx, x1 + 2 as x1, y1, x2 + 2 as x2, y2 from obs where (track_id + frame_idx) % 9 <> 0),
mo as (
  select o.seq_id, o.frame_idx, o.track_id as ref, f.id, greatest(0.0, least(o.x2, f.x2) - greatest(o.x1, f.x1)) * greatest(0.0, least(o.y2, f.y2) - greatest(o.y1, f.y1)) as inter, (o.x2 - o.x1) * (o.y2 - o.y1) + (f.x2 - f.x1) * (f.y2 - f.y1) as areas
  from obs o join fo f on f.seq_id = o.seq_id and f.frame_idx = o.frame_idx and f.person = o.track_id),
mt as (select *, inter / (areas - inter) as iou, lag(id) over w as before, frame_idx - lag(frame_idx) over w as gap from mo window w as (partition by seq_id, ref order by frame_idx)),
nr as (select seq_id, count(*) as n_ref from obs group by all),
nf as (select seq_id, count(*) as n_found from fo group by all)"""

ORACLE_SQL: dict[str, str] = {
    "nms": _nms(0.5, False),
    "diou_nms": _nms(0.4, True),
    "one_euro": _one_euro(),
    "kalman_filtered": _kalman(),
    "ground_truth_checks": "with " + OBS_SQL.strip() + f""",
t as (
  select seq_id, track_id, min(frame_idx) as f0, max(frame_idx) as f1, bool_or((x1 + x2) / 2 >= 240 and (y1 + y2) / 2 >= 168 and frame_idx < 120) as corner, bool_or(frame_idx < 10) as early from obs group by all),
e as (select seq_id, max(frame_idx) - 10 as bound from obs group by all),
f as (
  select seq_id, (select max(n) from (select count(*) as n from obs o where o.seq_id = t.seq_id group by frame_idx)) as most_at_once, count_if(early) as at_start, count_if(f1 > bound) as at_end, count(*) as n_unique, count_if(f0 >= 10) as late, count_if(corner) as in_corner,
    string_agg(track_id::varchar, ',' order by track_id) as ids, coalesce(string_agg(track_id::varchar, ',' order by track_id) filter (f0 >= 10), '') as late_ids, coalesce(string_agg(track_id::varchar, ',' order by track_id) filter (corner), '') as corner_ids from t join e using (seq_id) group by all),
u as (
  {" union all ".join(f"select seq_id, '{c}' as name, {c}::bigint as actual, {v}::bigint as expected, {c} {'<=' if c == 'most_at_once' else '='} {v} as ok, {dict(late='late_ids', in_corner='corner_ids').get(c, 'ids')} as ids from f" for c, v in {**EXPECTED, "in_corner": 0}.items())})
select seq_id, name, actual, expected, ok, case when ok then '' else ids end as ids from u""",
    "shape_and_timing": _warped(),
    "bones_kept": _kept_bones(),
    "lift_smoothing": _lift(),
    "clear_metrics": "with " + OBS_SQL.strip() + "," + _OWN + f""", c as (
  select seq_id, count(*) as tp, sum(iou) as s, count_if(before <> id)::bigint as id_switches, count_if(gap > 1)::bigint as fragments from mt group by all),
m as (
  select seq_id, tp, n_ref - tp as fn, n_found - tp as fp, id_switches, fragments, 1 - (n_ref - tp + n_found - tp + id_switches) / n_ref::double as mota, s / tp as motp, tp::double / n_ref as recall, tp::double / n_found as precision from c join nr using (seq_id) join nf using (seq_id))
select seq_id, tp, fn, fp, id_switches, fragments, {_r('mota', 'motp', 'recall', 'precision')} from m""",
    "identity_metrics": "with " + OBS_SQL.strip() + "," + _OWN + f""", k as (select seq_id, ref, id, count(*) as n from mt group by all),
b as (select seq_id, cast(sum(n) as bigint) as idtp from (select seq_id, ref, max(n) as n from k group by all) group by all),
m as (
  select seq_id, idtp, n_ref - idtp as idfn, n_found - idtp as idfp, 2 * idtp / (n_ref + n_found)::double as idf1, idtp / n_found::double as idp, idtp / n_ref::double as idr from b join nr using (seq_id) join nf using (seq_id))
select seq_id, idtp, idfn, idfp, {_r('idf1', 'idp', 'idr')} from m""",
    "hota_metrics": "with " + OBS_SQL.strip() + "," + _OWN + f""", al as (select k / 20.0::double as alpha from range(1, 20) r(k)),
sr as (select seq_id, track_id as ref, count(*) as n_r from obs group by all), si as (select seq_id, id, count(*) as n_i from fo group by all),
pr as (select seq_id, alpha, ref, id, n_r, n_i, count(*) as c from mt join al on iou >= alpha - 1e-12 join sr using (seq_id, ref) join si using (seq_id, id) group by all),
pa as (select seq_id, alpha, sum(c) as tp, sum(c * c / (n_r + n_i - c)::double) as a from pr group by all),
da as (
  select seq_id, coalesce(tp, 0) / (n_ref + n_found - coalesce(tp, 0))::double as det, coalesce(a / tp, 0) as ass from nr join nf using (seq_id) cross join al left join pa using (seq_id, alpha)),
m as (select seq_id, avg(sqrt(det * ass)) as hota, avg(det) as det_a, avg(ass) as ass_a from da group by all)
select seq_id, {_r('hota', 'det_a', 'ass_a')} from m""",
    "honesty": "with " + KEYPOINTS_SQL.strip() + f""", l as (select seq_id, (frame_idx + j) % 3 <> 0 as visible, case when j % 5 <> 0 then s end as score from kp),
h as (select seq_id, count(*) as n_labels, count(score) / count(*) as coverage, count_if(not visible and score >= 0.35) / nullif(count_if(not visible and score is not null), 0) as wrong, avg(power(score - visible::int, 2)) as brier from l group by all),
r as (select seq_id, n_labels, coverage, (1 - wrong) * coverage as visibility, (1 - brier) * coverage as calibration from h) select seq_id, n_labels, {_r('coverage', 'visibility', 'calibration')} from r""",
    "reemergence": "with " + OBS_SQL.strip() + "," + _FOUND + f""", e as (select seq_id, track_id, min(frame_idx) as f0, max(frame_idx) as f1 from obs group by all),
t as (select o.seq_id, o.track_id, o.frame_idx, case when (o.track_id + o.frame_idx) % 9 <> 0 then case when o.track_id % 5 = 0 and o.frame_idx >= 30 then o.track_id + 5000 else o.track_id end end as id from obs o),
m as (select e.seq_id, p.id as b, q.id as a from e join t p on p.seq_id = e.seq_id and p.track_id = e.track_id and p.frame_idx = f0 join t q on q.seq_id = e.seq_id and q.track_id = e.track_id and q.frame_idx = f1),
r as (select seq_id, count(*) as n_events, count_if(a is not null and b is not null)::bigint as resolvable, count_if(a = b)::bigint as matches, avg(case when a = b then 1.0 else 0.0 end) as accuracy from m group by all)
select seq_id, n_events, resolvable, matches, {_r('accuracy')} from r""",
    "benchmark_metrics": "with " + OBS_SQL.strip() + """, r as (select *, max(frame_idx) over (partition by seq_id) as last, min(frame_idx) over (partition by seq_id, track_id) as first from obs),
c as (select seq_id, max(n) as most_at_once from (select seq_id, frame_idx, count(*) as n from obs group by all) group by all)
select seq_id, count(distinct track_id) filter (frame_idx < 10) as at_start, count(distinct track_id) filter (frame_idx > last - 10) as at_end, count(distinct track_id) as n_unique,
  count(distinct track_id) filter (first >= 10) as late, any_value(most_at_once) as most_at_once from r join c using (seq_id) group by seq_id""",
}
