"""Queries of formats, box and joint geometry, and motion, and the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.functions import geometry as g
from kinetra.operators import camera, motion, pose
from kinetra.plans.pose_queries import _ANGLES, _HEAD, _TRUTH, _WIDE
from kinetra.plans.rounding import half_up_sql, rounded
from kinetra.plans.rounding import rounded_sql as _r
from kinetra.plans.track_queries import _G
from kinetra.sources import mot
from kinetra.sources.derived import FRAMES, OBS_SQL, keypoints, obs

WIDTH, HEIGHT = 400.0, 300.0
QUATERNION = (0.5, -0.5, 0.5, 0.5)
CORNERS = "[[0.1, 0.2], [0.9, 0.2], [0.5, 0.95]]"


def _mot_lines(spark: SparkSession, sf: str) -> DataFrame:
    """MOT lines of all sequences, with broken ones between."""
    lines = mot.mot_text(obs(spark, sf)).select("seq_id", F.col("line").alias("value"))
    return lines.union(lines.select("seq_id", F.explode(F.array(F.lit(""), F.lit("1,2,x,4,5,6"), F.lit("frame,id"))).alias("value")))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf).select("seq_id", "track_id", "frame_idx", *motion.BOX, (F.col("track_id") % 3).alias("class"), F.col("conf").alias("visibility"))
    return mot.detector_labels(o, WIDTH, HEIGHT)


def _annotations(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf).withColumn("image", F.concat_ws("-", "seq_id", "frame_idx"))
    box = F.struct(F.when(F.col("track_id") % 4 != 0, "person").otherwise("mask").alias("tag"), F.array(F.col("x1"), F.col("y1"), g.width(), g.height() - F.when(F.col("track_id") % 5 == 0, 500).otherwise(0)).alias("fbox"))
    lines = o.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("track_id", box.alias("b")))).alias("l"))
    lines = lines.select("image", F.to_json(F.struct(F.col("image").alias("ID"), F.transform("l", lambda x: x["b"]).alias("gtboxes"))).alias("value"))
    return mot.annotation_labels(lines, lines.select("image", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")))


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    o = g.with_previous(obs(spark, sf))
    padded, smart = g.padded(WIDTH, HEIGHT, 0.15), g.smart(WIDTH, HEIGHT)
    columns = [v.alias(f"{p}_{c}") for p, made in (("pad", padded), ("smart", smart)) for v, c in zip(made, motion.BOX, strict=True)]
    return o.select("seq_id", "track_id", "frame_idx", *columns, *[v.alias(n) for v, n in zip(g.centred(WIDTH, HEIGHT), ("ncx", "ncy", "nw", "nh"), strict=True)])


def _pair_measures(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (obs(spark, sf).select("seq_id", "frame_idx", F.col("track_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in motion.BOX]) for s in "ab")
    p = a.join(b, ["seq_id", "frame_idx"]).where("a < b")
    return p.select("seq_id", "frame_idx", "a", "b", g.iou_padded("a_", "b_").alias("iou_padded"), g.iou_floored("a_", "b_").alias("iou_floored"), g.edge_distance("a_", "b_").alias("edge_distance"))


def _intrinsics(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    k = mot.intrinsics(F.col("p_size") - 10.0, F.lit(1920.0), F.lit(1080.0))
    fps = mot.clamped_fps(F.col("p_retailprice") - 1000.0)
    return p.select("p_partkey", k.alias("k"), fps.alias("fps")).select("p_partkey", "k.fx", "k.fy", "k.fov", "fps")


def _joints(poses: DataFrame, array: str = "kp", *axes: str) -> DataFrame:
    return poses.select(*pose.POSE, F.posexplode(array).alias("j", "k")).select(*pose.POSE, "j", *[F.col(f"k.{c}").alias(c) for c in axes or ("x", "y")])


def _poses(spark: SparkSession, sf: str) -> DataFrame:
    return pose.wide(keypoints(spark, sf))


def _world(spark: SparkSession, sf: str) -> DataFrame:
    kp, cam = keypoints(spark, sf), camera.pinhole(WIDTH, HEIGHT, 70.0)
    x, y, z = camera.unprojected(F.col("x"), F.col("y"), 1 + F.col("s"), cam)
    return kp.select(*pose.POSE, "j", *[v.alias(n) for v, n in zip(camera.rotated(QUATERNION, x, y, z), "xyz", strict=True)])


def _angles_3d(spark: SparkSession, sf: str) -> DataFrame:
    rows = _world(spark, sf).groupBy(*pose.POSE).agg(F.sort_array(F.collect_list(F.struct("j", "x", "y", "z"))).alias("kp"))
    place = lambda j: tuple((F.col("kp")[j[0]][c] + F.col("kp")[j[1]][c]) / 2 if isinstance(j, tuple) else F.col("kp")[j][c] for c in "xyz")
    each = [F.struct(F.lit(n).alias("joint"), camera.angle_3d(*map(place, ends)).alias("angle")) for n, ends in pose.ANGLES.items()]
    return rows.select(*pose.POSE, F.explode(F.array(*each)).alias("r")).select(*pose.POSE, "r.joint", "r.angle")


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    c = motion.consistent(keypoints(spark, sf))
    level = motion.confidence_class(F.col("s"), F.col("consistent"), F.when(F.col("j") > 3, F.col("j") % 4 != 0))
    return c.select(*pose.POSE, "j", "consistent", level.alias("level"))


def _colours(spark: SparkSession, sf: str) -> DataFrame:
    a = pose.joint_angles(keypoints(spark, sf))
    d = pose.deviations(a, pose.consensus(a), 60.0)
    colour = motion.sync_colour(F.col("deviation"), F.when(F.col("frame_idx") % 2 == 0, F.col("deviation") / 2), (F.col("frame_idx") % 5).cast("double"), F.col("joint").endswith("shoulder"))
    return d.select(*pose.POSE, "joint", colour.alias("colour"))


def _polygon(spark: SparkSession, sf: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, CORNERS).otherwise("[[0, 1], [1, 1]]").alias("t"))
    return texts.select("r_regionkey", F.posexplode(mot.polygon(F.col("t"), WIDTH, HEIGHT)).alias("k", "c")).select("r_regionkey", "k", "c.x", "c.y")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "mot_parsed": lambda s, d: rounded(mot.parse_mot(_mot_lines(s, d), "seq_id").drop("class", "visibility"), 4),
    "mot_sequence_info": lambda s, d: mot.sequence_info(_mot_lines(s, d)),
    "frames_json": lambda s, d: rounded(mot.parse_frames_json(mot.frames_json(obs(s, d), FRAMES), "seq_id")),
    "frames_json_counts": lambda s, d: mot.frames_json(obs(s, d), FRAMES).select("seq_id", "frame_idx", F.size(F.json_object_keys(F.get_json_object("value", "$.tracks"))).alias("n")),
    "detector_labels": _labels,
    "annotation_labels": _annotations,
    "camera_intrinsics": lambda s, d: rounded(_intrinsics(s, d)),
    "stage_polygon": lambda s, d: rounded(_polygon(s, d)),
    "expanded_boxes": lambda s, d: rounded(_boxes(s, d)),
    "pair_measures": lambda s, d: rounded(_pair_measures(s, d)),
    "gap_fill_smooth": lambda s, d: rounded(motion.fill_gaps_gsi(obs(s, d), 10)),
    "dense_keypoints": lambda s, d: rounded(motion.dense_keypoints(keypoints(s, d).withColumn("frame_idx", 2 * F.col("frame_idx")), 80)),
    "pose_jerk": lambda s, d: rounded(motion.jerk(keypoints(s, d))),
    "group_sync": lambda s, d: rounded(motion.group_sync(keypoints(s, d))),
    "sanitised_poses": lambda s, d: rounded(motion.sanitised(keypoints(s, d).withColumn("x", F.col("x") - 380).withColumn("y", F.col("y") - 140), obs(s, d))),
    "joint_confidence": _classes,
    "sync_colours": _colours,
    "poses_per_person": lambda s, d: rounded(_joints(camera.per_person(_poses(s, d)))),
    "poses_mirrored": lambda s, d: rounded(_joints(camera.mirrored(_poses(s, d)), "kp", "x", "y", "s")),
    "poses_with_pelvis": lambda s, d: rounded(_joints(camera.with_pelvis(_poses(s, d)), "h")),
    "poses_from_pelvis": lambda s, d: rounded(_joints(camera.with_pelvis(_poses(s, d)).withColumn("kp", camera.from_pelvis("h", "xy")))),
    "joints_in_world": lambda s, d: rounded(_world(s, d)),
    "joint_angles_3d": lambda s, d: rounded(_angles_3d(s, d)),
}

_O = "with " + OBS_SQL.strip()
_LABEL = "'0 ' || " + " || ' ' || ".join(f"round(round(greatest(0.0, least(1.0, {v})), 9)::decimal(20, 9), 6)::decimal(20, 6)" for v in ("(x + w / 2) / 400", "(y + h / 2) / 300", "w / 400", "h / 300"))
_POSE = "seq_id, track_id, frame_idx"


def _at(j: int, c: str) -> str:
    return f"k[{j + 1}].{c}"


def _mean(joints: tuple[int, ...], c: str) -> str:
    return "((" + " + ".join(_at(j, c) for j in joints) + f") / {len(joints)})"


def _pelvis() -> list[tuple[str, str]]:
    xy = {h: [_at(j, "x"), _at(j, "y")] for h, j in zip(camera.PELVIS_AT, camera.PELVIS_FROM, strict=True)}
    sx, sy, hx, hy, eyes = _mean((5, 6), "x"), _mean((5, 6), "y"), _mean((11, 12), "x"), _mean((11, 12), "y"), f"({_at(1, 'y')} + {_at(2, 'y')})"
    nx, ny = _at(0, "x"), _at(0, "y")
    xy[10] = [_mean((1, 2, 3, 4), "x"), f"({eyes} - {ny})"]
    xy[8] = [f"({sx} + ({nx} - {sx}) / 3)", f"({sy} + ({ny} - {sy}) / 3 - ({eyes} / 2 - {ny}) * 2 / 3)"]
    xy[0] = [hx, hy]
    middle = _mean((5, 6, 11, 12), "x")
    xy[7] = [f"({middle} + 2 * ({middle} - ({hx} + {xy[8][0]}) / 2))", _mean((5, 6, 11, 12), "y")]
    xy[9] = [f"({nx} - ({nx} - {sx}) / 4)", f"({ny} - ({ny} - {sy}) / 4)"]
    return [(x, y) for _, (x, y) in sorted(xy.items())]


def _listed(joints: list[tuple[str, ...]], axes: str = "xy") -> str:
    """Rows of joints from SQL expressions over a pose's array."""
    rows = " union all ".join(f"select {_POSE}, {j} as j, {', '.join(f'{v} as {c}' for v, c in zip(e, axes, strict=True))} from wide" for j, e in enumerate(joints))
    return f"{_HEAD}, {_WIDE}, l as ({rows}) select {_POSE}, j, {_r(*axes)} from l"


def _from_pelvis() -> list[tuple[str, str]]:
    h, of = _pelvis(), {j: at for at, j in zip(camera.PELVIS_AT, camera.PELVIS_FROM, strict=True)}
    return [tuple(f"(0.65 * {h[9][c]} + 0.35 * {h[10][c]})" if 1 <= j <= 4 else h[of[j]][c] for c in (0, 1)) for j in range(17)]


_SWAP = dict(zip(camera.LEFT + camera.RIGHT, camera.RIGHT + camera.LEFT, strict=True))
_TURN = """wd as (
  with u as (select *, (x - 200) * (1 + s) / f as a, (y - 150) * (1 + s) / f as b, 1 + s as c from kp, (select 0.5 * 400 / tan(radians(70.0) / 2) as f)),
  v as (select *, 0.5 * c - 0.5 * b as ox, 0.5 * a + 0.5 * c as oy, -0.5 * b - 0.5 * a as oz from u)
  select seq_id, track_id, frame_idx, j, a + 2 * (0.5 * ox + 0.5 * oz - 0.5 * oy) as x, b + 2 * (0.5 * oy + 0.5 * ox + 0.5 * oz) as y, c + 2 * (0.5 * oz - 0.5 * oy - 0.5 * ox) as z from v)"""


def _angle_3d(name: str, ends: tuple) -> str:
    place = lambda j, c: f"((k[{j[0] + 1}].{c} + k[{j[1] + 1}].{c}) / 2)" if isinstance(j, tuple) else f"k[{j + 1}].{c}"
    u, v = ([f"({place(e, c)} - {place(ends[1], c)})" for c in "xyz"] for e in (ends[0], ends[2]))
    size = lambda w: "sqrt(" + " + ".join(f"{c} * {c}" for c in w) + ")"
    dot = " + ".join(f"{a} * {b}" for a, b in zip(u, v, strict=True))
    return f"select {_POSE}, '{name}' as joint, case when {size(u)} >= 1e-6 and {size(v)} >= 1e-6 then degrees(acos(greatest(-1.0, least(1.0, ({dot}) / ({size(u)} * {size(v)}))))) end as angle from w3"


_GRADIENT = "case when lag({c}) over w is null then lead({c}) over w - {c} when lead({c}) over w is null then {c} - lag({c}) over w else (lead({c}) over w - lag({c}) over w) / 2 end as {c}"


def _jerk() -> str:
    steps = ["kp", "d1", "d2", "d3"]
    made = ", ".join(
        f"{b} as (select {_POSE}, j, {_GRADIENT.format(c='x')}, {_GRADIENT.format(c='y')} from {a} window w as (partition by seq_id, track_id, j order by frame_idx))" for a, b in zip(steps, steps[1:], strict=False)
    )
    return f"{_HEAD}, {made}, p as (select {_POSE}, avg(sqrt(x * x + y * y)) as m from d3 group by all), q as (select {_POSE}, sum(m) over (partition by seq_id, track_id order by frame_idx rows between 2 preceding and 2 following) / 5 as jerk from p) select {_POSE}, {_r('jerk')} from q"


_GSI = "exp(-0.5 * power({} / 0.35::double, 2))"
_FAR = _GSI.format("1.0::double")

ORACLE_SQL: dict[str, str] = {
    "mot_parsed": f"""{_O}, p as (select seq_id, track_id, frame_idx, {', '.join(f'round(({v})::decimal(20, 6), 2)::double as {n}' for v, n in (('x1', 'x'), ('y1', 'y'), ('x2 - x1', 'w'), ('y2 - y1', 'h')))}, round(conf::decimal(20, 8), 4)::double as conf from obs),
c as (select seq_id, track_id, frame_idx, x as x1, y as y1, x + w as x2, y + h as y2, conf from p) select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'conf', places=4)} from c""",
    "mot_sequence_info": f"{_O} select max(frame_idx) + 1 as frames, max(track_id) as max_id from obs",
    "frames_json": f"{_O} select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'conf')} from obs",
    "frames_json_counts": f"""{_O}, s as (select distinct seq_id from obs), p as (select seq_id, f.frame_idx::bigint as frame_idx from s, range(0, 60) as f(frame_idx)), c as (select seq_id, frame_idx, count(*) as n from obs group by all)
select p.seq_id, p.frame_idx, coalesce(n, 0)::int as n from p left join c using (seq_id, frame_idx)""",
    "detector_labels": f"{_O}, v as (select *, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h from obs where track_id % 3 = 1 and conf >= 0.1) select seq_id, frame_idx, track_id, {_LABEL} as label from v",
    "annotation_labels": f"""{_O}, v as (select seq_id || '-' || frame_idx as image, row_number() over (partition by seq_id, frame_idx order by track_id) - 1 as place, track_id, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 - case when track_id % 5 = 0 then 500 else 0 end as h from obs)
select image, place::int as place, {_LABEL} as label from v where track_id % 4 <> 0 and w > 0 and h > 0""",
    "camera_intrinsics": f"""with k as (select p_partkey, case when p_size > 10 then 0.5 * 1920 / (36.0 / (2 * (p_size - 10.0::double))) end as fx, case when p_size > 10 then 2 * atan(36.0 / (2 * (p_size - 10.0::double))) end as a, p_retailprice - 1000 as f from part),
r as (select p_partkey, fx, fx * 1080 / 1920 as fy, degrees(a) as fov, case when f > 1e-3 and f <= 480 then f else 30.0 end as fps from k) select p_partkey, {_r('fx', 'fy', 'fov', 'fps')} from r""",
    "stage_polygon": f"""with c(k, a, b) as (values (0, 0.1, 0.2), (1, 0.9, 0.2), (2, 0.5, 0.95)), p as (select r_regionkey, k, a::double * 400 as x, b::double * 300 as y from region, c where r_regionkey % 2 = 0) select r_regionkey, k, {_r('x', 'y')} from p""",
    "expanded_boxes": f"""{_O},{_G}, b as (
  select *, cx - lag(cx) over o as dx, cy - lag(cy) over o as dy, greatest(w, 1.0) as mw, greatest(h, 1.0) as mh from g window o as (partition by seq_id, track_id order by frame_idx)),
s1 as (select *, x1 - case when dx < -6 then 0.2 * mw else 0 end as sx1, y1 - case when dy < -5 and abs(dx) < 5 then 0.4 * mh else 0 end as sy1, x2 + case when dx > 6 then 0.2 * mw else 0 end as sx2, y2 as sy2 from b),
s2 as (select *, greatest(1.0, sx2 - sx1) as aw, greatest(1.0, sy2 - sy1) as ah from s1),
s3 as (select *, case when aw / ah > 0.5 + 1e-3 then greatest(0.0, aw / 0.5 - ah) / 2 else 0 end as ey, case when aw / ah < 0.5 - 1e-3 then greatest(0.0, ah * 0.5 - aw) / 2 else 0 end as ex from s2),
s4 as (select *, sx1 - ex as tx1, sx2 + ex as tx2, sy1 - ey as ty1, sy2 + ey as ty2 from s3),
s5 as (select *, 0.12 * greatest(1.0, tx2 - tx1) as pw, 0.12 * greatest(1.0, ty2 - ty1) as ph from s4),
s6 as (select *, greatest(0.0, least(399.0, tx1 - pw)) as smart_x1, greatest(0.0, least(299.0, ty1 - ph)) as smart_y1 from s5),
r as (
  select seq_id, track_id, frame_idx, greatest(0.0, x1 - 0.15 * w) as pad_x1, greatest(0.0, y1 - 0.15 * h) as pad_y1, least(400.0, x2 + 0.15 * w) as pad_x2, least(300.0, y2 + 0.15 * h) as pad_y2, smart_x1, smart_y1,
    greatest(smart_x1 + 1, least(400.0, tx2 + pw)) as smart_x2, greatest(smart_y1 + 1, least(300.0, ty2 + ph)) as smart_y2, cx / 400 as ncx, cy / 300 as ncy, w / 400 as nw, h / 300 as nh from s6)
select seq_id, track_id, frame_idx, {_r(*[f'{p}_{c}' for p in ('pad', 'smart') for c in motion.BOX], 'ncx', 'ncy', 'nw', 'nh')} from r""",
    "pair_measures": f"""{_O},{_G}, p as (select a.seq_id, a.frame_idx, a.track_id as a, b.track_id as b, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i, a.w * a.h + b.w * b.h as areas,
  greatest(0.0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) as dx, greatest(0.0, greatest(a.y1, b.y1) - least(a.y2, b.y2)) as dy from g a join g b on a.seq_id = b.seq_id and a.frame_idx = b.frame_idx and a.track_id < b.track_id),
r as (select seq_id, frame_idx, a, b, i / (areas - i + 1e-9) as iou_padded, i / greatest(areas - i, 1e-6) as iou_floored, sqrt(dx * dx + dy * dy) as edge_distance from p) select seq_id, frame_idx, a, b, {_r('iou_padded', 'iou_floored', 'edge_distance')} from r""",
    "gap_fill_smooth": f"""{_O}, l as (select *, lead(columns('frame_idx|x1|y1|x2|y2')) over (partition by seq_id, track_id order by frame_idx) as 'n_\\0' from obs),
f as (select *, unnest(range(frame_idx + 1, n_frame_idx)) as f from l where n_frame_idx - frame_idx between 2 and 10),
k as (select *, {_GSI.format('((f - frame_idx) / (n_frame_idx - frame_idx))')} as k0, {_GSI.format('((f - frame_idx) / (n_frame_idx - frame_idx) - 1)')} as k1 from f),
w as (select *, (k0 * (1 + 1e-6) - k1 * {_FAR}) / (power(1 + 1e-6, 2) - power({_FAR}, 2)) as wa, (k1 * (1 + 1e-6) - k0 * {_FAR}) / (power(1 + 1e-6, 2) - power({_FAR}, 2)) as wb from k),
o as (select seq_id, track_id, f as frame_idx, {', '.join(f'wa * {c} + wb * n_{c} as {c}' for c in motion.BOX)}, 0.5::double as conf from w) select seq_id, track_id, frame_idx, {_r(*motion.BOX, 'conf')} from o""",
    "dense_keypoints": f"""{_HEAD}, t as (select * replace (2 * frame_idx as frame_idx) from kp), b as (select seq_id, track_id, j, least(0, min(frame_idx)) as f0, greatest(79, max(frame_idx)) as f1 from t group by all),
s as (select seq_id, track_id, j, unnest(range(f0, f1 + 1))::bigint as f from b), lo as (select s.*, t.frame_idx as fa, t.x as xa, t.y as ya, t.s as sa from s asof left join t on s.seq_id = t.seq_id and s.track_id = t.track_id and s.j = t.j and s.f >= t.frame_idx),
hi as (select lo.*, t.frame_idx as fb, t.x as xb, t.y as yb from lo asof left join t on lo.seq_id = t.seq_id and lo.track_id = t.track_id and lo.j = t.j and lo.f <= t.frame_idx),
o as (select seq_id, track_id, f as frame_idx, j, case when fa is null then xb when fb is null or fa = fb then xa else xa + (f - fa) / (fb - fa) * (xb - xa) end as x, case when fa is null then yb when fb is null or fa = fb then ya else ya + (f - fa) / (fb - fa) * (yb - ya) end as y,
  case when fa = f then sa else 0.0 end as s from hi) select seq_id, track_id, frame_idx, j, {_r('x', 'y', 's')} from o""",
    "pose_jerk": _jerk(),
    "group_sync": f"""{_HEAD}, d as (select {_POSE}, case when count(*) over w >= 2 then sqrt(power(x - avg(x) over w, 2) + power(y - avg(y) over w, 2)) else 0 end as d from kp window w as (partition by seq_id, frame_idx, j)),
m as (select {_POSE}, avg(d) as deviation from d group by all) select {_POSE}, {_r('deviation')} from m""",
    "sanitised_poses": f"""{_HEAD}, {OBS_SQL.strip()}, r as (select kp.* replace (x - 380 as x, y - 140 as y), (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) as dg from kp join obs using (seq_id, track_id, frame_idx)),
o as (select *, dg >= 1 and s >= 0.1 and sqrt(power(x - cx, 2) + power(y - cy, 2)) > 0.6 * dg as far from r), h as (select *, max(far and j < 5) over (partition by seq_id, track_id, frame_idx) as head from o),
q as (select {_POSE}, j, x, y, case when far then 0.0 else s end as s from h where not head) select {_POSE}, j, {_r('x', 'y', 's')} from q""",
    "joint_confidence": f"""{_HEAD}, c as (select {_POSE}, j, s, count(*) over w < 2 or (abs(x - avg(x) over w) < 2 * (stddev_pop(x) over w + 1e-6) and abs(y - avg(y) over w) < 2 * (stddev_pop(y) over w + 1e-6)) as consistent, case when j > 3 then j % 4 <> 0 else true end as inside
  from kp window w as (partition by seq_id, track_id, j order by frame_idx rows between 4 preceding and current row)),
l as (select *, case when s < 0.10 then 'NOT_VISIBLE' when s >= 0.7 and inside and consistent then 'HIGH' when s >= 0.4 and (inside or consistent) then 'MEDIUM' else 'LOW' end as level from c)
select {_POSE}, j, consistent, case when not inside and level in ('HIGH', 'MEDIUM') then 'LOW' else level end as level from l""",
    "sync_colours": f"""{_HEAD}, {_ANGLES}, {_TRUTH}, v as (select *, case when frame_idx % 2 = 0 then deviation / 2 else deviation end as v, joint like '%shoulder' as sp from dv)
select {_POSE}, joint, case when deviation is null then 'occluded' when v < case when sp then 10 else 20 end then case when frame_idx % 5 <= 2 then 'in_sync' else 'off_beat' end when v < case when sp then 20 else 35 end then 'slightly_off' else 'major_error' end as colour from v""",
    "poses_per_person": f"""{_HEAD}, b as (select {_POSE}, avg(x) filter (j in (11, 12)) as cx, avg(y) filter (j in (11, 12)) as cy, greatest(greatest(max(x) - min(x), max(y) - min(y)) * 1.2, 1.0) as sc from kp group by all),
n as (select {_POSE}, j, (x - cx) / sc * 2 as x, (y - cy) / sc * 2 as y from kp join b using (seq_id, track_id, frame_idx)) select {_POSE}, j, {_r('x', 'y')} from n""",
    "poses_mirrored": _listed([(f"-{_at(_SWAP.get(j, j), 'x')}", _at(_SWAP.get(j, j), "y"), _at(_SWAP.get(j, j), "s")) for j in range(17)], "xys"),
    "poses_with_pelvis": _listed(_pelvis()),
    "poses_from_pelvis": _listed(_from_pelvis()),
    "joints_in_world": f"{_HEAD}, {_TURN} select {_POSE}, j, {_r('x', 'y', 'z')} from wd",
    "joint_angles_3d": f"{_HEAD}, {_TURN}, w3 as (select {_POSE}, list({{x: x, y: y, z: z, j: j}} order by j) as k from wd group by all), a3 as ({' union all '.join(_angle_3d(n, e) for n, e in pose.ANGLES.items())}) select {_POSE}, joint, {half_up_sql('angle', 5)} as angle from a3",
}
