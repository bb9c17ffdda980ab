"""Queries on the derived observations, and the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetra.operators import graph, pairs, prune, relink, tracks
from kinetra.plans.rounding import rounded
from kinetra.plans.rounding import rounded_sql as _r
from kinetra.sources.derived import FRAMES, OBS_SQL, obs

WIDE, TALL = 320.0, 320.0
FRAME = prune.Frame(WIDE, TALL, FRAMES)
#: The same picture in a video twice as long, so that tracks are short in it.
LONG = prune.Frame(WIDE, TALL, 2 * FRAMES)
STAGE = [(20.0, 100.0), (300.0, 100.0), (330.0, 262.0), (10.0, 262.0)]

_G = """
g as (select *, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, x2 - x1 as w, y2 - y1 as h from obs)
"""
_PAIRS = """
pr0 as (
  select a.seq_id, a.frame_idx, a.track_id as a, b.track_id as b, a.cx as acx, a.cy as acy, b.cx as bcx, b.cy as bcy, a.w * a.h as aa, b.w * b.h as ba,
    greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter,
    power(greatest(a.x2, b.x2) - least(a.x1, b.x1), 2) + power(greatest(a.y2, b.y2) - least(a.y1, b.y1), 2) as far
  from g a join g b on a.seq_id = b.seq_id and a.frame_idx = b.frame_idx and a.track_id < b.track_id),
pr as (
  select *, inter / nullif(aa + ba - inter, 0) as iou, sqrt(power(acx - bcx, 2) + power(acy - bcy, 2)) as dist from pr0)
"""
_ENDS_ONLY = """
tl as (select *, row_number() over (partition by seq_id, track_id order by frame_idx desc) as back from (select *, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy from obs)),
e0 as (
  select seq_id, track_id, count(*) as n, min(frame_idx) as f0, max(frame_idx) as f1, min_by({x1: x1, y1: y1, x2: x2, y2: y2}, frame_idx) as b0, max_by({x1: x1, y1: y1, x2: x2, y2: y2}, frame_idx) as b1,
    min(frame_idx) filter (back <= 5) as f5, min(frame_idx) filter (back <= 2) as f2, max_by(cx, frame_idx) as cx1, max_by(cy, frame_idx) as cy1,
    min_by(cx, frame_idx) filter (back <= 5) as x5, min_by(cy, frame_idx) filter (back <= 5) as y5, min_by(cx, frame_idx) filter (back <= 2) as x2, min_by(cy, frame_idx) filter (back <= 2) as y2 from tl group by all),
e as (
  select seq_id, track_id, n, f0, f1, b0, b1, coalesce((cx1 - x5) / nullif(f1 - f5, 0), 0) as vx, coalesce((cy1 - y5) / nullif(f1 - f5, 0), 0) as vy,
    coalesce((cx1 - x2) / nullif(f1 - f2, 0), 0) as ux, coalesce((cy1 - y2) / nullif(f1 - f2, 0), 0) as uy from e0)
"""
_FOLLOW = """
fl0 as (
  select a.seq_id, a.track_id as a, b.track_id as b, b.f0 - a.f1 as gap, a.f1 as a_end, a.f0 as a_start, b.f0 as b_start, a.n as an, b.n as bn, a.vx as avx, a.vy as avy, b.vx as bvx, b.vy as bvy, a.ux, a.uy, a.b1 as p, b.b0 as q,
    a.b1.y2 - a.b1.y1 as ah, b.b0.y2 - b.b0.y1 as bh, (a.b1.x1 + a.b1.x2) / 2 as ax, (a.b1.y1 + a.b1.y2) / 2 as ay, (b.b0.x1 + b.b0.x2) / 2 as bx, (b.b0.y1 + b.b0.y2) / 2 as by_
  from e a join e b on a.seq_id = b.seq_id and a.track_id <> b.track_id and b.f0 > a.f1),
fl as (
  select *, sqrt(power(ax - bx, 2) + power(ay - by_, 2)) as dist, sqrt(power(bx - (ax + avx * gap), 2) + power(by_ - (ay + avy * gap), 2)) as missed,
    sqrt(power(bx - (ax + ux * gap), 2) + power(by_ - (ay + uy * gap), 2)) as missed2 from fl0)
"""
_ENDS = _ENDS_ONLY.rstrip() + "," + _FOLLOW
_MED = """
m as (
  select seq_id, track_id, median(cx) as mx, median(cy) as my, median(h) as mh, median(w) as mw, count(*) as n, median(y2) as feet,
    median(w / nullif(h, 0)) as wh, min(frame_idx) as f0, max(frame_idx) as f1, min_by(cx, frame_idx) as first_x from g group by all)
"""


def _cut(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where(F.col("frame_idx").between(first, last))


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    """Each track under a new id after a gap of more than three frames, so that there is something to relink; all rows stay."""
    own = Window.partitionBy("track_id").orderBy("frame_idx")
    again = (F.col("frame_idx") - F.lag("frame_idx").over(own) > 3).cast("long")
    return obs(spark, sf).withColumn("_again", F.coalesce(again, F.lit(0))).withColumn("track_id", F.col("track_id") * 100 + F.sum("_again").over(own)).drop("_again")


_BROKEN = OBS_SQL.replace("\nobs as (", "\nobs_whole as (") + """,
obs_gaps as (select *, coalesce(cast(frame_idx - lag(frame_idx) over (partition by track_id order by frame_idx) > 3 as int), 0) as again from obs_whole),
obs as (select * exclude (again) replace (cast(track_id * 100 + sum(again) over (partition by track_id order by frame_idx) as bigint) as track_id) from obs_gaps)
"""
_RULE = {"near": 0.05, "ahead": 0.1, "radius": 12.0, "short": 7, "ratio": 1.05, "speed": 0.02}


def sequence_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tracks.survival(obs(spark, sf), FRAMES))


def chain_rules() -> dict[str, prune.Rule]:
    return {
        "duration": prune.short_lived(),
        "stage": prune.outside_polygon(STAGE),
        "spatial": prune.spatial_outliers(FRAME, 1.5),
        "short": prune.short_share(FRAME, 0.5),
        "audience": prune.audience(FRAME),
        "late_span": prune.late_and_short(FRAME),
        "bbox_size": prune.size_outliers(FRAME, 0.97, 1.04),
        "aspect": prune.wide_boxes(0.492),
        "mirror": prune.mirrors(least=0.0),
    }


def _hits(rule: prune.Rule, frame: prune.Frame = FRAME, early: int = 120, edge: float = prune.MIRROR_EDGE, broken: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: prune.hits(prune.facts((_broken if broken else obs)(s, d), frame, early, edge), rule)


def prune_chain(spark: SparkSession, sf: str) -> DataFrame:
    rules = chain_rules()
    return prune.pruned(prune.facts(obs(spark, sf), FRAME), {k: rules[k] for k in ("duration", "stage", "spatial", "audience")})


def _back(spark: SparkSession, sf: str) -> DataFrame:
    """A backward pass over all frames with other ids; every fourth track is elsewhere, so that nothing forward overlaps it."""
    aside = F.when(F.col("track_id") % 4 == 0, 2000.0).otherwise(0.0)
    return obs(spark, sf).withColumns({"x1": F.col("x1") + aside, "x2": F.col("x2") + aside, "track_id": F.col("track_id") + 100000})


def _stitches(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.stitch_candidates(_broken(spark, sf), FRAMES, **_RULE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sequence_scores": sequence_scores,
    "observations": lambda s, d: rounded(obs(s, d)),
    "track_quality": lambda s, d: rounded(tracks.quality(obs(s, d))),
    "timeline_jumps": lambda s, d: tracks.jumps(obs(s, d)),
    "gap_fill": lambda s, d: rounded(tracks.fill_gaps(obs(s, d), 10), 9),
    "tail_velocity": lambda s, d: rounded(tracks.tail_velocity(obs(s, d))),
    "presence_islands": lambda s, d: tracks.presence_islands(obs(s, d)),
    "jerk": lambda s, d: rounded(tracks.smoothness(obs(s, d))),
    "mot_lines": lambda s, d: tracks.mot_lines(obs(s, d)),
    "frame_pivot": lambda s, d: tracks.per_frame(obs(s, d), FRAMES),
    "reverse_remap": lambda s, d: rounded(tracks.reverse(obs(s, d), FRAMES)),
    "swap_interval": lambda s, d: rounded(tracks.swap_interval(obs(s, d), 1, 2, 5, 20)),
    "track_lifecycle": lambda s, d: tracks.lifecycle(obs(s, d), FRAMES, 3),
    "state_gates": lambda s, d: tracks.gates(tracks.lifecycle(obs(s, d), FRAMES, 3)),
    "absences": lambda s, d: tracks.absences(tracks.lifecycle(obs(s, d), FRAMES, 3)),
    "tail_frames": lambda s, d: rounded(tracks.tail_frames(obs(s, d), 10)),
    "one_row_each": lambda s, d: rounded(tracks.one_each(obs(s, d).unionByName(obs(s, d).withColumn("conf", F.lit(0.5))))),
    "stitch_groups": lambda s, d: graph.groups(_stitches(s, d).select("seq_id", "a", "b")),
    "track_medians": lambda s, d: rounded(tracks.medians(obs(s, d))),
    "edge_share": lambda s, d: rounded(tracks.edge_share(obs(s, d), WIDE)),
    "frame_pairs": lambda s, d: rounded(pairs.frame_pairs(obs(s, d))),
    "overlap_runs": lambda s, d: pairs.overlap_runs(obs(s, d), 0.30, 3),
    "coalesced_tracks": lambda s, d: pairs.coalesced(obs(s, d), 0.30, 3),
    "overlap_clusters": lambda s, d: rounded(pairs.overlap_clusters(obs(s, d), 0.5)),
    "coexisting_fragments": lambda s, d: rounded(pairs.coexisting(obs(s, d))),
    "track_ends": lambda s, d: rounded(pairs.ends(_broken(s, d))),
    "stitch_candidates": lambda s, d: rounded(_stitches(s, d)),
    "dormant_candidates": lambda s, d: rounded(pairs.dormant_candidates(_broken(s, d), 5, 40)),
    "global_candidates": lambda s, d: rounded(pairs.global_candidates(_broken(s, d), 30, 0.01)),
    "best_link": lambda s, d: rounded(pairs.best_link(pairs.global_candidates(_broken(s, d), 30, 0.01))),
    "stitched_tracks": lambda s, d: rounded(relink.renamed(_broken(s, d), relink.stitched_ids(_broken(s, d), FRAMES, **_RULE), 60)),
    "dormant_tracks": lambda s, d: rounded(relink.renamed(_broken(s, d), relink.dormant_ids(_broken(s, d), least=3, most=40))),
    "merged_passes": lambda s, d: rounded(pairs.merged_passes(obs(s, d), _back(s, d))),
    "complementary_tracks": lambda s, d: rounded(pairs.complementary(_broken(s, d), 0.1, 0.25, 1.05)),
    "id_votes": lambda s, d: pairs.id_votes(obs(s, d), _back(s, d)),
    "merge_keep_first": lambda s, d: rounded(pairs.merge_keep_first(_cut(obs(s, d), 0, 30), _cut(obs(s, d), 20, 59).withColumn("conf", F.lit(0.5)))),
    "prune_stage": _hits(prune.outside_polygon(STAGE)),
    "prune_spatial": _hits(prune.spatial_outliers(FRAME, 1.5)),
    "prune_short": _hits(prune.short_share(LONG, 0.35), LONG),
    "prune_audience": _hits(prune.audience(prune.Frame(WIDE, 250.0, FRAMES))),
    "prune_late_span": _hits(prune.late_and_short(LONG), LONG, broken=True),
    "prune_bbox_size": _hits(prune.size_outliers(FRAME, 0.98, 1.02)),
    "prune_aspect": _hits(prune.wide_boxes(0.49)),
    "prune_mirror": _hits(prune.mirrors(0.3, 0.0), edge=0.3),
    "prune_chain": prune_chain,
    "prune_all_rules": lambda s, d: prune.pruned(prune.facts(obs(s, d), FRAME), chain_rules()),
    "prune_info": lambda s, d: rounded(prune.info(prune.facts(obs(s, d), FRAME), FRAME).withColumn("median_box", F.concat_ws(",", F.transform("median_box", lambda v: F.format_number(v, 1))))),
}

_SURVIVAL = """
sv0 as (
  select seq_id, track_id, count(*) as n_frames, min(frame_idx) as first_frame, max(frame_idx) - min(frame_idx) + 1 as span, sqrt(var_pop(cx) + var_pop(cy)) as movement_std,
    {total} - min(frame_idx) > 0 and count(*) >= greatest(least(30, {total} - min(frame_idx)), cast(floor(({total} - min(frame_idx)) * 0.2::double) as bigint) + 1) as lasts from g group by all),
sh as (select seq_id, median(h) as median_h from g join sv0 using (seq_id, track_id) where lasts and h > 0 group by seq_id),
sv as (select sv0.*, median_h, lasts and coalesce(movement_std >= 0.02::double * median_h, false) as survives from sv0 left join sh using (seq_id))
"""


def _facts(total: int = 60, early: int = 120, edge: float = 0.15) -> str:
    """Facts of each track (fa) with the group's statistics besides (see ``prune.facts``)."""
    return _SURVIVAL.format(total=total).strip() + f""",
f0 as (
  select *, row_number() over w as rn, count(*) over (partition by seq_id, track_id) as n, lag(cx) over w as bx, lag(frame_idx) over w as bf,
    case when cx <= {edge} * 320 or cx >= {1 - edge} * 320 then 1.0 else 0.0 end as at_edge,
    case when (cx <= 0.15 * 320 or cx >= 0.85 * 320) and (cy <= 0.2 * 320 or cy >= 0.8 * 320) then 1.0 else 0.0 end as at_corner
  from g window w as (partition by seq_id, track_id order by frame_idx)),
fa as (
  select seq_id, track_id, any_value(f0.n) as n, min(frame_idx) as f0, max(frame_idx) as f1, median(cx) as mx, median(cy) as my, median(y2) as feet, median(h) filter (h > 0) as mh, median(w) filter (w > 0) as mw,
    median(w / h) filter (h > 0) as wh, max(cx) filter (rn = 1) as first_x, max(cy) filter (rn = 1) as first_y, max(cx) filter (rn = least(f0.n, 15)) as later_x,
    median(cx) filter (rn <= greatest(1, f0.n // 4)) as early_x, median(cy) filter (rn <= greatest(1, f0.n // 4)) as early_y,
    median(cx) filter (rn > f0.n - greatest(1, f0.n // 4)) as late_x, median(cy) filter (rn > f0.n - greatest(1, f0.n // 4)) as late_y,
    median(cx) filter (frame_idx < {early}) as start_x, median(cy) filter (frame_idx < {early}) as start_y, avg((cx - bx) / (frame_idx - bf)) as vx,
    avg(at_edge) filter (bf is not null) as moving_edge, avg(at_edge) as edge, avg(at_corner) as corner, any_value(survives) as survives
  from f0 join sv using (seq_id, track_id) group by seq_id, track_id)"""


_GROUP = "count(*) over s as k, median(mx) over s as gx, median(my) over s as gy, greatest(stddev_pop(mx) over s, 16.0) as sx, greatest(stddev_pop(my) over s, 16.0) as sy, median(mh) over s as gh, median(vx) over s as gv"


def _rules_sql(start: str, steps: list[tuple[str, str]]) -> str:
    """A chain of rules over the facts in ``start``: each judges what the ones before have left (the last rest is c<number>)."""
    parts = []
    for i, (name, test) in enumerate(steps):
        before = start if i == 0 else f"c{i - 1}"
        parts.append(f"w{i} as (select *, {_GROUP} from {before} window s as (partition by seq_id))")
        parts.append(f"r{i} as (select '{name}' as rule, seq_id, track_id from w{i} where {test})")
        parts.append(f"c{i} as (select * exclude (k, gx, gy, sx, sy, gh, gv) from w{i} where not coalesce({test}, false))")
    return ", ".join(parts)


def _one_rule(test: str, facts: str, obs_sql: str = OBS_SQL) -> str:
    return _with(obs_sql, _G, facts, _rules_sql("fa", [("x", test)])) + " select seq_id, track_id from r0"


_INSIDE = " + ".join(
    f"case when ({ya} > feet) <> ({yb} > feet) and mx < ({xb}::double - {xa}) * (feet - {ya}) / ({yb}::double - {ya}) + {xa} then 1 else 0 end"
    for (xa, ya), (xb, yb) in zip(STAGE, STAGE[1:] + STAGE[:1], strict=True)
    if ya != yb
)
_AT_ENTRY = "(first_x <= 0.08 * 320 or first_x >= 320 - 0.08 * 320 or first_y <= 0.08 * 320 or first_y >= 320 - 0.08 * 320)"
_AWAY = "sqrt(power({0}_x - gx, 2) + power({0}_y - gy, 2))"
_TESTS = {
    "duration": "not survives",
    "stage": f"({_INSIDE}) % 2 = 0",
    "spatial": f"""k >= 3 and greatest(abs(mx - gx) / sx, abs(my - gy) / sy) > case when my >= 0.65 * 320 then 1.5 * 1.25 else 1.5 end
  and not (n >= 4 and {_AWAY.format('late')} < 0.7 * {_AWAY.format('early')})""",
    "short": f"""n < {{least}} and not ({_AT_ENTRY} and (f1 >= {{end}} or ({{total}} - f0 > 0 and n >= greatest(30, floor(({{total}} - f0) * {{share}}::double))
  and ((first_x <= 0.08 * 320 and later_x > first_x) or (first_x >= 320 - 0.08 * 320 and later_x < first_x)))))""",
    "audience": "start_x >= 0.75 * 320 and start_y >= 0.70 * {tall}",
    "late_span": f"f0 >= {{late}} and f1 - f0 + 1 < {{span}} and not {_AT_ENTRY}",
    "bbox_size": "k >= 3 and (mh / gh < {low} or mh / gh > case when my >= 0.65 * 320 then {high} * 1.25::double else {high} end)",
    "aspect": "k >= 3 and wh > {most}",
    "mirror": "k >= 2 and vx * gv < 0 and moving_edge >= 0.3",
}


def _half(value: str, places: int) -> str:
    return f"round({value}, {places})"


def _with(*parts: str) -> str:
    return "with " + ",".join(p.strip() for p in parts)


_CHAIN = [
    ("duration", _TESTS["duration"]), ("stage", _TESTS["stage"]), ("spatial", _TESTS["spatial"]), ("short", _TESTS["short"].format(least=30, end=57, total=60, share=0.5)),
    ("audience", _TESTS["audience"].format(tall=320)), ("late_span", _TESTS["late_span"].format(late=21, span=10)), ("bbox_size", _TESTS["bbox_size"].format(low=0.97, high=1.04)),
    ("aspect", _TESTS["aspect"].format(most=0.492)), ("mirror", _TESTS["mirror"]),
]


def _chain_sql(names: list[str]) -> str:
    steps = [x for x in _CHAIN if x[0] in names]
    return _with(OBS_SQL, _G, _facts(), _rules_sql("fa", steps)) + " " + " union all ".join(f"select * from r{i}" for i in range(len(steps)))


_LIFE = """
s as (select seq_id, track_id, unnest(range(min(frame_idx), 60)) as frame_idx from obs group by seq_id, track_id),
l as (select s.*, s.frame_idx - max(o.frame_idx) over (partition by s.seq_id, s.track_id order by s.frame_idx) as away from s left join obs o using (seq_id, track_id, frame_idx))
""".strip()
_STITCH = """
s as (
  select *, avx <> 0 or avy <> 0 as moves, gap <= 7 as soon, greatest(0.05::double * ah, 6.0) as last from fl where gap between 1 and 60 and a_end < 59),
s2 as (select *, case when moves then greatest(0.1::double * ah, 9.0) else last end as led, case when soon then greatest(ah, 12.0) else last end as at_last from s),
s3 as (
  select * from s2 where (s2.dist <= at_last or s2.missed <= case when soon then at_last else led end) and least(s2.dist, s2.missed) < greatest(last, led) + 1
    and greatest(ah, bh) / least(ah, bh) <= 1.05 and s2.dist / gap <= greatest(0.02::double * ah, 30.0)
    and not (not soon and moves and bn >= 3 and sqrt(avx * avx + avy * avy) > 1 and sqrt(bvx * bvx + bvy * bvy) > 1 and avx * bvx + avy * bvy < 0))
"""



def _merged_sql(links: str, order: str, fill: bool) -> str:
    """One merge for each sequence in a step: the first link by ``order`` of the tracks as they are; the last step has who ended up where.

    A step carries all tracks of the sequences that still merge.
    """
    line = "list_transform(range(greatest(q.f0 - 5, p.f1 + 1), q.f0), lambda f: {f: f, x: p.z.x + (q.tail0.x - p.z.x) * ((f - p.f1)::double / (q.f0 - p.f1)), y: p.z.y + (q.tail0.y - p.z.y) * ((f - p.f1)::double / (q.f0 - p.f1))})"
    tail = f"list_concat(list_concat(p.tail, {line}), q.tail)" if fill else "list_concat(p.tail, q.tail)"
    return "with recursive " + _BROKEN.strip() + f""",
tt as (
  select *, {{f: frame_idx, x: (x1 + x2) / 2, y: (y1 + y2) / 2}} as place, {{x1: x1, y1: y1, x2: x2, y2: y2}} as box, row_number() over (partition by seq_id, track_id order by frame_idx desc) as back from obs),
st(step, seq_id, id, n, f0, f1, b0, b1, tail, parts) as (
  select 0, seq_id, track_id, count(*), min(frame_idx), max(frame_idx), min_by(box, frame_idx), max_by(box, frame_idx), list(place order by frame_idx) filter (back <= 5), [track_id] from tt group by seq_id, track_id
  union all
  select * from (
    with sp as (
      select *, tail[-1] as z, tail[1] as y5, tail[greatest(len(tail) - 1, 1)] as y2, {{x: (b0.x1 + b0.x2) / 2, y: (b0.y1 + b0.y2) / 2}} as tail0 from st),
    e as (
      select *, id as track_id, coalesce((z.x - y5.x) / nullif(z.f - y5.f, 0), 0) as vx, coalesce((z.y - y5.y) / nullif(z.f - y5.f, 0), 0) as vy,
        coalesce((z.x - y2.x) / nullif(z.f - y2.f, 0), 0) as ux, coalesce((z.y - y2.y) / nullif(z.f - y2.f, 0), 0) as uy from sp),
    {_FOLLOW.strip()},
    {links},
    pick as (select seq_id, a, b from lk qualify row_number() over (partition by seq_id order by {order}) = 1)
    select p.step + 1, p.seq_id, p.id, case when q.id is null then p.n else p.n + q.n + {"q.f0 - p.f1 - 1" if fill else "0"} end, p.f0, coalesce(q.f1, p.f1), p.b0, coalesce(q.b1, p.b1),
      case when q.id is null then p.tail else list_slice({tail}, -5, -1) end, case when q.id is null then p.parts else list_concat(p.parts, q.parts) end
    from e p join pick on pick.seq_id = p.seq_id and pick.b <> p.id left join e q on pick.a = p.id and q.seq_id = p.seq_id and q.id = pick.b)),
ids as (
  select seq_id, id as merged_id, unnest(parts) as track_id from (select * from st qualify step = max(step) over (partition by seq_id))),
rn as (select o.* replace (merged_id as track_id) from obs o join ids using (seq_id, track_id))"""


_WAKES = """d as (
      select *, missed2 as far, greatest(0.0, least(p.x2 + ux * gap, q.x2) - greatest(p.x1 + ux * gap, q.x1)) * greatest(0.0, least(p.y2 + uy * gap, q.y2) - greatest(p.y1 + uy * gap, q.y1)) as shared_area,
        (p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) as areas, greatest(sqrt(power(q.x2 - q.x1, 2) + power(q.y2 - q.y1, 2)), 1.0) as diagonal from fl where gap between 5 and 41 and an >= 2),
    lk as (select * from d where far <= 2 * diagonal and shared_area / (areas - shared_area) >= 0.2)"""

ORACLE_SQL: dict[str, str] = {
    "sequence_scores": _with(OBS_SQL, _G, _SURVIVAL.format(total=60)) + f" select seq_id, track_id, n_frames, first_frame, span, {_r('movement_std')}, lasts, {_r('median_h')}, survives from sv",
    "observations": _with(OBS_SQL) + f" select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'conf')} from obs",
    "track_quality": _with(OBS_SQL) + f""", p as (select seq_id, track_id, count(*) as n from obs group by all),
q as (select seq_id, count(*) as n_tracks, sum(n)::bigint as n_obs, median(n) as median_len, quantile_cont(n, 0.1) as p10_len, quantile_cont(n, 0.9) as p90_len,
  min(n) as min_len, max(n) as max_len from p group by all)
select seq_id, n_tracks, n_obs, {_r('median_len', 'p10_len', 'p90_len')}, min_len, max_len from q""",
    "timeline_jumps": _with(OBS_SQL) + """, l as (select *, frame_idx - lag(frame_idx) over (partition by seq_id, track_id order by frame_idx) as gap from obs)
select seq_id, track_id, count_if(gap > 5)::bigint as n_jumps, max(gap) as longest_gap from l group by all""",
    "gap_fill": _with(OBS_SQL) + f""", l as (select *, lead(columns('frame_idx|x1|y1|x2|y2')) over (partition by seq_id, track_id order by frame_idx) as 'n_\\0' from obs),
f as (select seq_id, track_id, unnest(range(frame_idx + 1, n_frame_idx)) as f, * exclude (seq_id, track_id) from l where n_frame_idx - frame_idx between 2 and 10),
o as (select seq_id, track_id, f as frame_idx, x1 + (f - frame_idx) / (n_frame_idx - frame_idx) * (n_x1 - x1) as x1, y1 + (f - frame_idx) / (n_frame_idx - frame_idx) * (n_y1 - y1) as y1,
  x2 + (f - frame_idx) / (n_frame_idx - frame_idx) * (n_x2 - x2) as x2, y2 + (f - frame_idx) / (n_frame_idx - frame_idx) * (n_y2 - y2) as y2, 0.5::double as conf from f)
select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'conf', places=9)} from o""",
    "tail_velocity": _with(OBS_SQL, _G) + f""", t as (select * from g qualify row_number() over (partition by seq_id, track_id order by frame_idx desc) <= 5),
v as (select seq_id, track_id, (max_by(cx, frame_idx) - min_by(cx, frame_idx)) / nullif(max(frame_idx) - min(frame_idx), 0) as vx,
  (max_by(cy, frame_idx) - min_by(cy, frame_idx)) / nullif(max(frame_idx) - min(frame_idx), 0) as vy from t group by all)
select seq_id, track_id, {_r('vx', 'vy')} from v""",
    "presence_islands": _with(OBS_SQL) + """, r as (select *, frame_idx - row_number() over (partition by seq_id, track_id order by frame_idx) as run from obs)
select seq_id, track_id, min(frame_idx) as run_start, max(frame_idx) as run_end, count(*) as run_len from r group by seq_id, track_id, run""",
    "jerk": _with(OBS_SQL, _G) + f""", j as (select *, (lead(cx, 2) over w - 2 * lead(cx) over w + 2 * lag(cx) over w - lag(cx, 2) over w) / 2 as jerk from g window w as (partition by seq_id, track_id order by frame_idx)),
s as (select seq_id, track_id, avg(abs(jerk)) as mean_jerk, count(jerk) as n from j group by all) select seq_id, track_id, {_r('mean_jerk')}, n from s""",
    "mot_lines": _with(OBS_SQL) + """ select seq_id, frame_idx + 1 as frame, track_id as id, format('{:d},{:d},', frame_idx + 1, track_id) || concat_ws(',', round(x1::decimal(20, 6), 2)::decimal(20, 2), round(y1::decimal(20, 6), 2)::decimal(20, 2), round((x2 - x1)::decimal(20, 6), 2)::decimal(20, 2), round((y2 - y1)::decimal(20, 6), 2)::decimal(20, 2), round(conf::decimal(20, 8), 4)::decimal(20, 4), '1,1') as line from obs""",
    "frame_pivot": _with(OBS_SQL) + """, s as (select distinct seq_id from obs), p as (select seq_id, f.frame_idx from s, range(0, 60) as f(frame_idx)),
c as (select seq_id, frame_idx, count(*) as n, string_agg(track_id::varchar, ',' order by track_id) as ids from obs group by all)
select p.seq_id, p.frame_idx::bigint as frame_idx, coalesce(n, 0)::bigint as n_tracks, coalesce(ids, '') as track_ids from p left join c on p.seq_id = c.seq_id and p.frame_idx = c.frame_idx""",
    "reverse_remap": _with(OBS_SQL) + f" select seq_id, track_id, 59 - frame_idx as frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'conf')} from obs",
    "swap_interval": _with(OBS_SQL) + f" select seq_id, (case when frame_idx between 5 and 20 and track_id = 1 then 2 when frame_idx between 5 and 20 and track_id = 2 then 1 else track_id end)::bigint as track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'conf')} from obs",
    "track_lifecycle": _with(OBS_SQL) + """, s as (select seq_id, track_id, unnest(range(min(frame_idx), 60)) as frame_idx from obs group by seq_id, track_id),
l as (select s.*, s.frame_idx - max(o.frame_idx) over (partition by s.seq_id, s.track_id order by s.frame_idx) as away from s left join obs o using (seq_id, track_id, frame_idx))
select seq_id, track_id, frame_idx, case when away = 0 then 'ACTIVE' when away <= 3 then 'DORMANT' else 'LOST' end as state from l""",
    "state_gates": _with(OBS_SQL) + f", {_LIFE} select seq_id, track_id, frame_idx, away = 0 as run_pose, away = 0 as update_gallery, away = 0 as run_critique from l",
    "absences": _with(OBS_SQL) + f""", {_LIFE}, r as (select *, frame_idx - row_number() over (partition by seq_id, track_id order by frame_idx) as run from l where away > 0)
select seq_id, track_id, min(frame_idx) as gap_start, max(frame_idx) as gap_end, count(*) as gap_len, case when max(away) <= 3 then 'DORMANT' else 'LOST' end as state from r group by seq_id, track_id, run""",
    "tail_frames": _with(OBS_SQL) + f", m as (select seq_id, max(frame_idx) as last from obs group by all) select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'conf')} from obs join m using (seq_id) where frame_idx > last - 10",
    "one_row_each": _with(OBS_SQL) + f", m as (select * replace (greatest(conf, 0.5) as conf) from obs) select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'conf')} from m",
    "stitch_groups": "with recursive " + ",".join(p.strip() for p in (_BROKEN, _ENDS, _STITCH)) + """, u as (select seq_id, a, b from s3 union select seq_id, b, a from s3), r(seq_id, node, reach) as (select seq_id, a, b from u union select r.seq_id, r.node, u.b from r join u on u.seq_id = r.seq_id and u.a = r.reach)
select seq_id, node, least(node, min(reach)) as root from r group by seq_id, node""",
    "track_medians": _with(OBS_SQL, _G, _MED) + f" select seq_id, track_id, {_r('mx', 'my', 'mh', 'mw')}, n from m",
    "edge_share": _with(OBS_SQL, _G) + ", s as (select seq_id, track_id, avg(case when cx < 0.15 * 320 or cx > 0.85 * 320 then 1.0 else 0.0 end) as edge_share from g group by all) select seq_id, track_id, floor((edge_share)::double * 1e5 + 0.5) / 1e5 as edge_share from s",
    "frame_pairs": _with(OBS_SQL, _G, _PAIRS) + f""", d as (select *, iou - dist * dist / (far + 1e-7) as diou, inter / greatest(aa, 1e-6) as a_in_b, inter / greatest(ba, 1e-6) as b_in_a from pr)
select seq_id, frame_idx, a, b, {_r('iou', 'diou', 'a_in_b', 'b_in_a', 'dist')} from d""",
    "overlap_runs": _with(OBS_SQL, _G, _PAIRS) + """, fr as (select distinct seq_id, frame_idx from obs), fp as (select *, row_number() over (partition by seq_id order by frame_idx) as place from fr),
o as (select seq_id, frame_idx, a, b, place - row_number() over (partition by seq_id, a, b order by place) as run from pr join fp using (seq_id, frame_idx) where iou > 0.30)
select seq_id, a, b, min(frame_idx) as run_start, max(frame_idx) as run_end, count(*) as run_len from o group by seq_id, a, b, run having count(*) >= 3""",
    "coalesced_tracks": _with(OBS_SQL, _G, _PAIRS) + """, fr as (select distinct seq_id, frame_idx from obs), fp as (select *, row_number() over (partition by seq_id order by frame_idx) as place from fr),
o as (select seq_id, frame_idx, a, b, place - row_number() over (partition by seq_id, a, b order by place) as run from pr join fp using (seq_id, frame_idx) where iou > 0.30),
r as (select distinct seq_id, a, b from (select seq_id, a, b from o group by seq_id, a, b, run having count(*) >= 3)), c as (select seq_id, track_id, count(*) as n from obs group by all)
select distinct r.seq_id, case when x.n >= y.n then b else a end as track_id from r join c x on x.seq_id = r.seq_id and x.track_id = a join c y on y.seq_id = r.seq_id and y.track_id = b""",
    "overlap_clusters": _with(OBS_SQL, _G, _PAIRS) + f""", h as (select seq_id, frame_idx, a as track_id from pr where iou >= 0.5 union select seq_id, frame_idx, b from pr where iou >= 0.5)
select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'conf')} from obs semi join h using (seq_id, frame_idx, track_id)""",
    "coexisting_fragments": _with(OBS_SQL, _G) + f""", s as (
  select a.seq_id, a.track_id as a, b.track_id as b, sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) <= 0.5 * greatest(a.h, b.h, 1.0) as close, case when a.h > 0 and b.h > 0 then greatest(a.h, b.h) / least(a.h, b.h) end as ratio,
    greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as shared_area, a.w * a.h + b.w * b.h as areas
  from g a join g b on a.seq_id = b.seq_id and a.frame_idx = b.frame_idx and a.track_id < b.track_id),
t as (select seq_id, a, b, count(*) as shared, avg(case when close then 1.0 else 0.0 end) as close, median(ratio) as ratio, avg(coalesce(shared_area / nullif(areas - shared_area, 0), 0)) as mean_iou from s group by seq_id, a, b)
select seq_id, a, b, shared, {_r('close', 'mean_iou')} from t where shared >= 5 and t.close >= 0.6 and ratio <= 1.6 and t.mean_iou >= 0.25""",
    "track_ends": _with(_BROKEN, _ENDS) + f", r as (select seq_id, track_id, n, f0, f1, {', '.join(f'{b}.{c} as {b}_{c}' for b in ('b0', 'b1') for c in ('x1', 'y1', 'x2', 'y2'))}, vx, vy, ux, uy from e) select seq_id, track_id, n, f0, f1, {_r(*[f'{b}_{c}' for b in ('b0', 'b1') for c in ('x1', 'y1', 'x2', 'y2')], 'vx', 'vy', 'ux', 'uy')} from r",
    "stitch_candidates": _with(_BROKEN, _ENDS, _STITCH) + f" select seq_id, a, b, gap, {_r('dist', 'missed')} from s3",
    "stitched_tracks": _merged_sql(_STITCH.strip() + ", lk as (select * from s3)", "a, least(dist, missed), b", True) + f""",
nx as (select *, lead(frame_idx) over w as nf, lead(x1) over w as nx1, lead(y1) over w as ny1, lead(x2) over w as nx2, lead(y2) over w as ny2 from rn window w as (partition by seq_id, track_id order by frame_idx)),
fi as (
  select seq_id, track_id, unnest(range(frame_idx + 1, nf)) as at_frame, * exclude (seq_id, track_id) from nx where nf - frame_idx between 2 and 60),
al as (
  select seq_id, track_id, frame_idx, x1, y1, x2, y2, conf from rn union all
  select seq_id, track_id, at_frame, x1 + (at_frame - frame_idx)::double / (nf - frame_idx) * (nx1 - x1), y1 + (at_frame - frame_idx)::double / (nf - frame_idx) * (ny1 - y1),
    x2 + (at_frame - frame_idx)::double / (nf - frame_idx) * (nx2 - x2), y2 + (at_frame - frame_idx)::double / (nf - frame_idx) * (ny2 - y2), 0.5 from fi)
select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'conf')} from al""",
    "dormant_tracks": _merged_sql(_WAKES, "a_start, a, b_start, b", False) + f" select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'conf')} from rn",
    "dormant_candidates": _with(_BROKEN, _ENDS) + f""", d as (
  select seq_id, a, b, gap - 1 as gap, missed2 as dist, greatest(0.0, least(p.x2 + ux * gap, q.x2) - greatest(p.x1 + ux * gap, q.x1)) * greatest(0.0, least(p.y2 + uy * gap, q.y2) - greatest(p.y1 + uy * gap, q.y1)) as shared_area,
    (p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) as areas, greatest(sqrt(power(q.x2 - q.x1, 2) + power(q.y2 - q.y1, 2)), 1.0) as diagonal from fl where gap between 7 and 41 and an >= 2),
d2 as (select *, shared_area / (areas - shared_area) as iou from d) select seq_id, a, b, gap, {_r('dist', 'iou')} from d2 where d2.dist <= 2 * diagonal and d2.iou >= 0.2""",
    "global_candidates": _with(_BROKEN, _ENDS) + f" select seq_id, a, b, gap - 1 as gap, {_r('dist')} from fl where fl.gap between 1 and 31 and fl.dist <= 0.01::double * sqrt(1920.0 * 1920 + 1080 * 1080)",
    "best_link": _with(_BROKEN, _ENDS) + f""" select seq_id, a, b, gap - 1 as gap, {_r('dist')} from fl where fl.gap between 1 and 31 and fl.dist <= 0.01::double * sqrt(1920.0 * 1920 + 1080 * 1080)
qualify row_number() over (partition by seq_id, a order by fl.gap, b) = 1""",
    "merged_passes": _with(OBS_SQL, _G) + f""", fw as (select * from g), bk as (select * replace (track_id + 100000 as track_id, x1 + case when track_id % 4 = 0 then 2000.0 else 0.0 end as x1, x2 + case when track_id % 4 = 0 then 2000.0 else 0.0 end as x2) from g),
v as (select p.seq_id, q.track_id as bid, p.track_id as fid, count(*) as votes from fw p join bk q on p.seq_id = q.seq_id and p.frame_idx = q.frame_idx
  and greatest(0.0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0.0, least(p.y2, q.y2) - greatest(p.y1, q.y1)) >= 0.45 * (p.w * p.h + q.w * q.h - greatest(0.0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0.0, least(p.y2, q.y2) - greatest(p.y1, q.y1))) group by all having count(*) >= 4),
b1 as (select * from v qualify row_number() over (partition by seq_id, bid order by votes desc, fid) = 1),
ln as (select seq_id, track_id, row_number() over (partition by seq_id order by track_id) as k from (select distinct seq_id, track_id from bk anti join (select seq_id, bid as track_id from b1) using (seq_id, track_id))),
ow as (select bk.*, coalesce(b1.fid, coalesce(t.top, 0) + ln.k) as own from bk left join b1 on b1.seq_id = bk.seq_id and b1.bid = bk.track_id left join ln on ln.seq_id = bk.seq_id and ln.track_id = bk.track_id
  left join (select seq_id, max(track_id) as top from fw group by all) t on t.seq_id = bk.seq_id),
al as (select seq_id, track_id, frame_idx, x1, y1, x2, y2, conf, 0 as ps, track_id as was from fw union all select seq_id, own, frame_idx, x1, y1, x2, y2, conf, 1, track_id from ow)
select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2', 'conf')} from al qualify row_number() over (partition by seq_id, track_id, frame_idx order by ps, was) = 1""",
    "complementary_tracks": _with(_BROKEN, _G) + f""", t as (select distinct seq_id, track_id from g),
u as (
  select x.seq_id, x.track_id as a, y.track_id as b, g.frame_idx, g.track_id, g.cx, g.cy, g.h, lag(g.track_id) over w as wt, lag(frame_idx) over w as wf, lag(cx) over w as wx, lag(cy) over w as wy, lag(h) over w as wh
  from t x join t y on x.seq_id = y.seq_id and x.track_id < y.track_id join g on g.seq_id = x.seq_id and g.track_id in (x.track_id, y.track_id) window w as (partition by x.seq_id, x.track_id, y.track_id order by frame_idx, g.track_id)),
v as (select *, track_id <> wt as turn, sqrt(power(cx - wx, 2) + power(cy - wy, 2)) as far from u where wt is not null),
c as (
  select seq_id, a, b, count(*) filter (turn) as boundaries, max(far) filter (turn) as farthest from v group by all
  having bool_and(frame_idx <> wf and (not turn or (greatest(h, wh) <= 1.05::double * least(h, wh) and far <= 0.1::double * greatest(h, wh, 1.0) and far / greatest(frame_idx - wf, 1) <= greatest(0.25 * greatest(h, wh, 1.0), 30.0)))))
select seq_id, a, b, boundaries, {_r('farthest')} from c where boundaries > 0""",
    "id_votes": _with(OBS_SQL, _G) + """, v as (select p.seq_id, q.track_id + 100000 as backward_id, p.track_id as forward_id, count(*) as votes from g p join g q on p.seq_id = q.seq_id and p.frame_idx = q.frame_idx and q.track_id % 4 <> 0
  and greatest(0.0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0.0, least(p.y2, q.y2) - greatest(p.y1, q.y1)) >= 0.45 * (p.w * p.h + q.w * q.h - greatest(0.0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0.0, least(p.y2, q.y2) - greatest(p.y1, q.y1))) group by all)
select * from v where votes >= 4 qualify row_number() over (partition by seq_id, backward_id order by votes desc, forward_id) = 1""",
    "merge_keep_first": _with(OBS_SQL) + f" select seq_id, track_id, frame_idx, {_r('x1', 'y1', 'x2', 'y2')}, floor((case when frame_idx <= 30 then conf else 0.5 end)::double * 1e5 + 0.5) / 1e5 as conf from obs",
    "prune_stage": _one_rule(_TESTS["stage"], _facts()),
    "prune_spatial": _one_rule(_TESTS["spatial"], _facts()),
    "prune_short": _one_rule(_TESTS["short"].format(least=42, end=114, total=120, share=0.35), _facts(120)),
    "prune_audience": _one_rule(_TESTS["audience"].format(tall=250), _facts()),
    "prune_late_span": _one_rule(_TESTS["late_span"].format(late=42, span=20), _facts(120), _BROKEN),
    "prune_bbox_size": _one_rule(_TESTS["bbox_size"].format(low=0.98, high=1.02), _facts()),
    "prune_aspect": _one_rule(_TESTS["aspect"].format(most=0.49), _facts()),
    "prune_mirror": _one_rule(_TESTS["mirror"], _facts(edge=0.3)),
    "prune_chain": _chain_sql(["duration", "stage", "spatial", "audience"]),
    "prune_all_rules": _chain_sql([x[0] for x in _CHAIN]),
    "prune_info": _with(OBS_SQL, _G, _facts()) + f""" select seq_id, track_id, n as n_frames, f0 as first_frame, f1 as last_frame, {_half('mx', 1)} as median_x, {_half('my', 1)} as median_y, {_half('mh', 1)} as median_h, {_half('mw', 1)} as median_w,
  {_half('mw / mh', 2)} as aspect_ratio, {_half('(f1 - f0) / 60', 4)} as frames_in_video, {_half('100 * mx / 320', 1)} as pos_x, {_half('100 * my / 320', 1)} as pos_y,
  concat_ws(',', {', '.join(f"format('{{:.1f}}', {_half(v, 1)})" for v in ('mx - mw / 2', 'my - mh / 2', 'mx + mw / 2', 'my + mh / 2'))}) as median_box from fa""",
}
