"""Queries of similarity and identity, and the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.functions import geometry as g
from kinetra.operators import evaluate, identity, study, tracks
from kinetra.plans.pose_queries import _HEAD
from kinetra.plans.rounding import rounded
from kinetra.plans.rounding import rounded_sql as _r
from kinetra.plans.track_queries import _G
from kinetra.sources.derived import FRAMES, OBS_SQL, keypoints, obs

#: Of each sequence's embeddings one in so many is a person's in the gallery, the others are asked for.
PERSON = 20


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", (F.col("vec_id") % 7).cast("long").alias("seq_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _gallery(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Asked vectors, of which a third has no known place and a fifth no look, and people."""
    e, v = _embeddings(spark, sf), F.col("vec_id")
    who = v % PERSON == 0
    people = e.where(who).select("seq_id", v.alias("person_id"), v.alias("frame"), F.col("embedding")[0].alias("place"), F.col("embedding").alias("vector"))
    asked = e.where(~who).select("seq_id", v.alias("query_id"), v.alias("frame"), F.when(v % 3 != 0, F.col("embedding")[0]).alias("place"), F.col("embedding").alias("vector"), (v % 5 != 0).alias("shown"))
    return asked, people


def _six(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a person with looks, gait, face and colours from its parts; the first frame's are the gallery."""
    e = F.col("embedding")
    part = lambda a, n: F.slice(e, a, n)
    shares = lambda v: F.transform(v, lambda x: F.abs(x) / F.aggregate(v, F.lit(0.0), lambda t, y: t + F.abs(y)))
    regions = F.map_from_arrays(F.when(e[56] > 0, F.array(F.lit("top"), F.lit("low"))).otherwise(F.array(F.lit("top"))), F.when(e[56] > 0, F.array(shares(part(49, 8)), shares(part(57, 8)))).otherwise(F.array(shares(part(49, 8)))))
    all_ = _embeddings(spark, sf).select(
        "seq_id", "vec_id", F.struct(
            part(1, 16).alias("look"), part(17, 16).alias("crowded_look"), part(33, 8).alias("gait"), F.when(e[40] > 0, part(41, 8)).alias("face"), regions.alias("colours"),
            e[0].alias("x"), e[1].alias("y"), (e[16] > 0).alias("crowded"), (20 + F.col("vec_id") % 20).alias("n_poses"), F.floor(F.col("vec_id") / PERSON).alias("frame"),
        ).alias("v"))
    people = all_.where("v.frame = 0").select("seq_id", F.col("vec_id").alias("person_id"), F.col("v").alias("p"))
    pairs = all_.where("v.frame > 0").select("seq_id", F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(people, "seq_id")
    return identity.best_match(pairs.select("seq_id", "query_id", "person_id", identity.fused(identity.six_signals("q", "p")).alias("score")), 0.13).na.fill({"person_id": -1})


def _bank(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf).withColumns({"track_id": F.col("vec_id") % 20, "frame_idx": F.floor(F.col("vec_id") / 20)})
    lost = e.where(F.col("frame_idx") < F.col("track_id"))
    asked = e.where(F.col("frame_idx") >= F.col("track_id")).select("seq_id", F.col("vec_id").alias("query_id"), "frame_idx", "embedding")
    return identity.bank_matches(lost, asked, 30, 0.02)


def _costs(spark: SparkSession, sf: str) -> DataFrame:
    p = identity.gallery_signals(*_gallery(spark, sf))
    cost = identity.pair_cost(F.col("cosine"), F.abs(F.col("query_id") - F.col("person_id")).cast("double"), F.col("query_id") - F.col("person_id"), 100.0, 200.0)
    return p.select("seq_id", "query_id", "person_id", cost.alias("cost"))


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    q, life = identity.visible_quality(keypoints(spark, sf)), tracks.lifecycle(obs(spark, sf), FRAMES, 3)
    both = life.join(q, ["seq_id", "track_id", "frame_idx"], "left")
    state = F.when((F.col("state") == "ACTIVE") & (F.col("frame_idx") % 4 == 1), "PARTIAL").otherwise(F.col("state"))
    rate = identity.gallery_rate(state, (F.col("frame_idx") % 3).cast("double"), F.coalesce("quality", F.lit(0.0)), 0.2, 0.05, 1.5, 0.55)
    return both.select("seq_id", "track_id", "frame_idx", "quality", rate.alias("rate"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "gallery_signals": lambda s, d: rounded(identity.gallery_signals(*_gallery(s, d))),
    "gallery_match": lambda s, d: rounded(identity.gallery_match(*_gallery(s, d), (0.4, 0.3, 0.1), 0.5).na.fill({"person_id": -1})),
    "fused_match": lambda s, d: rounded(_six(s, d)),
    "bank_match": lambda s, d: rounded(_bank(s, d)),
    "pair_costs": lambda s, d: rounded(_costs(s, d)),
    "gallery_rates": lambda s, d: rounded(_rates(s, d)),
    "body_regions": lambda s, d: identity.body_regions(keypoints(s, d), 300.0),
    "golden_pose": lambda s, d: rounded(identity.golden_pose(keypoints(s, d))),
    "reference_area": lambda s, d: rounded(identity.reference_area(obs(s, d), g.area(), 10)),
    "expectation": lambda s, d: rounded(study.expectation(evaluate.benchmark(obs(s, d), 10), {"at_start": 15, "late": 2, "n_unique": 14})),
}

_E = f"""
em as (select vec_id, vec_id % 7 as seq_id, embedding::double[] as e from embeddings),
gp as (
  select q.seq_id, q.vec_id as query_id, p.vec_id as person_id, list_cosine_similarity(q.e, p.e) as cosine, abs(q.e[1] - p.e[1]) as far,
    list_transform(q.e, lambda v: abs(v) / list_sum(list_transform(q.e, lambda w: abs(w)))) as qh, list_transform(p.e, lambda v: abs(v) / list_sum(list_transform(p.e, lambda w: abs(w)))) as ph
  from em q join em p on q.seq_id = p.seq_id and q.vec_id % {PERSON} <> 0 and p.vec_id % {PERSON} = 0),
gs as (
  select seq_id, query_id, person_id, cosine, sqrt(list_sum(list_transform(list_zip(qh, ph), lambda z: power(sqrt(z[1]) - sqrt(z[2]), 2)))) / sqrt(2) as hellinger,
    case when query_id % 3 <> 0 then greatest(0.0, 1 - far) * exp(-0.01::double * greatest(abs(query_id - person_id), 1)) else 0.5 end as prior from gp)
"""

ORACLE_SQL: dict[str, str] = {
    "gallery_signals": f"with {_E} select seq_id, query_id, person_id, {_r('cosine', 'hellinger', 'prior')} from gs",
    "gallery_match": f"""with {_E}, f as (select seq_id, query_id, person_id, (case when query_id % 5 <> 0 then 0.4::double * cosine else 0 end + 0.3::double * (1 - hellinger) + 0.1::double * prior) / (case when query_id % 5 <> 0 then 0.8::double else 0.4::double end) as score from gs),
b as (select * from f qualify row_number() over (partition by seq_id, query_id order by score desc, person_id) = 1) select seq_id, query_id, case when b.score >= 0.5 then person_id else -1 end as person_id, {_r('score')} from b""",
    "fused_match": f"""with em as (select vec_id, vec_id % 7 as seq_id, vec_id // {PERSON} as f, embedding::double[] as e from embeddings),
sg as (
  select q.seq_id, q.vec_id as query_id, p.vec_id as person_id, list_inner_product(q.e[1:16], p.e[1:16]) as part, case when q.e[17] > 0 then list_inner_product(q.e[17:32], p.e[1:16]) end as crowd,
    case when 20 + q.vec_id % 20 >= 30 then list_inner_product(q.e[33:40], p.e[33:40]) end as gait, case when q.e[41] > 0 and p.e[41] > 0 then list_inner_product(q.e[41:48], p.e[41:48]) end as face,
    list_transform([q.e[49:56], p.e[49:56], q.e[57:64], p.e[57:64]], lambda v: list_transform(v, lambda x: sqrt(abs(x) / list_sum(list_transform(v, lambda y: abs(y)))))) as h, q.e[57] > 0 and p.e[57] > 0 as low,
    greatest(0.0, 1 - sqrt(power(q.e[1] - p.e[1], 2) + power(q.e[2] - p.e[2], 2))) * exp(-0.01::double * greatest(q.f - p.f, 1)) as place
  from em q join em p on q.seq_id = p.seq_id and q.f > 0 and p.f = 0),
hd as (
  select *, sqrt(list_sum(list_transform(range(1, 9), lambda i: power(h[1][i] - h[2][i], 2)))) / sqrt(2) as top_far, sqrt(list_sum(list_transform(range(1, 9), lambda i: power(h[3][i] - h[4][i], 2)))) / sqrt(2) as low_far from sg),
sc as (
  select seq_id, query_id, person_id, (0.3::double * part + 0.15::double * coalesce(crowd, 0) + 0.2::double * coalesce(gait, 0) + 0.2::double * coalesce(face, 0) + 0.1::double * (1 - case when low then (top_far + low_far) / 2 else top_far end) + 0.05::double * place)
    / (0.45::double + case when crowd is null then 0 else 0.15 end + case when gait is null then 0 else 0.2 end + case when face is null then 0 else 0.2 end) as score from hd),
b as (select * from sc qualify row_number() over (partition by seq_id, query_id order by score desc, person_id) = 1)
select seq_id, query_id, case when b.score >= 0.13 then person_id else -1 end as person_id, {_r('score')} from b""",
    "bank_match": f"""with {_E}, x as (select *, vec_id % 20 as track_id, vec_id // 20 as f from em), l as (select *, row_number() over (partition by seq_id, track_id order by f desc) as rn, max(f) over (partition by seq_id, track_id) as last from x where f < track_id),
s as (select q.seq_id, q.vec_id as query_id, l.track_id, avg(list_inner_product(q.e, l.e)) as score from x q join l on q.seq_id = l.seq_id and q.f >= q.track_id and rn <= 5 and q.f - last between 1 and 30 group by all having avg(list_inner_product(q.e, l.e)) > 0.02),
b as (select * from s qualify row_number() over (partition by seq_id, query_id order by score desc, track_id) = 1) select seq_id, query_id, track_id, {_r('score')} from b""",
    "pair_costs": f"""with {_E}, c as (select seq_id, query_id, person_id, 0.6::double * (1 - cosine) / 2 + 0.3::double * least(1.0, abs(query_id - person_id) / 100) + 0.1::double * least(1.0, greatest(query_id - person_id, 0) / 200) as cost from gs)
select seq_id, query_id, person_id, {_r('cost')} from c""",
    "gallery_rates": f"""{_HEAD}, {OBS_SQL.strip()}, sp as (select seq_id, track_id, unnest(range(min(frame_idx), 60)) as frame_idx from obs group by seq_id, track_id having min(frame_idx) < 60),
l as (select sp.*, sp.frame_idx - max(o.frame_idx) over (partition by sp.seq_id, sp.track_id order by sp.frame_idx) as away from sp left join obs o using (seq_id, track_id, frame_idx)),
q as (select seq_id, track_id, frame_idx, coalesce(avg(s) filter (s > 0.1), 0) as quality from kp group by all),
r as (select seq_id, track_id, frame_idx, quality, case when away > 0 then 0.0 when frame_idx % 4 = 1 then 0.3 * 0.2::double when frame_idx % 3 > 1.5 and coalesce(quality, 0) >= 0.55 then 0.2 else 0.05 end as rate from l left join q using (seq_id, track_id, frame_idx))
select seq_id, track_id, frame_idx, {_r('quality', 'rate')} from r""",
    "body_regions": f"""{_HEAD}, r as (select seq_id, track_id, frame_idx, coalesce(floor(avg(y) filter (j in (11, 12) and s > 0.3))::bigint, 135) as upper, coalesce(floor(avg(y) filter (j in (15, 16) and s > 0.3))::bigint, 255) as lower from kp group by all)
select seq_id, track_id, frame_idx, r.upper as upper, r.lower as lower, least(r.lower + floor((300 - r.lower) * 0.8::double)::bigint, 300) as shoes from r""",
    "golden_pose": f"""{_HEAD}, l as (select seq_id, frame_idx, j, list_sort(list(x)) as xs, list_sort(list(y)) as ys, avg(s) as s, count(*) as n from kp group by all),
p as (select seq_id, frame_idx, j, xs[n // 2 + 1] as x, ys[n // 2 + 1] as y, s from l) select seq_id, frame_idx, j, {_r('x', 'y', 's')} from p""",
    "reference_area": f"with {OBS_SQL.strip()},{_G}, r as (select seq_id, track_id, w * h as a, row_number() over (partition by seq_id, track_id order by frame_idx) as rn from g), m as (select seq_id, track_id, max(a) as area from r where rn <= 10 group by all) select seq_id, track_id, {_r('area')} from m",
    "expectation": "with " + OBS_SQL.strip() + f""", r as (select *, max(frame_idx) over (partition by seq_id) as last, min(frame_idx) over (partition by seq_id, track_id) as first from obs),
m as (select seq_id, count(distinct track_id) filter (frame_idx < 10) as at_start, count(distinct track_id) as n_unique, count(distinct track_id) filter (first >= 10) as late from r group by seq_id),
f as (select seq_id, (at_start <> 15)::int + (late <> 2)::int + (n_unique <> 14)::int as failed from m), x as (select seq_id, failed, 1 - failed / 3 as expectation from f) select seq_id, failed, {_r('expectation')} from x""",
}
