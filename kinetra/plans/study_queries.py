"""Queries of study analytics; trials are taken from orders, contests from line items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetra.operators import evaluate, study
from kinetra.plans.rounding import half_up_sql, rounded
from kinetra.plans.rounding import rounded_sql as _r


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "P", "FAIL").otherwise("RUNNING")
    return o.select(
        F.col("o_orderkey").alias("number"), (F.col("o_custkey") % 50).alias("study"), state.alias("state"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("value"),
        F.create_map(F.lit("a"), (F.col("o_orderkey") % 7).cast("double"), F.lit("b"), (F.col("o_custkey") % 13).cast("double")).alias("params"),
    )


def _hints(spark: SparkSession, sf: str) -> DataFrame:
    """Trials whose parameters lean on their values, one of them a word."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    number, price = F.col("o_orderkey"), F.col("o_totalprice")
    params = F.create_map(
        F.lit("a"), (number % 7 + F.floor(price / 100000)).cast("string"), F.lit("b"), (F.col("o_custkey") % 13).cast("string"),
        F.lit("c"), F.when((price > 180000) | (number % 4 == 0), "fast").otherwise("slow"), F.lit("d"), F.when(number % 3 != 0, F.substring("o_orderpriority", 1, 1)).otherwise("x"),
    )
    trials = o.select(number.alias("number"), (F.col("o_custkey") % 50).alias("study"), F.when(number % 11 != 0, price).alias("value"), params.alias("params"))
    return study.param_hints(trials)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("w"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1 + F.col("n_regionkey")).cast("string")).alias("l"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/lineitem.parquet")
    return s.select(F.col("l_returnflag").alias("grp"), (F.col("l_discount") * 10).alias("score"), F.col("l_quantity").alias("weight"))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    score = evaluate.composite(F.col("p_size") / 50.0, F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice") / 2000.0), F.when(F.col("p_partkey") % 3 != 0, F.lit(0.5)), F.col("p_partkey") % 10, F.col("p_partkey") % 7, F.col("p_size") * 2)
    return p.select("p_partkey", score.alias("score"))


def _blend(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/lineitem.parquet")
    return evaluate.blended(o.select(F.col("l_returnflag").alias("grp"), F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 10).alias("score"), (F.col("l_quantity") - 10).alias("weight")))


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    base = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("base"), F.create_map(F.lit("x"), (F.col("s_suppkey") % 3).cast("string"), F.lit("y"), F.lit("1")).alias("params"))
    return study.variants(base, [("x", "0"), ("x", "1"), ("y", "1"), ("y", "2")]).select("base", "plan").distinct()


def _reasons(spark: SparkSession, sf: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.create_map(F.concat_ws("-", "l_returnflag", "l_linestatus"), F.col("l_linenumber").cast("long")).alias("reasons"))
    return study.failure_reasons(runs)


def _sequence_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs in trees of three branches, each with a field of its own and one that its branch sets anew."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    fields = F.create_map(F.concat(F.lit("f"), (F.col("id") % 4).cast("string")), F.col("id").cast("string"))
    return s.select("id", F.when(F.col("id") > 3, F.floor(F.col("id") / 3)).alias("parent"), fields.alias("fields"))


def _effective(spark: SparkSession, sf: str) -> DataFrame:
    return study.effective(_runs(spark, sf)).select("id", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields"))


def _both_runs(spark: SparkSession, sf: str) -> DataFrame:
    t = _trials(spark, sf).select(F.col("number").alias("id"), F.col("state").alias("status"), "value")
    return study.merged_runs(t.where("value is null or value > 100000").withColumn("status", F.lit("RUNNING")), t.where("value is null or value <= 200000"))


def _latencies(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return study.latencies(e.select(F.col("event_type").alias("source"), F.col("value").alias("ms"), (F.col("event_id") % 11).alias("n")))


def _phases(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("phase")).agg(F.sum("l_quantity").alias("seconds"))
    return study.phase_shares(li.withColumn("wall", F.sum("seconds").over(Window.partitionBy("run")) + 1.0))


def _ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return study.ambiguous(_edges(spark, sf), n.select(F.col("n_regionkey").alias("grp"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name")))


def _order(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of a nation against those a few places on, and some the other way round, so that there are circles."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select((F.col("s_nationkey") % 5).alias("grp"), F.col("s_suppkey").alias("w"))
    edges = rows.select("w", F.explode(F.array(F.col("w") + 5, F.col("w") + 10, F.col("w") - 15)).alias("l"))
    edges = edges.where("l % 3 != 0 or w % 2 = 0")
    return study.peel(edges, rows.select("grp", F.col("w").alias("name")))


def _coerced(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    n = F.col("o_orderkey")
    text = F.when(n % 5 == 0, F.lit(" Yes ")).when(n % 5 == 1, F.lit("off")).when(n % 5 == 2, F.lit("")).when(n % 5 == 3, n.cast("string")).otherwise(F.lit("2.5"))
    return o.select("o_orderkey", study.coerced(text, "bool").alias("flag"), study.coerced(text, "float").alias("number"), study.fingerprint(text).alias("print"))


def _key_differences(spark: SparkSession, sf: str) -> DataFrame:
    return study.key_differences(_runs(spark, sf), ["f0", "f1", "g"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "study_status": lambda s, d: study.status(_trials(s, d)),
    "trial_ranking": lambda s, d: study.ranking(_trials(s, d)),
    "trial_running": lambda s, d: rounded(study.running(_trials(s, d))),
    "param_insights": lambda s, d: rounded(study.param_insights(_trials(s, d))),
    "param_hints": lambda s, d: rounded(_hints(s, d)),
    "harmonic_mean": lambda s, d: rounded(study.harmonic(_scores(s, d)), 6),
    "composite_score": lambda s, d: rounded(_metrics(s, d), 6),
    "objective_blend": lambda s, d: rounded(_blend(s, d), 6),
    "wins_losses": lambda s, d: study.wins_and_losses(_edges(s, d)),
    "tournament_closure": lambda s, d: study.closure(_edges(s, d)),
    "tournament_ambiguous": _ambiguous,
    "tournament_order": _order,
    "run_depths": lambda s, d: study.depths(_runs(s, d)),
    "run_fields": _effective,
    "merged_runs": lambda s, d: rounded(_both_runs(s, d), 2),
    "batch_rollup": lambda s, d: rounded(study.rollup(_trials(s, d).select(F.col("study").alias("batch"), F.col("state").alias("status"), F.col("number").alias("created")))),
    "param_ranges": lambda s, d: rounded(study.param_ranges(_trials(s, d).where("state = 'COMPLETE'"))),
    "detector_latencies": lambda s, d: rounded(_latencies(s, d)),
    "phase_shares": lambda s, d: rounded(_phases(s, d)),
    "coerced_fields": lambda s, d: rounded(_coerced(s, d)),
    "key_differences": _key_differences,
    "plan_variants": _variants,
    "failure_reasons": _reasons,
    "event_windows": lambda s, d: rounded(_sequence_windows(s, d), 2),
}

_T = """
with t as (
  select o_orderkey as number, o_custkey % 50 as study, case o_orderstatus when 'F' then 'COMPLETE' when 'P' then 'FAIL' else 'RUNNING' end as state,
    case when o_orderkey % 11 <> 0 then o_totalprice end as value, (o_orderkey % 7)::double as a, (o_custkey % 13)::double as b from orders)
"""
_E = """
e as (select 'n' || n_nationkey as w, 'n' || (n_nationkey + 1 + n_regionkey) as l from nation)
"""

_R = """
rn as (select s_suppkey as id, case when s_suppkey > 3 then s_suppkey // 3 end as parent, 'f' || (s_suppkey % 4) as k, s_suppkey::varchar as v from supplier)
"""

ORACLE_SQL: dict[str, str] = {
    "study_status": _T + """ select count(*) as n_trials, count_if(state = 'COMPLETE')::bigint as n_complete, count_if(state = 'FAIL')::bigint as n_failed, max(value) filter (state = 'COMPLETE') as best_value,
  (select number from t where state = 'COMPLETE' and value is not null order by value desc, number limit 1) as best_number from t""",
    "trial_ranking": _T + " select number, value, row_number() over (order by value desc nulls last, number desc)::bigint as place from t",
    "trial_running": _T + """ select study, number, floor((avg(value) over (partition by study order by number rows 9 preceding))::double * 1e5 + 0.5) / 1e5 as rolling_mean,
  floor((max(value) over (partition by study order by number))::double * 1e5 + 0.5) / 1e5 as best_so_far from t""",
    "param_insights": _T + """, h as (select *, ntile(2) over (partition by study order by value desc nulls last, number) as half from t), u as (select study, half, 'a' as param, a as v from h union all select study, half, 'b', b from h)
select study, param, floor((avg(v) filter (half = 1))::double * 1e5 + 0.5) / 1e5 as mean_top, floor((avg(v) filter (half = 2))::double * 1e5 + 0.5) / 1e5 as mean_bottom, count(*) as n from u group by all""",
    "param_hints": f"""with t as (
  select o_orderkey as number, o_custkey % 50 as study, o_totalprice as value, (o_orderkey % 7 + cast(floor(o_totalprice / 100000) as bigint))::varchar as a, (o_custkey % 13)::varchar as b,
    case when o_totalprice > 180000 or o_orderkey % 4 = 0 then 'fast' else 'slow' end as c, case when o_orderkey % 3 <> 0 then substr(o_orderpriority, 1, 1) else 'x' end as d from orders where o_orderkey % 11 <> 0),
h as (select *, ntile(2) over (partition by study order by value desc, number) as half from t),
u as (select study, half, unnest(['a', 'b', 'c', 'd']) as param, unnest([a, b, c, d]) as v from h),
m as (select study, param, bool_and(try_cast(v as double) is not null) as plain, avg(try_cast(v as double)) filter (half = 1) as top, avg(try_cast(v as double)) filter (half = 2) as bottom, count(*) filter (half = 1) as n1, count(*) filter (half = 2) as n2 from u group by all having count(distinct half) = 2),
k as (select study, param, v, count(*) filter (half = 1) as k1, count(*) filter (half = 2) as k2 from u group by study, param, v qualify row_number() over (partition by study, param order by count(*) filter (half = 1) desc, v) = 1),
r as (
  select study, param, case when top > bottom then 'higher' else 'lower' end as direction, abs(top - bottom) / greatest(top, bottom, 0.001) > 0.15 as strong, null as value, top, bottom from m where plain and abs(top - bottom) / greatest(top, bottom, 0.001) >= 0.04::double
  union all
  select study, param, 'categorical', k1::double / n1 - k2::double / n2 > 0.5, v, k1::double / n1, k2::double / n2 from m join k using (study, param) where not plain and k1::double / n1 - k2::double / n2 >= 0.25)
select study, param, direction, strong, value, {half_up_sql('top', 5)} as top, {half_up_sql('bottom', 5)} as bottom from r""",
    "harmonic_mean": "select l_returnflag as grp, floor((sum(l_quantity) / sum(l_quantity / greatest(l_discount * 10, 1e-6)))::double * 1e6 + 0.5) / 1e6 as harmonic from lineitem group by all",
    "composite_score": """with m as (select p_partkey, p_size / 50.0::double as h, case when p_partkey % 5 <> 0 then p_retailprice / 2000.0::double end as r, case when p_partkey % 3 <> 0 then 0.5::double end as f, greatest(p_size * 2, 1) as n from part),
c as (select p_partkey, 0.45::double * h + 0.25::double * coalesce(nullif(r, 0), f, h) + 0.20::double * (1 - least((p_partkey % 10) / greatest(n * 0.05::double, 1), 1)) + 0.10::double * (1 - least((p_partkey % 7) / greatest(n * 0.10::double, 1), 1)) as score from m)
select p_partkey, floor(score * 1e6 + 0.5) / 1e6 as score from c""",
    "objective_blend": """with p as (select l_returnflag as grp, l_discount * 10 as s, l_quantity - 10 as w from lineitem where l_linenumber <> 3 and l_quantity > 10),
b as (select grp, sum(w * s) / sum(w) as objective, count(*) as n from p group by all) select grp, floor(objective::double * 1e6 + 0.5) / 1e6 as objective, n from b""",
    "wins_losses": f"with {_E}, u as (select w as name, 1 as won from e union all select l, 0 from e) select name, sum(won)::bigint as wins, sum(1 - won)::bigint as losses, (sum(won) - sum(1 - won))::bigint as margin from u group by all",
    "tournament_closure": f"with recursive {_E}, r(w, l) as (select w, l from e union select r.w, e.l from r join e on r.l = e.w) select w, l from r",
    "tournament_ambiguous": f"""with recursive {_E}, r(w, l) as (select w, l from e union select r.w, e.l from r join e on r.l = e.w), p as (select n_regionkey as grp, 'n' || n_nationkey as name from nation)
select a.grp, a.name as a, b.name as b from p a join p b on a.grp = b.grp and a.name < b.name where not exists (select 1 from r where (w = a.name and l = b.name) or (w = b.name and l = a.name))""",
    "tournament_order": """with recursive
po as (select s_nationkey % 5 as grp, s_suppkey as name from supplier),
e0 as (select name as w, unnest([name + 5, name + 10, name - 15]) as l from po),
e as (select * from e0 where l % 3 <> 0 or w % 2 = 0),
mg as (select name, sum(v) as margin from (select w as name, 1 as v from e union all select l, -1 from e) group by name),
ed as (select a.grp, list({w: e.w, l: e.l}) as es from e join po a on a.name = e.w join po b on b.name = e.l and b.grp = a.grp group by a.grp),
pl as (select grp, list({m: -coalesce(margin, 0), name: po.name} order by -coalesce(margin, 0), po.name) as left_ from po left join mg on mg.name = po.name group by grp),
st(grp, place, name, forced, left_, es) as (
  select pl.grp, -1, null::bigint, false, left_, coalesce(es, []) from pl left join ed using (grp)
  union all
  select grp, place + 1, pick.name, k is null, list_filter(left_, lambda x: x.name <> pick.name), list_filter(es, lambda x: x.w <> pick.name and x.l <> pick.name)
  from (select *, coalesce(k, left_[1]) as pick from (select *, list_filter(left_, lambda x: not list_contains(list_transform(es, lambda y: y.l), x.name))[1] as k from st where len(left_) > 0)))
select grp, name, place, forced from st where place >= 0""",
    "run_depths": f"with recursive {_R}, d(id, root, depth) as (select id, id, 0::bigint from rn where parent is null union all select rn.id, d.root, d.depth + 1 from rn join d on rn.parent = d.id) select id, root, depth from d",
    "run_fields": f"""with recursive {_R}, c(id, up, k, v, depth) as (select id, parent, k, v, 0 from rn union all select c.id, rn.parent, rn.k, rn.v, depth + 1 from c join rn on c.up = rn.id where depth < 31),
m as (select id, k, min_by(v, depth) as v from c group by all) select id, string_agg(k || '=' || v, ',' order by k) as fields from m group by id""",
    "merged_runs": _T + f""", m as (select number, 'RUNNING' as status, value from t where value is null or value > 100000), d as (select number, state as status, value from t where value is null or value <= 200000)
select coalesce(m.number, d.number) as id, case when m.number is not null then m.status else d.status end as status, {half_up_sql('case when m.number is not null then m.value else d.value end', 2)} as value, case when m.number is not null then 'memory' else 'disk' end as origin
from m full join d on m.number = d.number""",
    "batch_rollup": _T + " select study as batch, count(*) as n, count_if(state = 'COMPLETE')::bigint as done, count_if(state = 'FAIL')::bigint as failed, count_if(state = 'RUNNING')::bigint as running, max(number) as latest from t group by all",
    "param_ranges": _T + f""", c as (select *, row_number() over (partition by study order by number) > greatest(1, floor(count(*) over (partition by study) * 0.6::double)) as late from t where state = 'COMPLETE'),
u as (select study, late, 'a' as param, a as v from c union all select study, late, 'b', b from c),
p as (select study, param, count(*) as n, min(v) as low, max(v) as high, avg(v) as mean, coalesce(avg(v) filter (late), avg(v)) as recent_mean, coalesce(avg(v) filter (not late), avg(v)) as early, count_if(late) as nl, max(v) filter (late) - min(v) filter (late) as ls from u group by all having count(*) >= 2)
select study, param, {_r('low', 'high', 'mean', 'recent_mean')}, high - low > 0.001 and case when nl > 1 then ls else high - low end < (high - low) * 0.55::double as converging,
  case when abs(recent_mean - early) < (high - low) * 0.1::double then 'stable' when recent_mean - early > 0 then 'up' else 'down' end as direction from p""",
    "detector_latencies": f"""with r as (select event_type as source, value as ms, event_id % 11 as n, row_number() over (partition by event_type order by value) as rn, count(*) over (partition by event_type) as k from events),
p as (select source, count(*) as frames, avg(ms) as mean_ms, max(ms) filter (rn = greatest(1, least(k, ceil(k * 0.5::double)))) as p50_ms, max(ms) filter (rn = greatest(1, least(k, ceil(k * 0.95::double)))) as p95_ms, sum(n)::bigint as total, avg(n) as mean_n, max(n) as most from r group by all)
select source, frames, {_r('mean_ms', 'p50_ms', 'p95_ms')}, total, {_r('mean_n')}, most from p""",
    "phase_shares": f"""with p as (select l_orderkey as run, l_returnflag as phase, sum(l_quantity) as s from lineitem group by all), q as (select *, s / (sum(s) over (partition by run) + 1) as share, row_number() over (partition by run order by s desc, phase) as rn from p)
select run, phase, {_r('share')}, rn = 1 and q.share >= 0.55 and s >= 5 as target from q""",
    "coerced_fields": f"""with t as (select o_orderkey, case o_orderkey % 5 when 0 then ' Yes ' when 1 then 'off' when 2 then '' when 3 then o_orderkey::varchar else '2.5' end as t from orders)
select o_orderkey, case when trim(t) <> '' then lower(trim(t)) in ('1', 'true', 'yes', 'on') end as flag, {half_up_sql('try_cast(trim(t) as double)', 5)} as number, sha256(t)[1:16] as print from t""",
    "key_differences": "select s_suppkey as id, case when s_suppkey % 4 > 1 then 'f' || s_suppkey % 4 else '' end as unknown, case s_suppkey % 4 when 0 then 'f1,g' when 1 then 'f0,g' else 'f0,f1,g' end as missing from supplier",
    "plan_variants": """with o(p, v) as (values ('x', '0'), ('x', '1'), ('y', '1'), ('y', '2')), b as (select s_suppkey as base, (s_suppkey % 3)::varchar as x, '1' as y from supplier)
select distinct base, '[{"key":"x","value":"' || case when p = 'x' then v else x end || '"},{"key":"y","value":"' || case when p = 'y' then v else y end || '"}]' as plan from b, o""",
    "failure_reasons": "select l_returnflag || '-' || l_linestatus as reason, sum(l_linenumber)::bigint as total from lineitem group by all order by total desc, reason limit 8",
    "event_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, floor((sum(value))::double * 1e2 + 0.5) / 1e2 as total from events group by all",
}
