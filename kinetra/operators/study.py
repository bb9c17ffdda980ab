"""Analytics of studies and runs: status counts, rankings, parameter effects, tournaments and trees."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.sources.shared import written


def status(trials: DataFrame) -> DataFrame:
    """Counts of each state and the best completed trial (number, state, value)."""
    done = F.when(F.col("state") == "COMPLETE", F.col("value"))
    return trials.agg(
        F.count("*").alias("n_trials"), F.count_if(F.col("state") == "COMPLETE").alias("n_complete"), F.count_if(F.col("state") == "FAIL").alias("n_failed"),
        F.max(done).alias("best_value"), F.max_by("number", F.struct(done, -F.col("number"))).alias("best_number"),
    )


def ranking(trials: DataFrame, descending: bool = True) -> DataFrame:
    """Rank of each trial by value, nulls last in both directions, ties to the larger number.

    Trials are dealt out by ranges of the value; a trial's place is its place in its range and the sizes of the ranges before.
    """
    by = F.desc_nulls_last("value") if descending else F.asc_nulls_last("value")
    dealt = written(trials.select("number", "value").repartitionByRange(by, F.desc("number")).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    inside = dealt.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy(by, F.desc("number"))))
    return inside.join(before, "part").select("number", "value", (F.col("before") + F.col("rn")).alias("place"))


def running(trials: DataFrame, rows: int = 10) -> DataFrame:
    """Rolling mean of values and the best so far, within a study (study, number, value)."""
    w = Window.partitionBy("study").orderBy("number")
    return trials.select("study", "number", F.avg("value").over(w.rowsBetween(-(rows - 1), 0)).alias("rolling_mean"), F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best_so_far"))


def param_insights(trials: DataFrame) -> DataFrame:
    """Each parameter's mean in the better and the worse half of the trials of a study. ``params``: map to numbers."""
    half = F.ntile(2).over(Window.partitionBy("study").orderBy(F.desc("value"), "number"))
    long = trials.withColumn("half", half).select("study", "half", F.explode("params").alias("param", "v"))
    return long.groupBy("study", "param").agg(F.avg(F.when(F.col("half") == 1, F.col("v"))).alias("mean_top"), F.avg(F.when(F.col("half") == 2, F.col("v"))).alias("mean_bottom"), F.count("*").alias("n"))


def param_hints(trials: DataFrame) -> DataFrame:
    """(study, param, direction, strong, value, top, bottom): what the better half of a study's finished trials does otherwise. ``params``: map to texts.

    A parameter that is a number throughout: higher or lower, by its means in both halves, if they differ by 4 % of the larger, strong from
    15 %. Others: ``categorical``, the commonest value of the better half (of equals the first in order), if its share there is larger by a
    quarter, strong by a half. The better half has the odd trial; trials without a value are not finished.
    """
    half = F.ntile(2).over(Window.partitionBy("study").orderBy(F.desc("value"), "number"))
    long = trials.where("value is not null").withColumn("half", half).select("study", "half", F.explode("params").alias("param", "v")).where("v is not null")
    long = long.withColumn("x", F.col("v").try_cast("double"))
    of = lambda k, v: F.when(F.col("half") == k, v)
    means = long.groupBy("study", "param").agg(F.bool_and(F.col("x").isNotNull()).alias("plain"), *[F.avg(of(k, F.col("x"))).alias(n) for k, n in ((1, "top"), (2, "bottom"))], *[F.count(of(k, F.col("v"))).alias(n) for k, n in ((1, "n_top"), (2, "n_bottom"))])
    means = means.where("n_top > 0 and n_bottom > 0")
    apart = F.abs(F.col("top") - F.col("bottom")) / F.greatest("top", "bottom", F.lit(0.001))
    numbers = means.where("plain").withColumn("apart", apart).where("apart >= 0.04")
    numbers = numbers.select("study", "param", F.when(F.col("top") > F.col("bottom"), "higher").otherwise("lower").alias("direction"), (F.col("apart") > 0.15).alias("strong"), F.lit(None).cast("string").alias("value"), "top", "bottom")
    counts = long.groupBy("study", "param", "v").agg(*[F.count(of(k, F.col("v"))).alias(n) for k, n in ((1, "k_top"), (2, "k_bottom"))])
    modes = counts.groupBy("study", "param").agg(F.min_by(F.struct("v", "k_top", "k_bottom"), F.struct(-F.col("k_top"), "v")).alias("m"))
    texts = means.where("not plain").join(modes, ["study", "param"]).select("study", "param", "m.v", (F.col("m.k_top") / F.col("n_top")).alias("top"), (F.col("m.k_bottom") / F.col("n_bottom")).alias("bottom"))
    more = F.col("top") - F.col("bottom")
    return numbers.unionByName(texts.where(more >= 0.25).select("study", "param", F.lit("categorical").alias("direction"), (more > 0.5).alias("strong"), F.col("v").alias("value"), "top", "bottom"))


def harmonic(scores: DataFrame) -> DataFrame:
    """Weighted harmonic mean of scores with a floor, per group (grp, score, weight)."""
    return scores.groupBy("grp").agg((F.sum("weight") / F.sum(F.col("weight") / F.greatest(F.col("score"), F.lit(1e-6)))).alias("harmonic"))


def wins_and_losses(edges: DataFrame) -> DataFrame:
    """Per contestant: wins, losses and their difference (edges: w, l)."""
    rows = edges.select(F.col("w").alias("name"), F.lit(1).alias("won")).union(edges.select(F.col("l").alias("name"), F.lit(0).alias("won")))
    wins, losses = F.sum("won"), F.sum(1 - F.col("won"))
    return rows.groupBy("name").agg(wins.alias("wins"), losses.alias("losses"), (wins - losses).alias("margin"))


def closure(edges: DataFrame) -> DataFrame:
    """All (w, l) that follow from the edges by transitivity: joined on until no new pair appears."""
    known = new = written(edges.select("w", "l").distinct())
    on = lambda a, b: a.select("w", F.col("l").alias("m")).join(b.select(F.col("w").alias("m"), "l"), "m").select("w", "l")
    while not new.isEmpty():
        # A path through the pairs of the last round has them before or after the rest; lengths double.
        new = written(on(new, known).union(on(known, new)).subtract(known))
        known = written(known.union(new))
    return known


def peel(edges: DataFrame, pool: DataFrame) -> DataFrame:
    """(grp, name, place, forced): each group of the pool (grp, name) from best to worst by its edges (w, l).

    One goes after another: of those that nobody left beats, the one with the most wins less losses, then the smaller name; where
    everybody is beaten, one of all by the same order, which is ``forced``. A task takes one group with the edges within it, each of which it looks at once.
    """
    margins = wins_and_losses(edges).select("name", "margin")
    left = pool.where("name is not null").select("grp", "name").distinct().join(margins, "name", "left").na.fill(0, ["margin"])
    of = lambda c: pool.select("grp", F.col("name").alias(c)).distinct()
    within = edges.select("w", "l").distinct().join(of("w"), "w").join(of("l"), ["grp", "l"]).where("w != l").select("grp", "w", "l")

    def run(names: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        rank = dict(zip(names["name"], zip(-names["margin"], names["name"], strict=True), strict=True))
        beats, beaten = {}, dict.fromkeys(rank, 0)
        for w, l in zip(met["w"], met["l"], strict=True):
            beats.setdefault(w, []).append(l)
            beaten[l] += 1
        free, rest, order, gone = [rank[n] for n, k in beaten.items() if not k], list(rank.values()), [], set()
        heapq.heapify(free)
        heapq.heapify(rest)
        while rest:
            forced = not free
            name = heapq.heappop(rest if forced else free)[1]
            if name in gone:
                continue
            gone.add(name)
            order.append((name, forced))
            for l in beats.get(name, ()):
                beaten[l] -= 1
                if not beaten[l] and l not in gone:
                    heapq.heappush(free, rank[l])
            while rest and rest[0][1] in gone:
                heapq.heappop(rest)
        return pd.DataFrame({"grp": names["grp"].iloc[:1].repeat(len(order)).to_numpy(), "name": [n for n, _ in order], "place": range(len(order)), "forced": [f for _, f in order]})

    types = dict(left.dtypes)
    return left.groupBy("grp").cogroup(within.withColumnRenamed("grp", "of").groupBy("of")).applyInPandas(run, f"grp {types['grp']}, name {types['name']}, place int, forced boolean")


def variants(base: DataFrame, options: list[tuple[str, str]]) -> DataFrame:
    """One-option-at-a-time plan: each base's parameters with one of them replaced, without repeats of a plan.

    ``options`` (list of param and value) are part of the plan itself: each row makes as many rows by design.
    """
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.lit(v).alias("value")) for p, v in options]))
    made = base.withColumn("o", each).select("*", "o.param", "o.value").withColumn("params", F.map_concat(F.map_filter("params", lambda k, _: k != F.col("param")), F.create_map("param", "value")))
    plan = F.to_json(F.array_sort(F.map_entries("params")))
    return made.select("base", "param", "value", plan.alias("plan")).dropDuplicates(["base", "plan"])


def failure_reasons(runs: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent reasons (a map from reason to count per run)."""
    long = runs.select(F.explode("reasons").alias("reason", "n"))
    return long.groupBy("reason").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "reason").limit(top)


def ambiguous(edges: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs (a, b) of the pool (grp, name) that the closure of the edges does not order; contestants meet within a group only."""
    known = closure(edges)
    known = known.union(known.select("l", "w")).toDF("a", "b").distinct()
    a, b = (pool.select("grp", F.col("name").alias(s)) for s in "ab")
    return a.join(b, "grp").where("a < b").join(known, ["a", "b"], "left_anti").select("grp", "a", "b")


def depths(runs: DataFrame) -> DataFrame:
    """Per run (id, parent): its root and its depth below it; a parent that is no run counts as none.

    Pointers double each round: after k rounds each run points 2^k steps up. Runs in a circle have no root and are left out.
    """
    known = runs.select(F.col("id").alias("parent")).distinct()
    base = runs.select("id", "parent").join(known.withColumn("there", F.lit(True)), "parent", "left")
    at = written(base.select("id", F.when(F.col("there"), F.col("parent")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"), F.when(~F.coalesce("there", F.lit(False)), F.col("id")).alias("root")))
    before = None
    while (left := at.where("up is not null").count()) and left != before:
        before = left
        far = at.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("root").alias("top"))
        at = written(at.join(far, "up", "left").select("id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("root", "top").alias("root")))
    return at.where("root is not null").select("id", "root", "depth")


def effective(runs: DataFrame, levels: int = 32) -> DataFrame:
    """Per run (id, parent, fields: map): the fields of its chain of parents, up to ``levels`` runs, those of nearer runs over farther ones."""
    out = written(runs.select("id", "parent", "fields"))
    source = out.select(F.col("id").alias("p"), F.col("parent").alias("next"), F.col("fields").alias("above"))
    for _ in range(levels - 1):
        if out.where("parent is not null").isEmpty():
            break
        own = F.map_filter(F.coalesce("above", F.map_from_arrays(F.array(), F.array()).cast("map<string, string>")), lambda k, _: ~F.map_contains_key("fields", k))
        out = written(out.join(source, F.col("parent") == F.col("p"), "left").select("id", F.col("next").alias("parent"), F.map_concat("fields", own).alias("fields")))
    return out.select("id", "fields")


def merged_runs(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """Rows of both (id, status, value); what memory has wins."""
    m, d = memory.select("id", F.struct("status", "value").alias("m")), disk.select("id", F.struct("status", "value").alias("d"))
    row = F.coalesce("m", "d")
    return m.join(d, "id", "full").select("id", row["status"].alias("status"), row["value"].alias("value"), F.when(F.col("m").isNotNull(), "memory").otherwise("disk").alias("origin"))


def rollup(runs: DataFrame) -> DataFrame:
    """Per batch (batch, status, created): number of runs, of each status, and the latest."""
    count = lambda s: F.count_if(F.col("status") == s)
    return runs.groupBy("batch").agg(F.count("*").alias("n"), *[count(s).alias(n) for s, n in (("COMPLETE", "done"), ("FAIL", "failed"), ("RUNNING", "running"))], F.max("created").alias("latest"))


def param_ranges(trials: DataFrame) -> DataFrame:
    """Per study and parameter over its completed trials in order: range, means of all and of the last 40 %, drift and whether the range narrows.

    ``trials``: study, number, params (map to numbers). Two values at least; the drift is stable within a tenth of the
    spread, the range narrows if the recent one is under 55 % of it.
    """
    w, whole = Window.partitionBy("study").orderBy("number"), Window.partitionBy("study")
    cut = F.greatest(F.lit(1), F.floor(F.count("*").over(whole) * 0.6))
    late = trials.withColumn("late", F.row_number().over(w) > cut)
    v, new = F.col("v"), F.col("late")
    per = late.select("study", "late", F.explode("params").alias("param", "v")).where("v is not null").groupBy("study", "param").agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.avg(F.when(new, v)).alias("late_mean"), F.avg(F.when(~new, v)).alias("early_mean"),
        F.count_if(new).alias("n_late"), (F.max(F.when(new, v)) - F.min(F.when(new, v))).alias("late_spread"),
    )
    spread, recent = F.col("high") - F.col("low"), F.coalesce("late_mean", "mean")
    drift = recent - F.coalesce("early_mean", "mean")
    narrow = F.when(F.col("n_late") > 1, F.col("late_spread")).otherwise(spread)
    return per.where("n >= 2").select(
        "study", "param", "low", "high", "mean", recent.alias("recent_mean"), ((spread > 0.001) & (narrow < spread * 0.55)).alias("converging"),
        F.when(F.abs(drift) < spread * 0.1, "stable").when(drift > 0, "up").otherwise("down").alias("direction"),
    )


def latencies(frames: DataFrame) -> DataFrame:
    """Per source (source, ms, n): mean, nearest-rank 50th and 95th percentile of the time, and of detections the total, mean and most."""
    w = Window.partitionBy("source").orderBy("ms")
    ranked = frames.withColumns({"rn": F.row_number().over(w), "k": F.count("*").over(Window.partitionBy("source"))})
    at = lambda q: F.max(F.when(F.col("rn") == F.greatest(F.lit(1), F.least(F.col("k"), F.ceil(F.col("k") * q))), F.col("ms")))
    return ranked.groupBy("source").agg(F.count("*").alias("frames"), F.avg("ms").alias("mean_ms"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), F.sum("n").alias("total"), F.avg("n").alias("mean_n"), F.max("n").alias("most"))


def phase_shares(timings: DataFrame, most: float = 0.55, seconds: float = 5.0) -> DataFrame:
    """Per run and phase (run, phase, seconds, wall): its share of the wall time, and whether it is the one to look at: the longest, with a share of ``most`` and some seconds."""
    first = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("seconds"), "phase")) == 1
    share = F.col("seconds") / F.nullif(F.col("wall"), F.lit(0.0))
    return timings.select("run", "phase", share.alias("share"), F.coalesce(first & (share >= most) & (F.col("seconds") >= seconds), F.lit(False)).alias("target"))


def expectation(metrics: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Per sequence: one less the share of expected figures (column to value) that are not met."""
    failed = sum((F.when(F.col(c) == v, 0).otherwise(1) for c, v in expected.items()), F.lit(0))
    return metrics.select("seq_id", failed.alias("failed"), (1 - failed / max(1, len(expected))).alias("expectation"))


def coerced(text: Column, kind: str) -> Column:
    """A field's text as its kind (bool, int, float or string); null where it does not fit. True is 1, true, yes or on in any case."""
    plain = F.nullif(F.trim(text), F.lit(""))
    if kind == "bool":
        return F.when(plain.isNotNull(), F.lower(plain).isin("1", "true", "yes", "on"))
    return plain.try_cast({"int": "bigint", "float": "double", "string": "string"}[kind])


def fingerprint(text: Column, n: int = 16) -> Column:
    """First characters of the hexadecimal SHA-256."""
    return F.substring(F.sha2(text, 256), 1, n)


def key_differences(docs: DataFrame, schema: list[str]) -> DataFrame:
    """Per document (id, fields: map): its keys that the schema lacks, and the schema's that it lacks, sorted and joined by commas."""
    known = F.array(*[F.lit(k) for k in schema])
    join = lambda a: F.array_join(F.array_sort(a), ",")
    keys = F.map_keys("fields")
    return docs.select("id", join(F.array_except(keys, known)).alias("unknown"), join(F.array_except(known, keys)).alias("missing"))
