"""Merging one after another, and links of ends with starts by tiles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinetra.operators import links, pairs, relink


@pytest.fixture
def broken(spark):
    """Two sequences of short tracks at a few places, so that each may go on as several."""
    rows = spark.range(2 * 40).select((F.col("id") % 2).alias("seq_id"), F.floor(F.col("id") / 2).alias("track_id"))
    h = lambda k, m: F.pmod(F.xxhash64("seq_id", "track_id", F.lit(k)), F.lit(m))
    rows = rows.select("*", F.explode(F.sequence(h(1, 50), h(1, 50) + h(2, 4))).alias("frame_idx"), (h(3, 4) * 9.0).alias("x1"), (h(4, 3) * 5.0).alias("y1"), (h(5, 5) - 2.0).alias("v"))
    rows = rows.select("seq_id", "track_id", "frame_idx", (F.col("x1") + F.col("v") * F.col("frame_idx") % 7).alias("x1"), "y1")
    return rows.select("*", (F.col("x1") + 20).alias("x2"), (F.col("y1") + 30).alias("y2"), F.lit(1.0).alias("conf")).cache()


@pytest.mark.parametrize("ids", [lambda o: relink.stitched_ids(o, 60, radius=8.0, near=0.1, ahead=0.1, short=3), lambda o: relink.dormant_ids(o, least=1, most=30)])
def test_merging_takes_few_jobs(spark, broken, ids):
    sc = spark.sparkContext
    sc.setJobGroup("merging", "")
    merged = ids(broken).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("merging"))
    sc.setJobGroup("others", "")
    assert len(merged) == 80 and sum(r.track_id != r.merged_id for r in merged) > 20 and jobs < 12


def test_a_merge_wakes_an_earlier_track(spark):
    """Track 1 turns 2 down, which moves against it; once 2 has gone on as 4 and stands still at last, 1 goes on as both."""
    steps = [(1, f, 100.0 + 2 * f) for f in range(5)] + [(2, f, 112.0 - 2 * (f - 8)) for f in range(8, 17)] + [(4, f, 96.0) for f in range(18, 24)]
    obs = spark.createDataFrame([(0, t, f, x, 0.0, x + 20, 30.0, 1.0) for t, f, x in steps], "seq_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double, conf double")
    rule = {"near": 0.1, "ahead": 0.1, "radius": 20.0, "short": 2, "ratio": 1.6, "speed": 1.0}
    assert [(r.a, r.b) for r in pairs.stitch_candidates(obs, 100, **rule).collect()] == [(2, 4)]
    assert {r.track_id: r.merged_id for r in relink.stitched_ids(obs, 100, **rule).collect()} == {1: 1, 2: 1, 4: 1}


def test_links_by_tiles(spark, broken, monkeypatch):
    ends, told = pairs.ends(broken), ("seq_id", "a", "b", "gap", "dist")
    whole = sorted(map(repr, pairs.global_candidates(broken, 30, 0.01).select(*told).collect()))
    side = lambda s, b, f: ends.select("seq_id", F.col("track_id").alias(s), f, *[F.col(f"{b}_{c}").alias(f"{s}_{c}") for c in pairs.BOX])
    met = side("a", "b1", "f1").join(side("b", "b0", "f0"), "seq_id").where("f0 - f1 between 1 and 31").select("seq_id", "a", "b", (F.expr("f0 - f1 - 1")).alias("gap"), pairs.g.distance("a_", "b_").alias("dist"))
    assert whole == sorted(map(repr, met.where(F.col("dist") <= 0.01 * (1920.0**2 + 1080.0**2) ** 0.5).collect())) != []
    monkeypatch.setattr(pairs, "ENDS", 7)
    again = pairs.global_candidates(broken, 30, 0.01)
    assert whole == sorted(map(repr, again.select(*told).collect()))
    assert "FlatMapGroupsInPandas" in again._jdf.queryExecution().optimizedPlan().toString()


def test_link_candidates_join_no_pairs(spark, broken):
    ends = pairs.ends(broken)
    found = links.link_candidates(ends, 0, 12, 20.0)
    assert "FlatMapGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()
    side = lambda s, b, f: ends.select("seq_id", F.col("track_id").alias(s), f, *[F.col(f"{b}_{c}").alias(f"{s}_{c}") for c in pairs.BOX])
    met = side("a", "b1", "f1").join(side("b", "b0", "f0"), "seq_id").where("a != b and f0 - f1 >= 0 and f0 - f1 < 12 and sqrt((a_x1 - b_x1) * (a_x1 - b_x1) + (a_y1 - b_y1) * (a_y1 - b_y1)) <= 20")
    assert sorted((r.seq_id, r.a, r.b, r.gap) for r in found.collect()) == sorted((r.seq_id, r.a, r.b, r.f0 - r.f1) for r in met.collect()) != []
