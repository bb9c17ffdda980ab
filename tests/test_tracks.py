"""Hand-made cases of track operators."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from kinetra.operators import evaluate, grouped, motion, pairs, pose, prune, relink, review, tracks
from kinetra.sources import documents, mot

SCHEMA = "seq_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double, conf double"


def box(track, frame, x=0.0, y=0.0, w=10.0, h=20.0, conf=0.9, seq=0):
    return (seq, track, frame, x, y, x + w, y + h, conf)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_reverse_remap(spark):
    obs = spark.createDataFrame([box(1, 0), box(1, 1)], SCHEMA)
    assert rows(tracks.reverse(obs, 10), "frame_idx") == [(8,), (9,)]


def test_swap_interval(spark):
    obs = spark.createDataFrame([box(1, f, x=1.0) for f in range(3)] + [box(2, f, x=50.0) for f in range(3)], SCHEMA)
    got = rows(tracks.swap_interval(obs, 1, 2, 0, 1), "track_id", "frame_idx", "x1")
    assert got == [(1, 0, 50.0), (1, 1, 50.0), (1, 2, 1.0), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 50.0)]


def test_lifecycle_and_islands(spark):
    obs = spark.createDataFrame([box(1, 0), box(1, 1), box(1, 5)], SCHEMA)
    assert [s for _, s in rows(tracks.lifecycle(obs, 8, 2), "frame_idx", "state")] == ["ACTIVE", "ACTIVE", "DORMANT", "DORMANT", "LOST", "ACTIVE", "DORMANT", "DORMANT"]
    assert rows(tracks.presence_islands(obs), "run_start", "run_end", "run_len") == [(0, 1, 2), (5, 5, 1)]


FRAME = prune.Frame(1000.0, 1000.0, 1000)


def hits(obs, rule, frame=FRAME):
    return [t for (t,) in rows(prune.hits(prune.facts(obs, frame), rule), "track_id")]


def test_survival_takes_both_axes_and_the_groups_height(spark):
    still = [box(1, f, x=100.0) for f in range(400)]
    # Both axes move by a deviation of 0.3: together 0.42, over 0.02 times the group's height of 20, either alone is not.
    wobble = [box(2, f, x=100.0 + 0.6 * (f % 2), y=0.6 * (f % 2)) for f in range(400)]
    large = [box(3, f, x=float(f), h=2000.0) for f in range(40)]  # does not last, so its height does not count
    got = rows(tracks.survival(spark.createDataFrame(still + wobble + large, SCHEMA), 1000), "track_id", "lasts", "survives", "median_h")
    assert got == [(1, True, False, 20.0), (2, True, True, 20.0), (3, False, False, 20.0)]
    alone = spark.createDataFrame([box(1, 1200), box(1, 1201)], SCHEMA)
    assert rows(tracks.survival(alone, 1000), "lasts", "survives", "median_h") == [(False, False, None)]


def test_short_track_is_pruned(spark):
    obs = spark.createDataFrame([box(1, 0)] + [box(2, f, x=float(f)) for f in range(900)], SCHEMA)
    assert hits(obs, prune.short_lived()) == [1]


def test_short_tracks_at_the_edge_may_stay(spark):
    inner = [box(1, f, x=500.0, y=500.0) for f in range(100)]
    enters = [box(2, f, x=10.0 + f - 500, y=500.0) for f in range(500, 600)]  # from the left, inwards, 100 of 500 possible frames
    leaves = [box(3, f, x=60.0 - 0.5 * f + 250, y=500.0) for f in range(500, 600)]
    cut_off = [box(4, f, x=10.0, y=500.0) for f in range(980, 1000)]
    top = [box(5, f, x=500.0, y=0.0) for f in range(500, 600)]  # at the top edge, but not moving in from a side
    obs = spark.createDataFrame(inner + enters + leaves + cut_off + top, SCHEMA)
    assert hits(obs, prune.short_share(FRAME)) == [1, 3, 5]
    assert hits(obs, prune.late_and_short(FRAME)) == []


def test_outliers_in_front_and_on_their_way(spark):
    group = [box(t, f, x=500.0 + t, y=300.0, h=100.0) for t in range(1, 7) for f in range(8)]
    obs = spark.createDataFrame(group + [box(7, f, x=620.0, y=300.0, h=100.0) for f in range(8)], SCHEMA)
    assert hits(obs, prune.spatial_outliers(FRAME)) == [7]  # 115 of a spread of 50
    front = spark.createDataFrame([(*r[:4], r[4] + 400, r[5], r[6] + 400, r[7]) for r in group] + [box(7, f, x=620.0, y=700.0, h=100.0) for f in range(8)], SCHEMA)
    assert hits(front, prune.spatial_outliers(FRAME)) == []  # 2.5 deviations are allowed in front
    comes = spark.createDataFrame(group + [box(7, f, x=720.0 - 30 * f if f > 5 else 640.0, y=300.0, h=100.0) for f in range(8)], SCHEMA)
    assert hits(comes, prune.spatial_outliers(FRAME)) == []
    tall = spark.createDataFrame([box(t, f, h=100.0) for t in (1, 2, 3) for f in range(3)] + [box(4, f, y=700.0, h=220.0) for f in range(3)] + [box(5, f, h=220.0) for f in range(3)], SCHEMA)
    assert hits(tall, prune.size_outliers(FRAME)) == [5]


def test_votes_need_more_than_the_limit(spark):
    facts = spark.createDataFrame([(0, 1, True, False), (0, 2, False, True), (0, 3, True, True), (0, 4, False, False)], "seq_id long, track_id long, a boolean, b boolean")
    rules = {"low_sync": lambda alive: F.col("a"), "jitter": lambda alive: F.col("b")}
    got = prune.votes(facts, rules)
    assert rows(got, "track_id", "hits", "votes") == [(1, "low_sync", 0.7), (2, "jitter", 0.5), (3, "low_sync,jitter", 1.2), (4, "", 0.0)]


def test_chain_judges_what_is_left(spark):
    obs = spark.createDataFrame([box(t, f) for t in (1, 2, 3) for f in range(3)], SCHEMA)
    smallest = lambda alive: F.col("track_id") == F.min(F.when(alive, F.col("track_id"))).over(prune.Window.partitionBy("seq_id"))
    got = prune.pruned(prune.facts(obs, FRAME), {"a": lambda alive: F.col("track_id") == 1, "b": smallest, "c": smallest})
    assert rows(got, "rule", "track_id") == [("a", 1), ("b", 2), ("c", 3)]


def test_scans_do_not_grow_with_the_rules(spark, tmp_path):
    spark.createDataFrame([box(1, 0)], SCHEMA).write.parquet(str(tmp_path / "o"))
    facts = prune.facts(spark.read.parquet(str(tmp_path / "o")), FRAME)
    rules = {f"r{k}": prune.spatial_outliers(FRAME) for k in range(6)}
    scans = [prune.pruned(facts, dict(list(rules.items())[:n]))._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for n in (1, 6)]
    assert scans[0] == scans[1] <= 4


def test_dormant_relink(spark):
    obs = spark.createDataFrame([box(1, 9), box(1, 10), box(2, 102)], SCHEMA)
    assert rows(pairs.dormant_candidates(obs), "a", "b", "gap") == [(1, 2, 91)]
    near = spark.createDataFrame([box(1, 9), box(1, 10), box(2, 101)], SCHEMA)
    assert rows(pairs.dormant_candidates(near), "a") == []
    # 0.1 pixels a frame for 92 frames: the box is met where the velocity leads, not where it was last seen.
    moving = spark.createDataFrame([box(1, 9, x=0.0), box(1, 10, x=1.0), box(2, 102, x=93.0), box(3, 102, x=1.0)], SCHEMA)
    assert rows(pairs.dormant_candidates(moving), "a", "b") == [(1, 2)]
    assert rows(relink.dormant_ids(moving), "track_id", "merged_id") == [(1, 1), (2, 1), (3, 3)]


def test_stitching_follows_the_velocity_and_goes_on(spark):
    runs = [box(1, f, x=10.0 * f, h=40.0) for f in range(10)] + [box(2, f, x=10.0 * f, h=40.0) for f in range(40, 50)] + [box(3, f, x=10.0 * f, h=40.0) for f in range(60, 70)]
    other = [box(4, f, x=10.0 * f, h=80.0) for f in range(15, 20)] + [box(5, f, x=900.0, y=900.0, h=40.0) for f in range(12, 20)]
    obs = spark.createDataFrame(runs + other, SCHEMA)
    assert (1, 2) in rows(pairs.stitch_candidates(obs, 100), "a", "b") and not {(1, 4), (1, 5)} & set(rows(pairs.stitch_candidates(obs, 100), "a", "b"))
    ids = relink.stitched_ids(obs, 100)
    assert rows(ids, "track_id", "merged_id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    whole = rows(relink.renamed(obs, ids, 60), "track_id", "frame_idx")
    assert [f for t, f in whole if t == 1] == list(range(70))


def test_documents_are_written_in_parts_and_read_by_sequence(spark, tmp_path):
    schema = "seq_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double, conf double"
    rows_ = [(s, t, f, 1.5 * f, 0.0, 1.5 * f + 10, float("inf") if (s, t, f) == (3, 1, 7) else 20.0, float("nan") if f == 2 else 0.5) for s in (3, 4) for t in (1, 2) for f in (0, 2, 7, 9)]
    docs = documents.documents(spark.createDataFrame(rows_, schema), 10, part=4)
    documents.write_documents(docs, str(tmp_path / "d"))
    back = documents.read_documents(spark, str(tmp_path / "d"))
    assert back.count() == 6
    one = documents.parsed(back.where("seq_id = 3"), "seq_id")
    assert "PartitionFilters: [isnotnull(seq_id" in one._jdf.queryExecution().executedPlan().toString()
    assert rows(one, "frame_idx") == [(f,) for f in range(10)]
    got = rows(documents.observations(one, "seq_id"), "track_id", "frame_idx", "conf")
    assert got == [(t, f, 1.0 if f == 2 else 0.5) for t in (1, 2) for f in (0, 2, 7, 9) if (t, f) != (1, 7)]
    # A part whose arrays do not fit its counts gives nothing.
    parts = documents.packed(spark.createDataFrame(rows_, schema), 10, 4)
    assert documents.unpacked(parts).count() == 16
    assert documents.unpacked(parts.withColumn("ids", F.when(F.col("part") == 0, F.array(F.lit(1).cast("long"))).otherwise(F.col("ids")))).count() == 8


def test_passes_are_merged(spark):
    forward = spark.createDataFrame([box(1, f) for f in range(6)], SCHEMA)
    back = spark.createDataFrame([box(9, f, conf=0.4) for f in range(2, 9)] + [box(7, f, x=500.0) for f in range(2)], SCHEMA)
    got = rows(pairs.merged_passes(forward, back), "track_id", "frame_idx", "conf")
    assert got == [(1, f, 0.9) for f in range(6)] + [(1, f, 0.4) for f in (6, 7, 8)] + [(2, 0, 0.9), (2, 1, 0.9)]


def test_visibility_falls_only_beyond_the_limit(spark):
    obs = spark.createDataFrame([box(1, 0, w=10.0, h=20.0), box(2, 0, x=5.0, w=10.0, h=30.0), box(3, 1, w=10.0, h=20.0), box(4, 1, x=1.0, w=30.0, h=30.0)], SCHEMA)
    assert rows(review.visibility(obs), "track_id", "hidden", "visible") == [(1, False, 1.0), (2, False, 1.0), (3, True, pytest.approx(0.1)), (4, False, 1.0)]


def test_lifecycle_of_a_track_past_the_end(spark):
    obs = spark.createDataFrame([box(1, 63), box(2, 58)], SCHEMA)
    assert rows(tracks.lifecycle(obs, 60, 3), "track_id", "frame_idx", "state") == [(2, 58, "ACTIVE"), (2, 59, "DORMANT")]
    assert rows(review.held(obs, 60), "track_id", "frame_idx") == [(2, 58), (2, 59)]


def test_composite_score(spark):
    one = lambda *v: spark.range(1).select(evaluate.composite(*[F.lit(x) for x in v]).alias("s")).first()["s"]
    assert one(0.6, 0.8, 0.5, 5, 10, 100) == pytest.approx(0.45 * 0.6 + 0.25 * 0.8 + 0.2 * 0 + 0.1 * 0)
    assert one(0.6, 0.0, 0.5, 1, 2, 100) == pytest.approx(0.27 + 0.125 + 0.2 * 0.8 + 0.1 * 0.8)
    assert one(0.6, None, None, 0, 0, 0) == pytest.approx(0.27 + 0.15 + 0.3)


def test_hota_and_identity(spark):
    obs = spark.createDataFrame([box(1, f) for f in range(6)] + [box(2, f, x=100.0) for f in range(6)], SCHEMA)
    perfect = evaluate.hota(obs, obs).first()
    assert (perfect["hota"], perfect["det_a"], perfect["ass_a"]) == pytest.approx((1.0, 1.0, 1.0))
    swapped = tracks.swap_interval(obs, 1, 2, 3, 5)
    # Each of four pairs has 3 of 6 + 6 - 3 frames: association 1/3 for every match.
    got = evaluate.hota(obs, swapped).first()
    assert (got["det_a"], got["ass_a"], got["hota"]) == pytest.approx((1.0, 1 / 3, (1 / 3) ** 0.5))
    name = evaluate.identity(obs, swapped).first()
    assert (name["idtp"], name["idfn"], name["idfp"], name["idf1"]) == (6, 6, 6, 0.5)
    assert evaluate.identity(obs, obs.limit(0)).first()["idtp"] == 0 and evaluate.hota(obs, obs.limit(0)).first()["hota"] == 0


def test_ambiguous_matches_are_assigned(spark):
    ref = spark.createDataFrame([box(1, 0), box(2, 0, x=2.0)], SCHEMA)
    found = spark.createDataFrame([box(11, 0, x=1.0), box(12, 0, x=-1.0)], SCHEMA)
    assert rows(grouped.match_frames(ref, found), "ref_id", "found_id") == [(1, 12), (2, 11)]


def test_savgol_keeps_a_cubic_and_smooths():
    x = np.arange(30.0)
    cubic = 0.01 * x**3 - 0.2 * x**2 + x
    assert np.allclose(grouped.savgol(cubic), cubic)
    noise = np.where(np.arange(30) % 2, 1.0, -1.0)
    assert np.abs(grouped.savgol(noise)[6:-6]).max() < 0.5


def test_mot_files_round_trip(spark, tmp_path):
    obs = spark.createDataFrame([box(t, f, x=1.25 * t, seq=s) for s in (0, 1) for t in (1, 2) for f in (3, 0)], SCHEMA)
    mot.write_mot(obs, str(tmp_path / "m"))
    back = mot.read_mot(spark, str(tmp_path / "m"))
    key = ("track_id", "frame_idx", "x1", "y1", "x2", "y2", "conf")
    assert rows(back.withColumn("seq_id", F.col("seq_id").cast("long")), "seq_id", *key) == rows(obs, "seq_id", *key)
    lines = [line for part in sorted((tmp_path / "m" / "seq_id=0").glob("part-*")) for line in part.read_text().splitlines()]
    assert [line.split(",")[:2] for line in lines] == [["1", "1"], ["1", "2"], ["4", "1"], ["4", "2"]]
    odd = spark.createDataFrame([("",), ("1,2",), ("x,1,2,3,4,5",), (None,), ("2, 7, 1,2,3,4",)], "value string")
    assert rows(mot.parse_mot(odd), *key) == [(7, 1, 1.0, 2.0, 4.0, 6.0, 1.0)]


def test_frames_json_is_dense_and_without_nan(spark):
    obs = spark.createDataFrame([box(3, 1, conf=float("nan"))], SCHEMA)
    got = rows(mot.frames_json(obs, 3), "frame_idx", "value")
    assert [v for _, v in got] == ['{"frame_idx":0,"tracks":{}}', '{"frame_idx":1,"tracks":{"3":{"box":[0.0,0.0,10.0,20.0],"confidence":null}}}', '{"frame_idx":2,"tracks":{}}']
    assert rows(mot.parse_frames_json(mot.frames_json(obs, 3)), "track_id", "frame_idx", "conf") == [(3, 1, 1.0)]


KP = "seq_id long, track_id long, frame_idx long, j int, x double, y double, s double"


def test_shoulder_angle_is_to_the_middle_of_the_hips(spark):
    at = {5: (0.0, 0.0), 7: (0.0, -1.0), 11: (-1.0, 2.0), 12: (1.0, 2.0)}
    kp = spark.createDataFrame([(0, 1, 0, j, *at.get(j, (float(j), 9.0)), 0.9) for j in range(17)], KP)
    got = {r["joint"]: r["angle"] for r in pose.joint_angles(kp).collect()}
    assert got["left_shoulder"] == pytest.approx(180.0) and set(got) == set(pose.ANGLES)
    unsure = kp.withColumn("s", F.when(F.col("j") == 12, 0.1).otherwise(F.col("s")))
    assert {r["joint"] for r in pose.joint_angles(unsure).where("angle is null").collect()} == {"left_shoulder", "right_shoulder", "right_knee"}


def test_sanitise_drops_poses_by_the_head_and_limbs_by_score(spark):
    boxes = spark.createDataFrame([box(1, 0), box(2, 0)], SCHEMA)
    kp = spark.createDataFrame([(0, 1, 0, 0, 5.0, 5.0, 0.9), (0, 1, 0, 9, 50.0, 5.0, 0.9), (0, 1, 0, 10, 50.0, 5.0, 0.05), (0, 2, 0, 0, 50.0, 5.0, 0.9), (0, 2, 0, 9, 5.0, 5.0, 0.9)], KP)
    assert rows(motion.sanitised(kp, boxes), "track_id", "j", "s") == [(1, 0, 0.9), (1, 9, 0.0), (1, 10, 0.05)]


def test_coalesced_keeps_the_longer(spark):
    obs = spark.createDataFrame([box(1, f) for f in range(5)] + [box(2, f) for f in range(4)], SCHEMA)
    assert rows(pairs.coalesced(obs, 0.7, 4), "track_id") == [(2,)]


def test_merge_keeps_the_first_pass(spark):
    a, b = spark.createDataFrame([box(1, 0, conf=0.95)], SCHEMA), spark.createDataFrame([box(1, 0, conf=0.5), box(1, 1, conf=0.5)], SCHEMA)
    assert rows(pairs.merge_keep_first(a, b), "frame_idx", "conf") == [(0, 0.95), (1, 0.5)]


def test_perfect_and_swapped_tracking(spark):
    obs = spark.createDataFrame([box(1, f) for f in range(6)] + [box(2, f, x=100.0) for f in range(6)], SCHEMA)
    perfect = evaluate.clear(obs, obs, grouped.match_frames(obs, obs)).first()
    assert (perfect["mota"], perfect["id_switches"], perfect["fn"], perfect["fp"]) == (1.0, 0, 0, 0)
    swapped = tracks.swap_interval(obs, 1, 2, 3, 5)
    assert evaluate.clear(obs, swapped, grouped.match_frames(obs, swapped)).first()["id_switches"] == 2


def test_nms_and_empty(spark):
    obs = spark.createDataFrame([box(1, 0, conf=0.9), box(2, 0, x=1.0, conf=0.8), box(3, 0, x=100.0, conf=0.1)], SCHEMA)
    assert rows(grouped.nms(obs, 0.5), "track_id") == [(1,), (3,)]
    assert grouped.nms(obs.limit(0), 0.5).count() == 0


def test_mot_line(spark):
    obs = spark.createDataFrame([(0, 3, 0, 1.0, 2.0, 11.0, 22.0, 0.5)], SCHEMA)
    assert rows(tracks.mot_lines(obs), "line") == [("1,3,1.00,2.00,10.00,20.00,0.5000,1,1",)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms())
def test_assignment_is_optimal(n, m, random):
    from itertools import permutations

    cost = np.array([[random.randint(0, 9) for _ in range(m)] for _ in range(n)], dtype=float)
    got = grouped.assign(cost)
    total = sum(cost[i, j] for i, j in got)
    small, large = (cost, m) if n <= m else (cost.T, n)
    best = min(sum(small[i, j] for i, j in enumerate(p)) for p in permutations(range(large), min(n, m)))
    assert len(got) == min(n, m) and total == pytest.approx(best)


def test_warping_and_lag():
    a = np.sin(np.arange(30) / 3)
    assert grouped.warping(a, a) == 0
    assert grouped.best_lag(np.roll(a, 2), a) == 2
    assert grouped.best_lag(np.ones(5), a[:5]) == 0


def test_bones_come_to_their_lengths():
    rng = np.random.default_rng(3)
    pose_, bones = rng.normal(size=(17, 2)) * 50, [(5, 7), (7, 9), (11, 13), (13, 15), (5, 6)]
    fixed = grouped.bone_lengths(pose_, bones, np.array([30.0, 25.0, 40.0, 35.0, 20.0]), 200)
    assert [float(np.linalg.norm(fixed[i] - fixed[j])) for i, j in bones] == pytest.approx([30.0, 25.0, 40.0, 35.0, 20.0], abs=1e-3)
    assert np.allclose((fixed[11] + fixed[12]) / 2, (pose_[11] + pose_[12]) / 2)


def test_groups_reach_along_chains(spark):
    from kinetra.operators import graph

    links = spark.createDataFrame([(0, k, k + 1) for k in range(20)] + [(0, 40, 30), (1, 5, 4), (1, 7, 7)], "seq_id long, a long, b long")
    got = rows(graph.groups(links), "seq_id", "node", "root")
    assert got == [(0, k, 0) for k in range(21)] + [(0, 30, 30), (0, 40, 30), (1, 4, 4), (1, 5, 4)]


def test_info_rounds_the_double_not_its_text(spark):
    facts = spark.createDataFrame([(1, 2, 3, 0, 9, 50.0, 60.0, 10.0, 224.95 - 100.0)], "seq_id long, track_id long, n long, f0 long, f1 long, mx double, my double, mw double, mh double")
    assert prune.info(facts, prune.Frame(320.0, 320.0, 60)).first().median_h == 125.0


def test_bones_of_many_poses_at_once():
    """Poses side by side as each alone, also where two joints of one lie on each other."""
    rng = np.random.default_rng(3)
    bones, poses = [(5, 7), (7, 9), (5, 6), (11, 12)], rng.normal(size=(6, 17, 2)) * 100
    poses[2, 7] = poses[2, 5]
    lengths = rng.uniform(10, 60, (6, 4))
    many = grouped.bone_lengths(poses, bones, lengths)
    assert np.allclose(many, [grouped.bone_lengths(p, bones, n) for p, n in zip(poses, lengths, strict=True)])
