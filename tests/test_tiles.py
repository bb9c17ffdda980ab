"""Pairs by tiles against the same from a row for each pair and frame."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinetra.operators import events, features, links, masks, merging, pairs, review, tiles


@pytest.fixture
def boxes(spark, monkeypatch):
    """Two sequences of tracks that come and go, in blocks of a few tracks; two boxes are empty."""
    monkeypatch.setattr(tiles, "TRACKS", 4)
    rows = spark.range(2 * 11 * 25).select((F.col("id") % 2).alias("seq_id"), (F.floor(F.col("id") / 2) % 11).alias("track_id"), F.floor(F.col("id") / 22).alias("frame_idx"))
    h = lambda k: F.pmod(F.xxhash64("seq_id", "track_id", "frame_idx", F.lit(k)), F.lit(1000)) / 1000.0
    rows = rows.where(h(1) < 0.7).where("frame_idx % 9 != 4").select("*", (h(2) * 8).alias("x1"), (h(3) * 4).alias("y1"), h(5).alias("v"))
    empty = F.when(F.expr("track_id in (3, 5) and frame_idx = 7"), 0.0).otherwise(10.0)
    return rows.select("seq_id", "track_id", "frame_idx", "x1", "y1", (F.col("x1") + empty).alias("x2"), (F.col("y1") + empty).alias("y2"), "v").cache()


def same(left, right):
    columns = right.columns
    assert sorted(map(repr, left.select(*columns).collect())) == sorted(map(repr, right.collect())) != []


@pytest.mark.parametrize("at", [events.Thresholds(0.5, 0.3), events.Thresholds(0.4, 0.35, 3)])
def test_events_by_tiles(spark, boxes, at):
    met = pairs.frame_pairs(boxes).select("seq_id", "frame_idx", "a", "b", F.coalesce("iou", F.lit(0.0)).alias("iou"))
    same(events.box_events(boxes, at), events.pair_events(met, boxes, at))
    v = boxes.select("seq_id", F.col("frame_idx").alias("entry_frame"), F.col("track_id").alias("a"), F.col("v").alias("v_a"))
    wanted = events.pair_events(met, boxes, at).join(v, ["seq_id", "entry_frame", "a"]).join(v.withColumnsRenamed({"a": "b", "v_a": "v_b"}), ["seq_id", "entry_frame", "b"])
    same(events.box_events(boxes, at, "v"), wanted)


def test_no_pair_is_shuffled(spark, boxes):
    """A join of boxes with boxes by frame would make a row for each pair."""
    plan = events.box_events(boxes, events.COLLISION)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "< b#" not in plan


@pytest.mark.parametrize("spread", [1, 2])
def test_large_blocks_by_parts(spark, boxes, monkeypatch, spread):
    """However many tracks there are, an observation goes to a few tasks, which take their tracks part by part."""
    monkeypatch.setattr(tiles, "SPREAD", spread)
    assert max(r.blocks for r in tiles._dealt(boxes, 1)[1].collect()) == spread
    at = events.Thresholds(0.4, 0.35, 2)
    met = pairs.frame_pairs(boxes).select("seq_id", "frame_idx", "a", "b", F.coalesce("iou", F.lit(0.0)).alias("iou"))
    same(events.box_events(boxes, at), events.pair_events(met, boxes, at))
    back = boxes.withColumns({"track_id": F.col("track_id") + 100, "x1": F.col("x1") + 1.5})
    votes = pairs.id_votes(boxes, back, 0.5, 4)
    monkeypatch.setattr(tiles, "TRACKS", 1024)
    same(votes, pairs.id_votes(boxes, back, 0.5, 4))


def both_ways(met):
    return met.withColumn("track_id", F.explode(F.array("a", "b"))).drop("a", "b")


def test_coalesced_by_tiles(spark, boxes):
    sizes = boxes.groupBy("seq_id", "track_id").agg(F.count("*").alias("n"))
    met = pairs.overlap_runs(boxes, 0.35, 2).select("seq_id", "a", "b").distinct()
    met = met.join(sizes.withColumnsRenamed({"track_id": "a", "n": "n_a"}), ["seq_id", "a"]).join(sizes.withColumnsRenamed({"track_id": "b", "n": "n_b"}), ["seq_id", "b"])
    same(pairs.coalesced(boxes, 0.35, 2), met.select("seq_id", F.when(F.col("n_a") >= F.col("n_b"), F.col("b")).otherwise(F.col("a")).alias("track_id")).distinct())


def test_votes_by_tiles(spark, boxes):
    back = boxes.withColumns({"track_id": F.col("track_id") + 100, "x1": F.col("x1") + 1.5})
    side = lambda df, s: df.select("seq_id", "frame_idx", F.col("track_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in tiles.BOX])
    met = side(boxes, "a").join(side(back, "b"), ["seq_id", "frame_idx"]).where(pairs.g.iou("a_", "b_") >= 0.5)
    n = met.groupBy("seq_id", F.col("b").alias("backward_id"), "a").agg(F.count("*").alias("n")).where("n >= 4")
    best = n.groupBy("seq_id", "backward_id").agg(F.min(F.struct(-F.col("n"), "a")).alias("m"))
    same(pairs.id_votes(boxes, back, 0.5, 4), best.select("seq_id", "backward_id", F.col("m.a").alias("forward_id"), (-F.col("m.col1")).alias("votes")))


def test_coexisting_by_tiles(spark, boxes):
    size = F.when((pairs.g.height("a_") > 0) & (pairs.g.height("b_") > 0), F.greatest(pairs.g.height("a_"), pairs.g.height("b_")) / F.least(pairs.g.height("a_"), pairs.g.height("b_")))
    taller = boxes.withColumn("y2", F.col("y2") + F.col("v") * 8)
    side = lambda s: taller.select("seq_id", "frame_idx", F.col("track_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in tiles.BOX])
    close = pairs.g.distance("a_", "b_") <= 0.5 * F.greatest(pairs.g.height("a_"), pairs.g.height("b_"), F.lit(1.0))
    met = side("a").join(side("b"), ["seq_id", "frame_idx"]).where("a < b").groupBy("seq_id", "a", "b")
    told = met.agg(F.count("*").alias("shared"), F.avg(close.cast("double")).alias("close"), F.avg(F.coalesce(pairs.g.iou("a_", "b_"), F.lit(0.0))).alias("m"), F.median(size).alias("r"))
    told = told.where("shared >= 8 and close >= 0.6 and m >= 0.35 and r <= 1.3").select("seq_id", "a", "b", "shared", "close", F.round("m", 6).alias("mean_iou"))
    same(pairs.coexisting(taller, 8, 0.6, 1.3, 0.35).withColumn("mean_iou", F.round("mean_iou", 6)), told)


@pytest.mark.parametrize("tried", [1, 16])
def test_clusters_and_isolated(spark, boxes, monkeypatch, tried):
    monkeypatch.setattr(tiles, "NEIGHBOURS", tried)
    monkeypatch.setattr(tiles, "STRIPE", 3)
    met = both_ways(pairs.frame_pairs(boxes).select("seq_id", "frame_idx", "a", "b", "iou", "dist"))
    keys = ["seq_id", "frame_idx", "track_id"]
    same(pairs.overlap_clusters(boxes, 0.6), boxes.join(met.where("iou >= 0.6"), keys, "left_semi").select(*boxes.columns))
    near = boxes.join(met.groupBy(*keys).agg(F.min("dist").alias("d")), keys, "left").where("d is null or d > 0.2 * (y2 - y1)")
    same(review.isolated(boxes, 0.2), near.select("seq_id", "track_id", "frame_idx", "d"))
    one = boxes.where("track_id = 1")
    same(review.isolated(one, 0.2), one.select("seq_id", "track_id", "frame_idx", F.lit(None).cast("double").alias("d")))


def test_anchors_by_stripes(spark, boxes, monkeypatch):
    monkeypatch.setattr(tiles, "STRIPE", 3)
    anchors = boxes.select(F.concat_ws("-", "seq_id", "track_id", "frame_idx").alias("anchor_id"), "seq_id", "frame_idx", (F.col("x1") * 4).alias("x"), (F.col("y1") * 5).alias("y"))
    anchors = anchors.unionByName(anchors.limit(1).withColumns({"anchor_id": F.lit("none"), "frame_idx": F.lit(999).cast("long")})).cache()
    inside = F.expr("x between x1 and x2 and y between y1 and y2")
    dist = F.expr("sqrt(pow((x1 + x2) / 2 - x, 2) + pow((y1 + y2) / 2 - y, 2))")
    best = F.struct((~inside).alias("out"), F.when(inside, F.expr("(x2 - x1) * (y2 - y1)")).otherwise(dist).alias("size"), "track_id")
    found = anchors.join(boxes, ["seq_id", "frame_idx"]).where(inside | (dist <= 7)).groupBy("anchor_id").agg(F.min(best).alias("m"))
    same(review.anchor_tracks(boxes, anchors, 7.0), anchors.join(found, "anchor_id", "left").select("anchor_id", "m.track_id", (~F.col("m.out")).alias("inside")))


def test_followed_one_after_another(spark, boxes, monkeypatch):
    monkeypatch.setattr(tiles, "STRIPE", 3)
    was = boxes.select("seq_id", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("track_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in tiles.BOX])
    met = boxes.select("seq_id", "frame_idx", F.col("track_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in tiles.BOX]).join(was, ["seq_id", "frame_idx"])
    met = met.select("seq_id", "frame_idx", "a", "b", pairs.g.iou("a_", "b_").alias("iou")).where("iou >= 0.3")
    taken, told = set(), []
    for r in sorted(met.collect(), key=lambda r: (r.seq_id, r.frame_idx, r.a, -r.iou, r.b)):
        if not {(r.seq_id, r.frame_idx, "a", r.a), (r.seq_id, r.frame_idx, "b", r.b)} & taken:
            taken |= {(r.seq_id, r.frame_idx, "a", r.a), (r.seq_id, r.frame_idx, "b", r.b)}
            told.append(r)
    assert sorted(map(repr, links.followed_boxes(boxes).select(*met.columns).collect())) == sorted(map(repr, told)) != []


def test_frames_make_no_pairs(spark, boxes):
    for df in (pairs.overlap_clusters(boxes, 0.6), review.isolated(boxes, 0.2), features.spacing_error(boxes, 3, 2.0)):
        assert "PandasGroup" in (plan := df._jdf.queryExecution().optimizedPlan().toString()).replace("FlatMapGroupsInPandas", "PandasGroup") and "Join Inner" not in plan


def test_enrolment_by_frames(spark, boxes):
    d = pairs.frame_pairs(boxes).where("frame_idx % 2 = 0 and frame_idx < 20").groupBy("seq_id", "frame_idx").agg(F.min("dist").alias("d"))
    scored = d.join(boxes.groupBy("seq_id", "frame_idx").agg(F.count("*").alias("n")), ["seq_id", "frame_idx"]).where("d >= 0.1").withColumn("score", F.round(F.col("d") * F.col("n"), 6))
    best = scored.groupBy("seq_id").agg(F.max(F.struct("score", -F.col("frame_idx"), "n")).alias("m"))
    same(review.enrolment_frame(boxes, 2, 20, 0.1), best.select("seq_id", (-F.col("m.col2")).alias("frame_idx"), "m.n", "m.score"))


def test_groups_from_few_links(spark, boxes):
    at = events.Thresholds(0.4, 0.35, 2)
    few = events.box_events(boxes, at, linked=True)
    same(events.coalescence_groups(few), events.coalescence_groups(events.box_events(boxes, at)))
    one = boxes.withColumns({"x1": F.lit(0.0), "y1": F.lit(0.0), "x2": F.lit(9.0), "y2": F.lit(9.0)}).where("track_id < 4 and seq_id = 0 and frame_idx < 2").withColumn("frame_idx", F.lit(1)).dropDuplicates(["track_id"])
    n = one.count()
    assert events.box_events(one, events.COLLISION, linked=True).count() == n - 1 < events.box_events(one, events.COLLISION).count() == n * (n - 1) // 2


def test_groups_take_one_job(spark, boxes):
    """Rounds over a table of links would write one for each round."""
    links = events.box_events(boxes, events.Thresholds(0.4, 0.35, 2), linked=True)
    plan = events.coalescence_groups(links)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 2 and "Join Inner, ((at" not in plan and "LogicalRDD" not in plan


@pytest.mark.parametrize("least", [1, 3])
def test_runs_by_tiles(spark, boxes, least):
    """Runs from a row for each pair and frame, numbered among the frames that there are."""
    place = {(s, f): k for s in (0, 1) for k, f in enumerate(sorted(r.frame_idx for r in boxes.where(F.col("seq_id") == s).select("frame_idx").distinct().collect()))}
    met, told = {}, []
    for r in pairs.frame_pairs(boxes).where("iou > 0.35").collect():
        met.setdefault((r.seq_id, r.a, r.b), []).append(r.frame_idx)
    for (s, a, b), at in met.items():
        run = []
        for f in [*sorted(at), None]:
            if run and (f is None or place[s, f] != place[s, run[-1]] + 1):
                told += [(s, a, b, run[0], run[-1], len(run))] if len(run) >= least else []
                run = []
            run.append(f)
    found = pairs.overlap_runs(boxes, 0.35, least)
    assert sorted(map(tuple, found.select("seq_id", "a", "b", "run_start", "run_end", "run_len").collect())) == sorted(told) != []
    assert "< b#" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("spread", [1, 6])
def test_features_of_all_pairs(spark, boxes, monkeypatch, spread):
    """However far apart in time and place: each two tracks that share a frame, and each track with all that start after its end."""
    monkeypatch.setattr(tiles, "SPREAD", spread)
    short = boxes.withColumn("track_id", F.col("track_id") * 100 + F.floor(F.col("frame_idx") / 7)).withColumn("y2", F.col("y2") + F.col("v") * 8).cache()
    ends = short.groupBy("seq_id", "track_id").agg(F.min("frame_idx").alias("f0"), F.max("frame_idx").alias("f1"))
    later = ends.select("seq_id", F.col("track_id").alias("a"), "f1").join(ends.select("seq_id", F.col("track_id").alias("b"), "f0"), "seq_id").where("f0 > f1").select("seq_id", "a", "b")
    wanted = features.pair_features(short, 25, merging.kept_apart(short).unionByName(later))
    near = lambda df: df.select("seq_id", "a", "b", *[F.round(c, 7).alias(c) for c in ("gap", "max_iou", "distance", "apart", "lengths", "shared", "prior")])
    found = features.all_pair_features(short, 25)
    same(near(found), near(wanted))
    assert found.where("apart = 1").count() == later.count() > 0 and "Join Inner, ((seq_id" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_masks_by_tiles(spark, monkeypatch):
    """Runs of three tracks in a frame; a join of runs with runs would be broadcast or make a row for each two of a row."""
    monkeypatch.setattr(tiles, "TRACKS", 1)
    runs = spark.createDataFrame([(0, 5, 1, 0, 0, 10), (0, 5, 1, 1, 0, 4), (0, 5, 2, 0, 6, 16), (0, 5, 2, 1, 2, 3), (0, 5, 3, 1, 4, 9), (0, 6, 3, 0, 0, 9)], "seq_id long, frame_idx long, track_id long, y long, x0 long, x1 long")
    found = masks.overlaps(runs)
    assert [tuple(r) for r in found.collect()] == [(0, 5, 1, 2, 5, 5 / 20, 5 / 14, 5 / 11)]
    assert "Inner, (((seq_id" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "FlatMapGroupsInPandas" in plan
