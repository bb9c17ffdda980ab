"""Links taken in turn in a task against the same from a table of all links."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinetra.operators import features, links as links_, merging, pairs, turns


@pytest.fixture
def broken(spark):
    """Three sequences of short tracks, some with holes, at places of which many are equally far apart."""
    h = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))
    rows = spark.range(3 * 70).select((F.col("id") % 3).alias("seq_id"), F.col("id").alias("track_id"), h(1, 50).alias("first"), (h(2, 12) + 1).alias("n"), (h(3, 9) * 4.0).alias("x1"), (h(4, 5) * 4.0).alias("y1"))
    rows = rows.withColumn("frame_idx", F.explode(F.expr("sequence(first, first + n)"))).where("frame_idx = first or (frame_idx + track_id) % 3 > 0")
    return rows.select("seq_id", "track_id", "frame_idx", "x1", "y1", (F.col("x1") + 4 + F.col("frame_idx") % 2).alias("x2"), (F.col("y1") + 8).alias("y2")).cache()


def links(obs, most, far):
    return pairs.global_candidates(obs, most, far, (1.0, 0.0))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("pairs_at_once", "kept"), [(1 << 21, 1 << 21), (40, 25)])
def test_merged_near(spark, broken, pairs_at_once, kept):
    weighed = links(broken, 8, 9.0).select("seq_id", "a", "b", (-F.floor(F.col("dist") * 4)).alias("weight"))
    want = rows(merging.merged_apart(broken.select("seq_id", F.col("track_id").alias("node")), weighed, merging.kept_apart(broken)).select("seq_id", "node", "root"))
    assert rows(turns.merged_near(broken, 8, 9.0, 4.0, pairs_at_once, kept)) == rows(turns.merged_links(broken, weighed)) == want
    assert any(n != r for _, n, r in want)


def test_layers_near(spark, broken):
    want = rows(merging.layers(links(broken, 8, 9.0), broken.select("seq_id", F.col("track_id").alias("node"))).select("seq_id", "node", "layer"))
    assert rows(turns.layers_near(broken, 8, 9.0, 40)) == want
    assert max(r[2] for r in want) > 2


def test_no_table_of_links_or_of_pairs(broken):
    for made in (turns.merged_near(broken, 8, 9.0), turns.layers_near(broken, 8, 9.0)):
        assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("least", [0.4, 0.55])
def test_merged_by_prior(broken, least):
    """Likely pairs give what all pairs give, with those that share a frame; at 0.55 no pair that shares none can be likely."""
    all_ = merging.kept_apart(broken).unionByName(links(broken, 8, 9.0).select("seq_id", "a", "b"))
    made = features.likely(broken, 60, 8, 9.0, least)
    got = rows(features.merged_by_prior(broken, 60, made, least))
    assert got == rows(features.merged_by_prior(broken, 60, all_, least))
    assert any(n != r for _, n, r in got) == (least < 0.5)
    assert (made.count() == 0) == (least > 0.5)


def test_taken_near(broken):
    """In order of ids from the cells around each end as from a table of all candidates; many starts are equally far."""
    ends = pairs.ends(broken)
    forward = ends.select("seq_id", "track_id", "f0", "f1", (F.col("f1") < 55).alias("dormant"))
    place = lambda box: [pairs.g.cx(f"{box}_").alias("x"), pairs.g.cy(f"{box}_").alias("y")]
    ended = ends.where("f1 < 55").select("seq_id", F.col("track_id").alias("a"), F.col("f1").alias("end"), *place("b1"))
    starts = ends.select("seq_id", (F.col("track_id") + 1000).alias("b"), "f0", F.col("f1").alias("b_f1"), *place("b0"))
    far = F.sqrt(F.pow(F.col("x") - F.col("bx"), F.lit(2)) + F.pow(F.col("y") - F.col("by"), F.lit(2)))
    met = ended.join(starts.withColumnsRenamed({"x": "bx", "y": "by"}), "seq_id").select("seq_id", "a", "b", (F.col("f0") - F.col("end")).alias("gap"), (1 / (1 + far / 20)).alias("sim"), "b_f1")
    want = rows(links_.forward_reverse(forward, met, 10, 0.7).na.fill(-1))
    assert rows(links_.gone_on(forward, turns.taken_near(ended, starts, 10, 20.0, 0.7)).na.fill(-1)) == want
    assert sum(r[2] >= 0 for r in want) > 20
