"""Poses next to an event against the same chosen among all of a track's."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinetra.operators import audit


@pytest.mark.parametrize("earlier", [True, False])
def test_frames_next_to_an_event(spark, earlier):
    """The last three before it, or the first three from it on, without a row for each event and frame of a track."""
    frames = spark.range(60).select((F.col("id") % 2).alias("track_id"), F.floor(F.col("id") * 1.7).alias("frame_idx"))
    asked = spark.range(40).select(F.col("id").alias("event"), (F.col("id") % 3).alias("track_id"), (F.col("id") * 7 % 110 - 3).alias("at"))
    found = audit._next_to(asked, frames, ["track_id"], "at", 3, earlier)
    known, want = {}, []
    for r in frames.collect():
        known.setdefault(r.track_id, []).append(r.frame_idx)
    for r in asked.collect():
        near = sorted(f for f in known.get(r.track_id, []) if (f < r.at if earlier else f >= r.at))
        want += [(r.event, r.track_id, r.at, f) for f in (near[-3:] if earlier else near[:3])]
    assert sorted(map(tuple, found.collect())) == sorted(want) != []
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
