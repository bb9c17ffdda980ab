"""Streams against the same rows in a batch."""

from __future__ import annotations

import random

from kinetra.operators import events, grouped, kalman, pairs
from kinetra.streaming import live


def run(query, name, mode):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_lifecycle_stream(spark, tmp_path):
    rows = [(0, 1, 0), (0, 1, 1), (0, 1, 4), (0, 2, 7), (0, 1, 30)]
    spark.createDataFrame(rows, "seq_id long, track_id long, frame_idx long").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("seq_id long, track_id long, frame_idx long").parquet(str(tmp_path / "in"))
    run(live.lifecycle(stream, 5), "lifecycle", "append")
    got = sorted(tuple(r) for r in spark.table("lifecycle").collect())
    assert got == [(0, 1, 0, 0, "ACTIVE"), (0, 1, 1, 0, "ACTIVE"), (0, 1, 4, 2, "DORMANT"), (0, 1, 30, 25, "LOST"), (0, 2, 7, 0, "ACTIVE")]


def test_windows_of_a_stream_equal_the_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/event*.parquet")
    run(live.counts(stream), "windows", "complete")
    key = lambda r: (str(r["w"][0]), r["event_type"], r["n"])
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, live.counts(batch).collect()))


def test_smoothing_stream_equals_the_batch(spark, tmp_path):
    schema = "seq_id long, track_id long, frame_idx long, j int, x double, y double, s double"
    rows = [(0, t, f, j, 10.0 * t + (f * 7 + j) % 5, 3.0 * f, 0.2 if (f + j) % 4 == 1 else 0.9) for t in (1, 2) for j in (0, 5) for f in range(12) if f != 7]
    kp = spark.createDataFrame(rows, schema)
    for k in range(3):  # three files, three batches
        kp.where(f"frame_idx div 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    run(live.smoothed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), "smoothed", "append")
    key = lambda r: (r["track_id"], r["j"], r["frame_idx"], round(r["x"], 9), round(r["y"], 9))
    assert sorted(map(key, spark.table("smoothed").collect())) == sorted(map(key, grouped.smooth_poses(kp).collect()))


def test_chunks_and_sessions(spark):
    obs = spark.createDataFrame([(0, f, t) for f in (0, 1, 300) for t in range(6 if f == 1 else 2)], "seq_id long, frame_idx long, track_id long")
    got = sorted(tuple(r) for r in live.chunk_peaks(obs).collect())
    assert got == [(0, 0, 6, True), (0, 1, 2, False)]
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 10:00:00"), (1, "2024-01-03 00:00:00"), (2, "2024-01-01 05:00:00")], "user_id long, ts string")
    assert sorted((r["user_id"], r["n"]) for r in live.sessions(events).collect()) == [(1, 1), (1, 2), (2, 1)]


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_files(df, path, by, n):
    """``df`` as ``n`` files, and a stream that takes one in each batch."""
    for k in range(n):
        df.where(f"{by} = {k}").coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_pair_events_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, t, f, x, 0.0, x + 50.0, 40.0) for s in (0, 1) for f in range(60) for t in range(4) if rng.random() < 0.93 for x in [12.0 * t * (1 + 0.9 * ((f // 7 + t) % 2)) + rng.uniform(-3, 3)]]
    obs = spark.createDataFrame(rows, "seq_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double")
    at = events.Thresholds(0.5, 0.35, 3)
    batch = events.pair_events(pairs.frame_pairs(obs), obs, at).collect()
    spark.conf.set(*ROCKS)
    run(live.pair_events(in_files(obs, str(tmp_path / "in"), "frame_idx div 10", 6), at), "pair_events", "append")
    told = [tuple(r) for r in spark.table("pair_events").collect()]
    ended = {r[:4] for r in told if r[4] >= 0}
    got = sorted([r for r in told if r[4] >= 0] + [(*r[:4], None) for r in told if r[4] < 0 and r[:4] not in ended], key=str)
    assert got == sorted((tuple(r) for r in batch), key=str) and len(got) > 8 and {r[:4] for r in told if r[4] < 0} == {tuple(r)[:4] for r in batch}


def test_a_track_is_lost_when_it_happens(spark, tmp_path):
    """Track 1 never comes back: that it is DORMANT and LOST is told while track 2 goes on."""
    rows = [(0, 1, f) for f in range(5)] + [(0, 2, f) for f in range(0, 60)] + [(0, 3, 0), (0, 3, 40)]
    df = spark.createDataFrame(rows, "seq_id long, track_id long, frame_idx long")
    spark.conf.set(*ROCKS)
    run(live.absences(in_files(df, str(tmp_path / "in"), "frame_idx div 10", 6), dormant=2, lost=20), "absences", "append")
    got = sorted(tuple(r)[1:] for r in spark.table("absences").collect())
    assert [r for r in got if r[0] == 1] == [(1, 0, "ACTIVE"), (1, 7, "DORMANT"), (1, 25, "LOST")]
    assert [r for r in got if r[0] == 2] == [(2, 0, "ACTIVE")]
    assert [r for r in got if r[0] == 3] == [(3, 0, "ACTIVE"), (3, 3, "DORMANT"), (3, 21, "LOST"), (3, 40, "ACTIVE"), (3, 43, "DORMANT")]


def test_a_bank_wakes_and_forgets(spark, tmp_path):
    x, y, z = [1.0, 0.0], [0.8, 0.6], [0.0, 1.0]
    rows = [(0, 0, 1, "seen", x), (0, 0, 2, "seen", z), (0, 5, 1, "lost", None), (0, 12, 50, "ask", y), (0, 13, 51, "ask", x), (0, 14, 2, "lost", None), (0, 25, 52, "ask", z), (0, 26, 1, "lost", None), (0, 400, 53, "ask", x)]
    df = spark.createDataFrame(rows, "seq_id long, frame_idx long, track_id long, kind string, look array<double>")
    spark.conf.set(*ROCKS)
    run(live.trajectories(in_files(df, str(tmp_path / "in"), "frame_idx div 10", 41), 0.6, 300), "bank", "append")
    got = sorted(tuple(r) for r in spark.table("bank").collect())
    # 50 wakes track 1; 51 finds nobody asleep; 52 wakes track 2; at frame 400 track 1 is forgotten.
    assert [r[:4] for r in got] == [(0, 12, 50, 1), (0, 25, 52, 2)] and abs(got[0][4] - 0.8) < 1e-9


def test_filter_of_a_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(0, t, f, x, 5.0 * t, x + 20 + rng.random(), 5.0 * t + 40) for t in (1, 2, 3) for f in range(40) if rng.random() < 0.8 for x in [3.0 * f + (60 if f > 25 and t == 2 else 0) + rng.random()]]
    obs = spark.createDataFrame(rows, "seq_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double")
    spark.conf.set(*ROCKS)
    run(live.filtered(in_files(obs, str(tmp_path / "in"), "frame_idx div 7", 6)), "filtered", "append")
    key = lambda r: tuple(round(v, 9) for v in r)
    batch = sorted(map(key, kalman.filtered(obs).collect()))
    assert sorted(map(key, spark.table("filtered").collect())) == batch and max(r[-1] for r in batch) > 1.5
