"""Whole results as documents ``{metadata, frames[]}`` and as packed detections, each in parts of a bounded number of frames.

A part is a document of its own; a sequence of any length is as many parts, so none is ever one row or one task. Files lie in
folders ``seq_id=...``: a filter on the sequence reads only its folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetra.sources.mot import plain

#: Frames of a part, at most.
PART = 1024
ENTRY = "struct<id: bigint, box: array<double>, confidence: double, keypoints: array<array<double>>>"
DOCUMENT = f"metadata struct<part: bigint, first_frame: bigint, n_frames: bigint, fps: double, width: int, height: int>, frames array<struct<frame_idx: bigint, tracks: array<{ENTRY}>>>"
BOX = ("x1", "y1", "x2", "y2")


def _spine(obs: DataFrame, total_frames: int) -> DataFrame:
    """Every frame of each sequence, also empty ones."""
    return obs.select("seq_id").distinct().withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total_frames - 1).cast("long"))))


def documents(obs: DataFrame, total_frames: int, keypoints: DataFrame | None = None, fps: float = 30.0, size: tuple[int, int] = (1920, 1080), part: int = PART) -> DataFrame:
    """(seq_id, part, value): the documents as JSON. Numbers that JSON lacks (not a number, infinite) are null.

    ``keypoints`` (seq_id, track_id, frame_idx, j, x, y, s) are added to the boxes of their track; poses without a box are left out, a track
    without a pose has null keypoints. Tracks are in order of their ids.
    """
    keys = ["seq_id", "track_id", "frame_idx"]
    rows = obs.select(*keys, F.array(*[plain(F.col(c).cast("double")) for c in BOX]).alias("box"), plain(F.col("conf").cast("double")).alias("confidence"))
    if keypoints is not None:
        joint = F.struct("j", F.array(*[plain(F.col(c).cast("double")) for c in ("x", "y", "s")]).alias("p"))
        poses = keypoints.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(joint)), lambda p: p["p"]).alias("keypoints"))
        rows = rows.join(poses, keys, "left")
    else:
        rows = rows.withColumn("keypoints", F.lit(None).cast("array<array<double>>"))
    tracks = rows.groupBy("seq_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct(F.col("track_id").alias("id"), "box", "confidence", "keypoints"))).alias("tracks"))
    frames = _spine(obs, total_frames).join(tracks, ["seq_id", "frame_idx"], "left").withColumn("tracks", F.coalesce("tracks", F.array().cast(f"array<{ENTRY}>")))
    parts = frames.groupBy("seq_id", F.floor(F.col("frame_idx") / part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "tracks"))).alias("frames"), F.min("frame_idx").alias("first_frame"), F.count("*").alias("n_frames"))
    about = F.struct("part", "first_frame", "n_frames", F.lit(fps).alias("fps"), F.lit(size[0]).alias("width"), F.lit(size[1]).alias("height"))
    return parts.select("seq_id", "part", F.to_json(F.struct(about.alias("metadata"), "frames"), {"ignoreNullFields": "false"}).alias("value"))


def parsed(docs: DataFrame, *carry: str) -> DataFrame:
    """(carry, part, frame_idx, tracks) for each frame of the documents in ``value``; what is no document gives no row."""
    d = docs.select(*carry, F.from_json("value", DOCUMENT).alias("d")).where("d.frames is not null")
    return d.select(*carry, F.col("d.metadata.part").alias("part"), F.explode("d.frames").alias("f")).select(*carry, "part", "f.frame_idx", "f.tracks")


def observations(frames: DataFrame, *carry: str) -> DataFrame:
    """Observations of such frames; boxes with a missing corner are left out, a missing confidence is 1."""
    rows = frames.select(*carry, "frame_idx", F.explode("tracks").alias("t")).where((F.size("t.box") >= 4) & F.forall("t.box", lambda v: v.isNotNull()))
    return rows.select(*carry, F.col("t.id").alias("track_id"), "frame_idx", *[F.col("t.box")[k].alias(c) for k, c in enumerate(BOX)], F.coalesce("t.confidence", F.lit(1.0)).alias("conf"))


def poses(frames: DataFrame, *carry: str) -> DataFrame:
    """Keypoints of such frames, by joint."""
    rows = frames.select(*carry, "frame_idx", F.explode("tracks").alias("t")).select(*carry, F.col("t.id").alias("track_id"), "frame_idx", F.posexplode("t.keypoints").alias("j", "p"))
    return rows.select(*carry, "track_id", "frame_idx", "j", *[F.col("p")[k].alias(c) for k, c in enumerate(("x", "y", "s"))])


def write_documents(docs: DataFrame, path: str) -> None:
    """One line for each part, in the folder of its sequence, in place of what was there; a job that fails leaves no document half written."""
    docs.repartition("seq_id", "part").sortWithinPartitions("seq_id", "part").select("seq_id", "value").write.mode("overwrite").partitionBy("seq_id").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, value); the sequence is a partition column."""
    return spark.read.schema("value string, seq_id long").text(path)


def packed(obs: DataFrame, total_frames: int, part: int = PART) -> DataFrame:
    """Detections as counts of each frame and flat boxes: (seq_id, part, first_frame, offset, counts, ids, boxes, scores).

    ``offset`` is the place of the part's first box among all of the sequence: a sum over the parts before it.
    """
    box = F.struct("track_id", *[F.col(c).cast("double").alias(c) for c in BOX], F.col("conf").cast("double").alias("conf"))
    found = obs.groupBy("seq_id", "frame_idx").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    frames = _spine(obs, total_frames).join(found, ["seq_id", "frame_idx"], "left").select("seq_id", "frame_idx", F.coalesce("boxes", F.array().cast(found.schema["boxes"].dataType)).alias("boxes"))
    parts = frames.groupBy("seq_id", F.floor(F.col("frame_idx") / part).alias("part")).agg(F.min("frame_idx").alias("first_frame"), F.array_sort(F.collect_list(F.struct("frame_idx", "boxes"))).alias("frames"))
    parts = parts.select("seq_id", "part", "first_frame", F.transform("frames", lambda f: F.size(f["boxes"])).alias("counts"), F.flatten(F.transform("frames", lambda f: f["boxes"])).alias("rows"))
    before = F.sum(F.size("rows").cast("long")).over(Window.partitionBy("seq_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    flat = F.flatten(F.transform("rows", lambda r: F.array(*[r[c] for c in BOX])))
    return parts.select("seq_id", "part", "first_frame", F.coalesce(before, F.lit(0)).alias("offset"), "counts", F.col("rows.track_id").alias("ids"), flat.alias("boxes"), F.col("rows.conf").alias("scores"))


def _upto(counts: Column) -> Column:
    """Sums of the counts before each place, and of all."""
    return F.aggregate(counts, F.array(F.lit(0)), lambda t, n: F.concat(t, F.array(F.element_at(t, -1) + n)))


def unpacked(parts: DataFrame) -> DataFrame:
    """Observations of packed detections; parts whose arrays do not fit their counts are left out whole."""
    n = F.aggregate("counts", F.lit(0), lambda t, k: t + k)
    fit = (F.size("ids") == n) & (F.size("boxes") == 4 * n) & (F.size("scores") == n) & ~F.exists("counts", lambda k: k < 0)
    frames = parts.where(fit).select("seq_id", "first_frame", "ids", "boxes", "scores", F.posexplode(F.zip_with("counts", F.slice(_upto(F.col("counts")), 1, F.size("counts")), lambda n, s: F.struct(n.alias("counts"), s.alias("start")))).alias("k", "c"))
    frames = frames.where("c.counts > 0").withColumn("at", F.explode(F.sequence(F.col("c.start"), F.col("c.start") + F.col("c.counts") - 1)))
    return frames.select("seq_id", F.get("ids", F.col("at")).alias("track_id"), (F.col("first_frame") + F.col("k")).alias("frame_idx"), *[F.get("boxes", 4 * F.col("at") + k).alias(c) for k, c in enumerate(BOX)], F.get("scores", F.col("at")).alias("conf"))
