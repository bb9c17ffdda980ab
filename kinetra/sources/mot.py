"""Text formats of tracks and labels: MOT lines, one JSON record for each frame, detector labels, annotation records.

Each reader has a ``parse`` form over a table of lines (column ``value``), so that files, streams and tables are alike.
Lines that do not parse give no row. Writers give sorted lines; ``write_mot`` puts each sequence into its own folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACKS = "map<string, struct<box: array<double>, confidence: double>>"
FRAME_JSON = f"frame_idx long, tracks {TRACKS}"
ODGT_JSON = "ID string, gtboxes array<struct<tag: string, fbox: array<double>>>"


def plain(value: Column) -> Column:
    """Null for what JSON has no number for."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def parse_mot(lines: DataFrame, *carry: str) -> DataFrame:
    """Observations (frames from 0, corners) from MOT lines ``frame,id,x,y,w,h[,conf[,class[,visibility]]]``; other columns in ``carry``."""
    p = F.split(F.trim("value"), r"\s*,\s*")
    number = lambda k: F.get(p, k).try_cast("double")
    rows = lines.select(*carry, *[number(k).alias(c) for k, c in enumerate(("f", "i", "x", "y", "w", "h", "conf", "cls", "vis"))])
    rows = rows.where("f is not null and i is not null and x is not null and y is not null and w is not null and h is not null")
    return rows.select(
        *carry, F.col("i").cast("long").alias("track_id"), (F.col("f").cast("long") - 1).alias("frame_idx"), F.col("x").alias("x1"), F.col("y").alias("y1"),
        (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.coalesce("conf", F.lit(1.0)).alias("conf"),
        F.coalesce("cls", F.lit(1.0)).cast("int").alias("class"), F.coalesce("vis", F.lit(1.0)).alias("visibility"),
    )


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """Observations from the text files below ``path``; the sequence is the folder ``seq_id=...`` if there is one, else the file's name."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.coalesce(F.nullif(F.regexp_extract(F.input_file_name(), r"seq_id=([^/]+)", 1), F.lit("")), name).alias("seq_id"))
    return parse_mot(lines, "seq_id")


def mot_text(obs: DataFrame, truth: bool = False) -> DataFrame:
    """(seq_id, frame, id, line): MOT lines, frames from 1; sizes are not negative; of ground truth the mark is 1. Decimals are rounded half up."""
    size = lambda a, b: F.greatest(F.lit(0.0), F.col(b) - F.col(a))
    box = [F.round(v, 6) for v in (F.col("x1"), F.col("y1"), size("x1", "x2"), size("y1", "y2"))]
    head = F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,", F.col("frame_idx") + 1, F.col("track_id"), *box)
    mark = F.lit("1") if truth else F.format_string("%.4f", F.round(F.coalesce("conf", F.lit(1.0)), 8))
    return obs.select("seq_id", (F.col("frame_idx") + 1).alias("frame"), F.col("track_id").alias("id"), F.concat(head, mark, F.lit(",1,1")).alias("line"))


def write_mot(obs: DataFrame, path: str, truth: bool = False) -> None:
    """A folder for each sequence, its lines sorted by frame and id within and over the files' names."""
    lines = mot_text(obs, truth).repartitionByRange("seq_id", "frame", "id").sortWithinPartitions("seq_id", "frame", "id")
    lines.select("seq_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("seq_id").text(path)


def sequence_info(lines: DataFrame) -> DataFrame:
    """Largest frame (from 1) and id of MOT lines."""
    rows = parse_mot(lines)
    return rows.agg((F.max("frame_idx") + 1).alias("frames"), F.max("track_id").alias("max_id"))


def frames_json(obs: DataFrame, total_frames: int) -> DataFrame:
    """(seq_id, frame_idx, value): one JSON record for each frame from 0, also empty ones: tracks by id with box and confidence."""
    spine = obs.select("seq_id").distinct().withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total_frames - 1).cast("long"))))
    entry = F.struct(F.col("track_id").cast("string").alias("key"), F.struct(F.array(*[plain(F.col(c)) for c in ("x1", "y1", "x2", "y2")]).alias("box"), plain(F.col("conf")).alias("confidence")).alias("value"))
    found = obs.groupBy("seq_id", "frame_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tracks"))
    tracks = F.coalesce("tracks", F.map_from_arrays(F.array(), F.array()).cast(TRACKS))
    return spine.join(found, ["seq_id", "frame_idx"], "left").select("seq_id", "frame_idx", F.to_json(F.struct("frame_idx", tracks.alias("tracks")), {"ignoreNullFields": "false"}).alias("value"))


def parse_frames_json(lines: DataFrame, *carry: str) -> DataFrame:
    """Observations from such records; ids that are no numbers and boxes with fewer than four corners are left out, a missing confidence is 1."""
    rows = lines.select(*carry, F.from_json("value", FRAME_JSON).alias("r")).select(*carry, F.col("r.frame_idx").alias("frame_idx"), F.explode("r.tracks").alias("id", "t"))
    rows = rows.withColumn("track_id", F.col("id").try_cast("long")).where(F.col("track_id").isNotNull() & (F.size("t.box") >= 4))
    return rows.select(*carry, "track_id", "frame_idx", *[F.col("t.box")[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))], F.coalesce("t.confidence", F.lit(1.0)).alias("conf"))


def _label(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """``0 cx cy w h`` as shares of the picture, kept within 0 and 1."""
    unit = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 9)
    return F.format_string("0 %.6f %.6f %.6f %.6f", unit((x + w / 2) / width), unit((y + h / 2) / height), unit(w / width), unit(h / height))


def detector_labels(mot: DataFrame, width: float, height: float, least: float = 0.1) -> DataFrame:
    """(seq_id, frame_idx, track_id, label): persons (class 1) that are visible to a share of ``least``."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    label = _label(F.col("x1"), F.col("y1"), w, h, F.lit(width), F.lit(height))
    return mot.where((F.col("class") == 1) & (F.col("visibility") >= least)).select("seq_id", "frame_idx", "track_id", label.alias("label"))


def annotation_labels(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image, place, label) of the persons in annotation records (``value``); ``sizes`` has image, width, height."""
    rows = lines.select(F.from_json("value", ODGT_JSON).alias("r")).select(F.col("r.ID").alias("image"), F.posexplode("r.gtboxes").alias("place", "b"))
    box = [F.get("b.fbox", k) for k in range(4)]
    rows = rows.where((F.col("b.tag") == "person") & (F.size("b.fbox") >= 4) & (box[2] > 0) & (box[3] > 0))
    return rows.join(sizes, "image").select("image", "place", _label(*box, F.col("width"), F.col("height")).alias("label"))


def clamped_fps(fps: Column) -> Column:
    """Frames per second as a container tells, 30 where that is missing, next to zero or above 480."""
    return F.when((fps > 1e-3) & (fps <= 480.0), fps).otherwise(F.lit(30.0))


def intrinsics(focal_35mm: Column, width: Column, height: Column) -> Column:
    """fx, fy and horizontal field of view in degrees from a focal length as of a 36 mm wide picture; null where something is not positive."""
    half = F.lit(36.0) / (2.0 * focal_35mm)
    fx = 0.5 * width / half
    fit = (focal_35mm > 0) & (width > 0) & (height > 0)
    return F.when(fit, F.struct(fx.alias("fx"), (fx * height / width).alias("fy"), F.degrees(2.0 * F.atan(half)).alias("fov")))


def polygon(text: Column, width: float, height: float) -> Column:
    """Corners in pixels of a JSON polygon of shares; null with fewer than three."""
    corners = F.from_json(text, "array<array<double>>")
    return F.when(F.size(corners) >= 3, F.transform(corners, lambda c: F.struct((c[0] * width).alias("x"), (c[1] * height).alias("y"))))
